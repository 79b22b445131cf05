"""Quality rules and toxicity: statistics against plain Python, learning on made-up data, held-out documents."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakestream.llm import quality, toxicity
from tests.llm.conftest import DOCUMENTS, TRICKY, document

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check_counts(rows, data):
    want = []
    for doc_id, text in data:
        counts = plain_counts(text)
        want.append((repr(doc_id), *counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0]))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((repr(r["doc_id"]), *[r[c] for c in columns]) for r in rows) == sorted(want)
    assert not any(r["kept"] and (r["base_failed"] or r["rule"]) for r in rows)


def test_quality_of_given_and_tricky_documents(spark, sf_dir, given, tricky, nothing, no_labels):
    docs, texts = given
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    check_counts(quality.quality_verdicts(docs, labels).collect(), texts.items())
    rows = quality.quality_verdicts(tricky, no_labels).collect()
    check_counts(rows, [r[:2] for r in TRICKY])
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert quality.quality_verdicts(nothing, no_labels).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e f g h " * 3, "x " * 7, "x " * 8, "x " * 9, " ".join("abcdefgh") + " z " + " ".join("abcdefgh"), "é\n\né\n é\né"]
    got = quality.counts_of(texts)
    assert [tuple(r) for r in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy().tolist()] == [
        plain_counts(t) for t in texts
    ]
    assert quality.counts_of([]).shape == (0, len(quality.COUNTS))


def test_learned_rules_find_the_planted_one(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.3) | (x["c"] > 0.95)
    rules = quality.learn(x, bad)
    got = np.zeros(3000, bool)
    for rule in rules.rules:
        got |= quality.covers(list(rule), x, 3000)
    assert (got == bad).mean() > 0.97 and len(rules.rules) <= 6
    table = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(*x.values(), strict=True)], "a double, b double, c double")
    assert table.filter(rules.number() > 0).count() == got.sum()
    assert quality.learn({}, np.zeros(0, bool)).rules == () == quality.learn(x, np.zeros(3000, bool)).rules
    assert spark.range(1).filter(quality.DecisionList().number() > 0).count() == 0


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    words, foul = [f"word{i}" for i in range(400)], [f"foul{i}" for i in range(6)]
    data = []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = list(rng.choice(words, 30))
        if toxic:
            text += list(rng.choice(foul, 3))
        data.append((i, " ".join(text), int(toxic)))
    return data


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    data = made_up(1500, 1)
    docs = spark.createDataFrame([document(i, t) for i, t, _ in data], DOCUMENTS)
    labels = spark.createDataFrame([(i, None, y) for i, _, y in data if i % 2], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for i, _, y in data:
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= rows[i]["score"] <= 1 and rows[i]["predicted"] == int(rows[i]["score"] >= 0.5)
    held = [(rows[i]["predicted"], y) for i, _, y in data if rows[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i in rows if rows[i]["predicted"] == 0}


def test_held_out_labels_teach_nothing(spark):
    data = made_up(300, 2)
    docs = spark.createDataFrame([document(i, t) for i, t, _ in data], DOCUMENTS)
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    schema = "doc_id long, toxic int"
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, spark.createDataFrame(rows, schema)).collect()}
        for rows in ([(i, y) for i, _, y in data], [(i, flip(i, y)) for i, _, y in data])
    ]
    assert scores[0] == scores[1]


def test_toxicity_of_the_given_documents(spark, sf_dir, given):
    docs, _ = given
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    known = [(rows[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if not rows[r["doc_id"]]["held_out"]]
    assert sum(p and not y for p, y in known) <= 0.02 * len(known)


def test_toxicity_of_tricky_rows(tricky, nothing, no_labels):
    rows = toxicity.toxicity_scores(tricky, no_labels).collect()
    assert len(rows) == len(TRICKY) and not any(r["predicted"] for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.clean_documents(tricky, no_labels).count() == len(TRICKY)
    assert toxicity.toxicity_scores(nothing, no_labels).count() == toxicity.clean_documents(nothing, no_labels).count() == 0


def test_words_of_few_toxic_documents_tell_at_every_size(spark):
    # 1,000 positives, and 3 of them have each rare word: under one in a hundred
    data = [(1, [f"rare{i // 3}", "common"]) for i in range(1000)] + [(0, ["common", f"other{i}"]) for i in range(9000)]
    rows = spark.createDataFrame(data, "sort int, words array<string>")
    found = toxicity.telling_words(rows, {1: 1000, 0: 9000}, 8192)
    assert {f"rare{i}" for i in range(333)} <= set(found) and "other1" not in found
    assert len(toxicity.telling_words(rows, {1: 1000, 0: 9000}, 50)) == 50


def test_risk_is_never_negative_for_the_step():
    # every unlabelled row is a positive: the corrected risk would fall without bound
    row = [np.array([0], np.int32)] * 50
    weights, bias = toxicity.fit_one(row, row, 1, 0.5)
    assert np.isfinite(weights).all() and np.isfinite(bias)
    with pytest.raises(ValueError):
        toxicity.sparse([])
