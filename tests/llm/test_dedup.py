"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakestream.llm import components, exact_dedup, near
from tests.llm.conftest import DOCUMENTS, TRICKY, document

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_copies_of_tricky_rows(tricky):
    got = exact_dedup.exact_copies(tricky, winners=4, counters=16).collect()
    assert len(got) == len(TRICKY)
    groups = defaultdict(list)
    for row in TRICKY:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or "")
        groups[hashlib.sha256(text.encode()).hexdigest()].append(row[0])
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    for digest in groups:
        assert sum(r["kept"] for r in got if r["text_sha256"] == digest) == 1


@pytest.mark.parametrize("least", [2, 10_000])
def test_heavy_hitters_decide_the_way_not_the_result(spark, rows, least, monkeypatch):
    found = exact_dedup.heavy_hitters
    monkeypatch.setattr(exact_dedup, "heavy_hitters", lambda r, w, c: found(r, w, c, least=least))
    rng = random.Random(1)
    data = [document(i, rng.choice(["hot copy", "hot  copy", f"text {i // 3}", ""])) for i in range(400)]
    docs = spark.createDataFrame(data, DOCUMENTS)
    got = exact_dedup.exact_copies(docs)
    want = {}
    for row in data:
        want.setdefault(re.sub(r"\s+", " ", row[1]), row[0])
    assert {r["doc_id"] for r in got.filter("kept").collect()} == set(want.values())
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id")) == sorted([(i,) for i in want.values()], key=repr)


def test_without_copies_of_tricky_rows(tricky, nothing):
    kept = exact_dedup.without_copies(tricky)
    assert kept.columns == tricky.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 3, 4, 6, 7, 8, 9]
    assert exact_dedup.without_copies(nothing).count() == exact_dedup.exact_copies(nothing).count() == 0


def shingles(text, n=5):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_links(texts, threshold=0.8):
    """Links and classes of all pairs."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    links, root = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in ids}


def test_near_classes_of_the_given_documents(given):
    docs, texts = given
    links, classes = brute_links(texts)
    got = {r["doc_id"]: r for r in near.near_classes(docs).collect()}
    assert {i: got[i]["n_links"] for i in got} == links
    assert {i: got[i]["class_id"] for i in got} == classes
    assert {i for i in got if got[i]["kept"]} == set(classes.values())


@pytest.mark.parametrize("block", [8, 512])
def test_a_group_of_near_copies_larger_than_a_block(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        texts[i] = " ".join(words)
    links, classes = brute_links(texts)
    docs = spark.createDataFrame([document(i, t) for i, t in texts.items()], DOCUMENTS)
    got = {r["doc_id"]: r for r in near.near_classes(docs, recall=0.9999).collect()}
    assert {i: got[i]["class_id"] for i in got} == classes
    # banding may miss a pair near the threshold now and then
    assert sum(abs(got[i]["n_links"] - links[i]) for i in got) <= 0.01 * sum(links.values())


def test_near_classes_of_tricky_rows(tricky, nothing):
    got = near.near_classes(tricky).collect()
    assert len(got) == len(TRICKY)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (1, 2, 3, 8, 9):
        assert (by_id[i]["class_id"], by_id[i]["n_links"], by_id[i]["class_size"], by_id[i]["kept"]) == (i, 0, 1, True)
    assert by_id[4]["n_links"] == 3 and by_id[5]["class_id"] == 4 and not by_id[5]["kept"]
    assert by_id[7]["class_id"] == by_id[6]["class_id"] == 6 and by_id[7]["n_links"] == 1
    kept = near.one_per_class(tricky)
    assert kept.columns == tricky.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 8, 9]
    assert near.near_classes(nothing).count() == near.one_per_class(nothing).count() == 0


@pytest.mark.parametrize("ids", [(None, None, None), (1, 1, 1), (None, 1, 1)])
def test_near_copies_with_null_or_equal_ids(spark, ids):
    base = " ".join(f"w{i}" for i in range(100))
    data = [document(i, t) for i, t in zip(ids, (base, base + " x", base + " y"), strict=True)]
    docs = spark.createDataFrame([*data, document(ids[0], "far away")], DOCUMENTS)
    got = near.near_classes(docs).collect()
    assert sorted((r["class_size"], r["kept"]) for r in got) == [(1, True), (3, False), (3, False), (3, True)]
    texts = [r["text"] for r in near.one_per_class(docs).collect()]
    assert len(texts) == 2 and "far away" in texts


def test_texts_without_words_all_stay(spark):
    docs = spark.createDataFrame([document(i, t) for i, t in ((1, None), (1, ""), (1, " "), (None, "\n"), (None, None), (2, "a b"), (2, "a b"))], DOCUMENTS)
    assert near.one_per_class(docs).count() == near.near_classes(docs).filter("kept").count() == 6


def test_banding_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, per_band = near.banding(threshold, 0.999)
        assert bands * per_band <= 128 and 1 - (1 - threshold**per_band) ** bands >= 0.999


def test_overlaps_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200))).astype(np.uint64) for _ in range(30)]
    got = near.overlaps(sets, width=16)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == want[off]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    random.Random(2).shuffle(chain)
    got = components.components(spark.createDataFrame(chain, "a long, b long"))
    roots = {r["node"]: r["root"] for r in got.collect()}
    assert len(roots) == 351
    assert {r for n, r in roots.items() if n < 1000} == {0} and {r for n, r in roots.items() if n >= 1000} == {1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
