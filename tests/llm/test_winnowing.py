"""Decontamination against plain windows, and what winnowing promises."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lakestream.llm import winnowing
from lakestream.llm.words import word_slices
from tests.llm.conftest import LONG, DOCUMENTS, document

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(SMALL))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [
    (1, ITEM),
    (2, ITEM.upper()),
    (2, "one two three"),
    (3, "solo"),
    (4, None),
    (5, " .,; "),
    (None, "été naïve Straße 日本語 ß x1 y2 z3 a4 b5"),
    (6, "same same same same same same same same same same same same"),
    (7, " ".join(f"word{i}x{i}" for i in range(9_000, 9_012))),
]


def test_words_are_those_of_the_expression():
    texts = ["", None, "aB-c", "Été\x00NAÏVE_x", "end", "begin z", "日本語 ÀB", " ", "x" * 5000, "a"] * 3
    found = []
    for first, last, words in word_slices(pa.array(texts)):
        by_row = [[] for _ in range(last - first)]
        for i, r in enumerate(words.row):
            by_row[r].append(words.text(i))
        found += by_row
    assert found == [words_of(t) for t in texts]


@pytest.mark.parametrize("span", [1, 3, 5, 7, 10])
def test_every_shared_span_shares_a_fingerprint(span):
    rng = random.Random(span)
    for _ in range(200):
        vocabulary = rng.choice([2, 5, 1000])
        shared = [rng.randrange(vocabulary) for _ in range(span)]
        sides = []
        for _ in range(2):
            own = [[rng.randrange(vocabulary) for _ in range(rng.randrange(30))] for _ in range(2)]
            hashes = winnowing.mixed(np.array(own[0] + shared + own[1], np.uint64))
            at, prints = winnowing.fingerprints(hashes, np.zeros(len(hashes), int), span)
            first = len(own[0])
            inside = (at >= first) & (at + min(span, winnowing.GRAM) <= first + span)
            sides.append(set((at[inside] - first).tolist()) and set(zip((at[inside] - first).tolist(), prints[inside].tolist(), strict=True)))
        assert sides[0] & sides[1]


def contaminated(spark, docs, items, **kwargs):
    rows = spark.createDataFrame(docs, DOCUMENTS) if isinstance(docs, list) else docs
    return sorted(map(tuple, winnowing.contamination(rows, items, **kwargs).collect()), key=repr)


def test_against_plain_windows(spark):
    w = ITEM.split()
    rng = random.Random(7)
    texts = [
        ITEM, "x " + " ".join(w[:10]) + " y", "x " + " ".join(w[:9]) + " y", " ".join(w[:9]) + " x " + " ".join(w[9:]),
        ITEM + ", " + ITEM, "Solo!", "one-two_three", "one two x three", None, "", " \t ", LONG, "same " * 40,
        "été naïve Straße 日本語 ß x1 y2 z3 a4 b5 solo", "ÉTÉ naïve", *[" ".join(rng.choices(w, k=60)) for _ in range(20)],
        " ".join(w[2:]) + " tail", " ".join(w[:10]), " ".join(w[:10]),
    ]
    docs = [document(i % 30 or None, t) for i, t in enumerate(texts)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contaminated(spark, docs, items) == plain([d[:2] for d in docs], ITEMS)


def test_empty_tables_and_odd_rows(spark, tricky, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(spark, nothing, items) == []
    rows = contaminated(spark, tricky, none)
    assert len(rows) == 12 and not any(r[5] for r in rows)
    wanted = plain([(r["doc_id"], r["text"]) for r in tricky.collect()], ITEMS)
    assert contaminated(spark, tricky, items) == wanted


def test_given_documents(spark, sf_dir, given):
    docs, texts = given
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = plain(texts.items(), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert contaminated(spark, docs, items) == wanted and any(r[5] for r in wanted)


def test_a_full_table_of_bits_changes_nothing(spark, sf_dir, given, monkeypatch):
    docs, _ = given
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = contaminated(spark, docs, items)
    monkeypatch.setattr(winnowing, "bit_table", lambda rows: (np.arange(1 << 18), np.full(1 << 18, 2**64 - 1, np.uint64)))
    assert contaminated(spark, docs, items) == wanted
