"""CRCs against zlib, and importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lakestream.llm import crc, resampling
from tests.llm.conftest import DOCUMENTS, document
from tests.llm.test_winnowing import words_of


def test_crc_of_spans_is_that_of_zlib():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    spans = [(0, 0), (5, 5), (0, 1), (0, 20_000), (7, 7 + crc.DEPTH), (7, 8 + crc.DEPTH), (9, 9 + 2 * crc.DEPTH)]
    spans += [(a, a + rng.choice([1, 2, 3, 4, 5, 9, 63, 64, 65, 130, 1000])) for a in (rng.randrange(19_000) for _ in range(2000))]
    starts, ends = np.array(spans).T
    found = crc.crc32_of_spans(np.frombuffer(data, np.uint8), starts, ends)
    assert found.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    none = np.empty(0, np.int64)
    assert len(crc.crc32_of_spans(np.frombuffer(data, np.uint8), none, none)) == 0


def plain(docs, target, longest=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    def features(text):
        w = words_of(text)
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    rows = [(doc_id, *features(text)) for doc_id, text in docs]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    size_s, size_t = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * size_s / ((s[b] + 1) * size_t))) for b in range(buckets)]
    out = []
    for doc_id, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=repr)


def sampled(docs, target, **kwargs):
    return sorted(map(tuple, resampling.importance_resampling(docs, target, **kwargs).collect()), key=repr)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (2, 500, 50), (3, 70_000, 100)])
def test_against_a_plain_version(spark, sf_dir, given, longest, buckets, percent):
    docs, texts = given
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = plain(texts.items(), [r["text"] for r in target.collect()], longest, buckets, percent)
    assert sampled(docs, target, longest=longest, buckets=buckets, percent=percent) == wanted


def test_odd_rows(spark, tricky, nothing):
    target = spark.createDataFrame([(1, "one two word1x1"), (2, None), (None, "Seven")], "item_id long, text string")
    texts = [r["text"] for r in target.collect()]
    docs = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    assert sampled(tricky, target, least_words=2, percent=60) == plain(docs, texts, least_words=2, percent=60)
    assert sampled(tricky, target.limit(0)) == plain(docs, [])
    assert sampled(nothing, target) == []


def test_ties_go_to_the_smaller_id(spark):
    rows = [document(i, "same words " * 15) for i in (5, 5, None, None, *range(40))]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    target = spark.createDataFrame([("same",)], "text string")
    assert sampled(docs, target, percent=50) == plain([r[:2] for r in rows], ["same"], percent=50)
    assert sampled(docs, target, percent=50) == sampled(docs.repartition(2), target, percent=50)
