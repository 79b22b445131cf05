"""Mixing against a plain loop over sources and documents, and the curriculum's arithmetic."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from lakestream.llm import mixing
from lakestream.llm.common import prefix_sums
from tests.llm.conftest import DOCUMENTS, TRICKY, document

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_of(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess until no target is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if share * weight[s] >= cap * sizes[s]}
        if not stopped:
            return out | {s: share * weight[s] for s in open_}
        for s in stopped:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= stopped
    return out


def check_mix(rows, data):
    size_of = [(doc_id, source, len(WORD.findall(text or ""))) for doc_id, text, source in data]
    sizes = Counter()
    for _, source, size in size_of:
        sizes[source] += size
    sizes.update({source: 0 for _, source, _ in size_of})
    targets = targets_of(sizes)
    assert sorted((repr(r["doc_id"]), repr(r["source"]), r["size"]) for r in rows) == sorted(
        (repr(a), repr(b), c) for a, b, c in size_of
    )
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1


def test_mix_of_the_given_documents(given):
    docs, _ = given
    data = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    once, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    check_mix(once, data)
    assert sorted(map(tuple, once), key=repr) == sorted(map(tuple, again), key=repr)
    positions = [r["position"] for r in once if r["position"] is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1


def test_mix_of_tricky_rows(spark, tricky, nothing):
    check_mix(mixing.mix(tricky).collect(), [(r[0], r[1], r[3]) for r in TRICKY])
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    empty = spark.createDataFrame([document(i, None, s) for i, s in enumerate("abc")], DOCUMENTS)
    assert [(r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0.0, 0)] * 3


@pytest.mark.parametrize("words", [(1000, 10, 10), (10, 1000, 10), (1, 1, 100), (0, 5, 50), (7, 7, 7)])
def test_capped_targets_are_reshared(spark, words):
    data = [(i, " ".join("w" * n), s) for i, (n, s) in enumerate(zip(words, (None, "a", "b"), strict=True))]
    docs = spark.createDataFrame([document(*row) for row in data], DOCUMENTS)
    check_mix(mixing.mix(docs).collect(), data)


def test_mixed_documents_are_what_was_taken(given):
    docs, texts = given
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    found = defaultdict(list)
    for r in rows.collect():
        found[r["doc_id"]].append(r["text"])
    assert set(found) == {i for i, n in taken.items() if n}
    for doc_id, parts in found.items():
        assert sum(len(WORD.findall(p)) for p in parts) == taken[doc_id]
        assert all(texts[doc_id].startswith(p) for p in parts)
        assert sum(p != texts[doc_id] for p in parts) <= 1


def test_mixed_documents_with_null_and_repeated_ids(spark):
    data = [(None, "n1 " * 30, "a"), (None, "n2 " * 20, "a"), (None, "n3 " * 25, "b"), (1, "r1 " * 40, "a"), (1, "r2 " * 15, "b"), (2, "u " * 50, "b")]
    docs = spark.createDataFrame([document(*row) for row in data], DOCUMENTS).repartition(3).checkpoint()
    taken = {(r["source"], r["size"]): r["taken"] for r in mixing.mix(docs).collect()}
    found = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words = WORD.findall(r["text"])
        size = next(len(WORD.findall(t)) for i, t, s in data if (i, s) == (r["doc_id"], r["source"]) and t.startswith(words[0]))
        found[(r["source"], size)] += len(words)
    assert +found == +Counter(taken)


def test_shares_add_up_all_the_time(given):
    docs, _ = given
    sizes = mixing.placed_documents(docs, (5, 2, 1), 3, 0.5)
    plan = {r["source"]: r for r in sizes.select("source", "target", "share", "early", "late").distinct().collect()}
    assert sum(r["early"] for r in plan.values()) == pytest.approx(1)
    assert sum(r["late"] for r in plan.values()) == pytest.approx(1)
    for r in plan.values():
        assert (r["early"] + r["late"]) / 2 == pytest.approx(r["share"]) and min(r["early"], r["late"]) >= 0


def test_positions_invert_the_demand(given):
    docs, _ = given
    rows = mixing.placed_documents(docs, (5, 2, 1), 3, 0.5).filter("taken > 0")
    rows = rows.withColumn("position", mixing.due(mixing.F.lit(0))).collect()
    for r in rows:
        t = r["position"]
        demand = r["target"] / r["share"] * (r["early"] * t + (r["late"] - r["early"]) * t * t / 2)
        assert demand == pytest.approx(r["before"], abs=1e-6 * r["target"])


def test_prefix_sums_with_ties_and_nulls(spark):
    data = [(g, d, i, v) for i, (g, d, v) in enumerate([(None, "00a0000", 1), ("x", "00a0000", 2), ("x", "00a0000", 3), ("x", "fff0000", 4), (None, "0000000", 5)])]
    rows = spark.createDataFrame(data, "g string, d string, i int, v long")
    got = {r["i"]: (r["before"], r["total"]) for r in prefix_sums(rows, "g", "d", ["i"], "v", "before", "total").collect()}
    assert got == {0: (5, 6), 1: (0, 9), 2: (2, 9), 3: (5, 9), 4: (0, 6)}
