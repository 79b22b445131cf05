"""Packed products against plain ones, and hard negatives against a plain version."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lakestream.llm import hard_negatives
from lakestream.llm.hard_negatives import Fields

SCHEMA = "vec_id long, embedding array<float>, label int, place int, score string, vector string, _a int"


@pytest.mark.parametrize("size", [1, 300, 10**6, 2**40, 10**30])
def test_fields_hold_exact_scores(size):
    rng = random.Random(size)
    kind = np.int64 if size < 2**62 else object
    rows = np.array([[rng.randint(-size, size) for _ in range(17)] for _ in range(50)], kind)
    rows[3] = -size
    rows[4] = size
    for anchor in ([rng.randint(-size, size) for _ in range(17)], [-size] * 17, [size] * 17, [0] * 17):
        found = Fields(rows, size).scores(anchor)
        assert [int(x) for x in found] == [sum(a * int(c) for a, c in zip(anchor, r, strict=True)) for r in rows]


def plain(rows):
    taken = []
    for n, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taken.append((n, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for n, vec_id, label, vector in taken:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v, strict=False)), i is None, i or 0, i, other) for m, i, other, v in taken if m != n]
        scored.sort(key=lambda s: s[:3])
        for top in [s for s in scored if s[4] == label][:5]:
            fits = [s for s in scored if s[4] != label and 80 * -top[0] <= 100 * -s[0] <= 100 * -top[0]]
            out += [(vec_id, top[3], rank, s[3], -top[0], -s[0]) for rank, s in enumerate(fits[:5], 1)]
    return sorted(out, key=repr)


def mined(rows):
    return sorted(map(tuple, hard_negatives.hard_negatives(rows).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "s", "v", 1) for r in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    rng = random.Random(3)
    near = lambda: [0.5 + rng.random() / 10 for _ in range(4)]
    rows = [(i, near(), i % 3) for i in range(0, 260, 5)]
    rows += [(100, near(), 1), (100, near(), 2), (None, near(), 1), (None, near(), 2), (300, None, 1), (400, near(), None)]
    rows += [(500, [0.5, None, 0.5, 0.5], 1), (600, [0.5, math.nan, 0.5, 0.5], 1), (700, [0.5, math.inf, 0.5, 0.5], 1)]
    rows += [(800, [], 1), (900, [0.5, 0.5], 1), (1000, [0.5] * 6, 2), (1100, [0.0] * 4, 1), (1200, [-0.5] * 4, 1)]
    rows += [(7, [0.5] * 4, 1), (8, [0.5] * 4, 1), (9, [0.5] * 4, 2), (9, [0.5] * 4, 2), (2**60 + 1, [0.5] * 4, 2)]
    found = mined(table(spark, rows))
    assert found == plain(rows) and found


def test_blocks_change_nothing(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    wanted = plain([tuple(r) for r in rows.select("vec_id", "embedding", "label").collect()])
    assert mined(rows) == wanted and wanted
    monkeypatch.setattr(hard_negatives, "FIELDS", 7)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 90)
    assert mined(rows) == wanted


def test_empty_table_and_large_components(spark):
    assert mined(table(spark, [])) == []
    rows = [(100, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [2.9e38, 0.0], 2), (3, [1.0, 1.0], 2)]
    found = hard_negatives.hard_negatives(table(spark, rows)).collect()
    assert [(r["positive_id"], r["negative_id"], r["positive_score"]) for r in found] == [(1, 2, None)]
