"""Row patterns against regular expressions over each key's symbols, whatever the chunks."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakestream.operators.patterns import Automaton, match_pattern

BEGIN = datetime(2024, 1, 1)
SCHEMA = "k long, ts timestamp_ntz, id long, s string"
PATTERNS = [
    [("a", "1"), ("b", "*"), ("c", "1")],
    [("a", "1"), ("a", "1"), ("b", "1")],
    [("a", "1"), ("b", "?"), ("c", "+")],
    [("a", "?"), ("b", "1"), ("a", "*")],
    [("a", "+"), ("b", "+"), ("a", "1"), ("c", "?")],
]


def events(n=600, seed=5):
    """One key has most rows; times repeat; some have no symbol, key, time or number."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice([1, 1, 1, 1, 2, 3, None])
        ts = BEGIN + timedelta(seconds=rng.randrange(400) // 3) if rng.random() > 0.03 else None
        rows.append((key, ts, i if rng.random() > 0.02 else None, rng.choice(["a", "a", "b", "b", "c", "x", "none", None])))
    return rows


def plain(rows, steps, within=None):
    pattern = re.compile("".join(s + q.replace("1", "") for s, q in steps))
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key and r[1] and r[2] is not None and r[3] in ("a", "b", "c", "x"))
        text = "".join(r[2] for r in mine)
        for end in range(len(mine)):
            start = next((s for s in range(end, -1, -1) if pattern.fullmatch(text, s, end + 1)), None)
            if start is not None and (within is None or (mine[end][0] - mine[start][0]).total_seconds() <= within):
                out.append((key, mine[start][1], mine[end][1], mine[start][0], mine[end][0]))
    return sorted(out, key=repr)


def found(spark, data, steps, **kwargs):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    symbols = {s: F.col("s") == s for s in ("a", "b", "c", "x")}
    got = match_pattern(df, ["k"], "ts", "id", symbols, steps, **kwargs)
    assert got.columns == ["k", "start_id", "end_id", "start_ts", "end_ts"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("steps", PATTERNS)
def test_every_pattern_equals_its_expression(spark, steps):
    rows = events()
    wanted = plain(rows, steps)
    assert wanted
    # a chunk holds a second at least: some a few rows, some all of a key
    assert found(spark, rows, steps, rows=8) == wanted


@pytest.mark.parametrize("size", [1, 40, 100_000])
def test_chunks_change_nothing(spark, size):
    rows = events(300, 9)
    assert found(spark, rows, PATTERNS[0], rows=size, within_seconds=4) == plain(rows, PATTERNS[0], 4)


def test_a_match_may_span_many_chunks(spark):
    rows = [(1, BEGIN + timedelta(seconds=i), i, "b") for i in range(1, 200)]
    rows += [(1, BEGIN, 0, "a"), (1, BEGIN + timedelta(seconds=300), 300, "c")]
    assert [r[1:3] for r in found(spark, rows, PATTERNS[0], rows=1)] == [(0, 300)]
    assert found(spark, rows, PATTERNS[0], rows=1, within_seconds=299) == []


def test_no_rows_and_odd_patterns(spark):
    assert found(spark, [], PATTERNS[0]) == []
    for steps in ([], [("a", "*")], [("z", "1")], [("a", "2")]):
        with pytest.raises(ValueError):
            Automaton(steps, ["a"])


def test_starts_inside_a_run_decide_alone():
    automaton = Automaton([("a", "1"), ("b", "*")], ["a", "b", "x"])
    run = automaton.begin()
    # before any start, what ends here depends on the states the chunk is entered with
    assert automaton.read(run, 1, (1, 1)) == (None, 0b11)
    assert automaton.read(run, 0, (2, 2)) == ((2, 2), 0)
    assert automaton.read(run, 1, (3, 3)) == ((2, 2), 0)
    assert automaton.read(run, 2, (4, 4)) is None and run == [(None, 0)] * 2
