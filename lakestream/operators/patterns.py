"""Row patterns over long ordered groups: an automaton whose runs over chunks are composed.

A pattern is a sequence of steps, each a symbol with a quantifier. Its automaton has one state per step, "this
step was matched last", and a state holds the latest row a match in progress began with. Reading rows is linear in that:
a run over some rows is, for each state, the latest start among the rows, or else the set of states that lead here from
before them. Runs compose, so a key's rows are cut into chunks, every chunk is read once and alone, and only the
runs (one small row per chunk) are put together in the order of the chunks. Matches that began in an earlier chunk wait
for the state their chunk is entered with.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.operators.ordered import CHUNK_ROWS, MICROS, micros, null_safe_join, packed
from lakestream.session import work_dir

#: Quantifier: may the step be left out, may it repeat.
QUANTIFIERS = {"1": (False, False), "?": (True, False), "*": (True, True), "+": (False, True)}
#: States fit into the bits of a long.
MOST_STEPS = 60

#: A state of a run: the latest start inside it (time and tie, or None), or the entry states it is reached from, as bits.
State = tuple[tuple[int, int] | None, int]


class Automaton:
    """Steps as transitions between states; state ``i`` says that step ``i`` was matched last."""

    def __init__(self, steps: Sequence[tuple[str, str]], symbols: Sequence[str]):
        if not 0 < len(steps) <= MOST_STEPS or any(s not in symbols or q not in QUANTIFIERS for s, q in steps):
            raise ValueError(f"a pattern is 1 to {MOST_STEPS} known symbols with quantifiers {' '.join(QUANTIFIERS)}")
        self.size = len(steps)
        skips, repeats = zip(*[QUANTIFIERS[q] for _, q in steps], strict=True)
        if all(skips):
            raise ValueError("a pattern needs a step that cannot be left out")
        # by symbol: the steps it can take, whether a match may begin with them, and the states that lead to them
        self.moves: list[list[tuple[int, bool, list[int]]]] = [[] for _ in symbols]
        for j, (symbol, _) in enumerate(steps):
            sources = [i for i in range(j) if all(skips[i + 1 : j])] + [j] * repeats[j]
            self.moves[symbols.index(symbol)].append((j, all(skips[:j]), sources))
        self.accepts = [i for i in range(self.size) if all(skips[i + 1 :])]

    def begin(self) -> list[State]:
        """The run over no rows: each state comes from itself."""
        return [(None, 1 << i) for i in range(self.size)]

    def read(self, run: list[State], symbol: int, row: tuple[int, int]) -> State | None:
        """Read a row into ``run`` and return what it ends, if it may end a match.

        A start inside the run is later than any from before it, so it decides alone.
        """
        fresh: list[State] = [(None, 0)] * self.size
        for j, starts, sources in self.moves[symbol]:
            fresh[j] = (row, 0) if starts else merged(run[i] for i in sources)
        run[:] = fresh
        ended = merged(fresh[i] for i in self.accepts)
        return ended if ended != (None, 0) else None


def merged(states: Iterator[State]) -> State:
    best, mask = None, 0
    for start, before in states:
        if start is not None and (best is None or start > best):
            best = start
        mask |= before
    return (best, 0) if best is not None else (None, mask)


_POINT = pa.struct([("at", pa.int64()), ("tie", pa.int64())])
_RUN = pa.list_(pa.struct([("at", pa.int64()), ("tie", pa.int64()), ("mask", pa.int64())]))
_FOUND = "end_at long, end_tie long, start_at long, start_tie long, mask long, run array<struct<at:long,tie:long,mask:long>>"


def _rows(batch: pa.RecordBatch, keys: Sequence[str], at: list[int], ends: list, found: list, runs: list) -> pa.RecordBatch:
    """Output rows: the key columns of the input rows ``at``, and what was found there."""
    starts = [None if f is None else f[0] for f in found]
    columns = [
        *[batch.column(k).take(pa.array(at, pa.int64())) for k in keys],
        *[pa.array([None if e is None else e[i] for e in ends], pa.int64()) for i in (0, 1)],
        *[pa.array([None if s is None else s[i] for s in starts], pa.int64()) for i in (0, 1)],
        pa.array([None if f is None else f[1] for f in found], pa.int64()),
        pa.array([None if r is None else [{"at": s and s[0], "tie": s and s[1], "mask": m} for s, m in r] for r in runs], _RUN),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "end_at", "end_tie", "start_at", "start_tie", "mask", "run"])


def _read_chunks(batches: Iterator[pa.RecordBatch], automaton: Automaton, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows that end a match, and each chunk's run after its last row; chunks follow each other."""
    run, before = None, None
    for batch in batches:
        at, ends, found, runs = [], [], [], []
        read = [batch.column(c).to_pylist() for c in ("_first", "_symbol", "_at", "_tie")]
        for i, (first, symbol, *row) in enumerate(zip(*read, strict=True)):
            if first:
                if run is not None and i:
                    at, ends, found, runs = [*at, i - 1], [*ends, None], [*found, None], [*runs, run]
                elif run is not None:
                    yield _rows(before, keys, [0], [None], [None], [run])
                run = automaton.begin()
            row = tuple(row)
            if (match := automaton.read(run, symbol, row)) is not None:
                at.append(i)
                ends.append(row)
                found.append(match)
                runs.append(None)
        yield _rows(batch, keys, at, ends, found, runs)
        if batch.num_rows:
            before = batch.slice(batch.num_rows - 1, 1)
    if run is not None:
        yield _rows(before, keys, [0], [None], [None], [run])


def _enter_chunks(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The start each state has where a chunk is entered, from the runs of the chunks before it."""
    held: list = []
    for batch in batches:
        entries = []
        for first, run in zip(batch.column("_first").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if first:
                held = [None] * len(run)
            entries.append([s and {"at": s[0], "tie": s[1]} for s in held])
            held = [
                (r["at"], r["tie"]) if r["at"] is not None
                else max((s for i, s in enumerate(held) if s and r["mask"] >> i & 1), default=None)
                for r in run
            ]
        columns = [*[batch.column(k) for k in keys], pa.array(entries, pa.list_(_POINT))]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "entry"])


def match_pattern(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    symbols: dict[str, Column],
    steps: Sequence[tuple[str, str]],
    within_seconds: int | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Matches of a row pattern: ``keys, start_<tie>, end_<tie>, start_<ts>, end_<ts>``.

    ``symbols`` names conditions, of which the first that holds is the row's symbol; a row without one is passed over, and
    one whose symbol no step can take breaks what is in progress. ``steps`` are pairs of a symbol and a
    quantifier (``1``, ``?``, ``*``, ``+``). Each row that ends a match gives one, with the latest start it
    can have; ``within_seconds`` bounds its length. Rows follow ``ts``, then ``tie``, a whole number unique in the key.
    A null key is a key; rows without a time or ``tie`` are in no order and take no part.
    """
    spark, automaton = df.sparkSession, Automaton(steps, list(symbols))
    symbol = F.lit(None).cast("int")
    for code, condition in reversed(list(enumerate(symbols.values()))):
        symbol = F.when(condition, code).otherwise(symbol)
    read = df.select(*keys, micros(F.col(ts)).alias("_at"), F.col(tie).cast("long").alias("_tie"), symbol.alias("_symbol"))
    # rows without a symbol go before anything is shuffled
    read = read.filter(F.col("_symbol").isNotNull() & F.col("_at").isNotNull() & F.col("_tie").isNotNull())
    places = [*keys, "_chunk"]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _chunk long, "

    # a window leaves each of its groups in order in one partition
    inside = Window.partitionBy(*places).orderBy("_at", "_tie")
    chunks = packed(read, keys, F.col("_at"), rows=rows).withColumn("_first", F.row_number().over(inside) == 1)
    found = chunks.mapInArrow(lambda batches: _read_chunks(batches, automaton, places), kinds + _FOUND)
    # chunks are read once: their runs are needed before the matches are whole
    path = work_dir(spark, "pattern-runs")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)

    runs = found.filter("run IS NOT NULL").select(*places, "run")
    in_order = Window.partitionBy(*keys).orderBy("_chunk")
    runs = runs.withColumn("_first", F.row_number().over(in_order) == 1)
    entries = runs.mapInArrow(lambda b: _enter_chunks(b, places), kinds + "entry array<struct<at:long,tie:long>>")
    entries = entries.filter(F.exists("entry", lambda s: s.isNotNull()))

    waiting = null_safe_join(found.filter("mask != 0"), entries, places)
    bit = lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1
    start = F.array_max(F.transform("entry", lambda s, i: F.when(bit(i), s)))
    ends = [*keys, "end_at", "end_tie"]
    resolved = waiting.withColumn("_start", start).select(*ends, F.col("_start.at").alias("start_at"), F.col("_start.tie").alias("start_tie"))
    whole = found.select(*ends, "start_at", "start_tie").unionByName(resolved).filter("start_at IS NOT NULL")
    if within_seconds is not None:
        whole = whole.filter(F.col("end_at") - F.col("start_at") <= within_seconds * MICROS)
    time = lambda c: F.timestamp_micros(c).cast(df.schema[ts].dataType)
    return whole.select(
        *keys,
        F.col("start_tie").alias(f"start_{tie}"),
        F.col("end_tie").alias(f"end_{tie}"),
        time("start_at").alias(f"start_{ts}"),
        time("end_at").alias(f"end_{ts}"),
    )
