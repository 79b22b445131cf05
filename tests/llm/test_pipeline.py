"""The pipeline stage by stage, its queries' registration, and plans of the native operators."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lakestream.llm import exact_dedup, mixing, near, packing, queries, toxicity
from tests.llm.conftest import TRICKY
from tests.llm.test_dedup import brute_links
from tools.compare import compare, connect

NATIVE = ("op2_source_mixing", "op4_exact_dedup", "op5_secret_ownership")


def test_registration():
    names = set(queries.QUERIES) | {"pipeline"}
    assert names <= set(entry.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert {n.split("_")[0] for n in queries.ORACLES} == {f"op{i}" for i in (2, 3, 4, 5, 11, 12, 13)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "source_mixing", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), name, sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, frames[-1], sf_dir)
        assert kept.columns == docs.columns
        frames.append(kept.checkpoint())
    texts = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames]
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert set(texts[1]) == {r["doc_id"] for r in scores if not r["predicted"]}

    first = {}
    for i in sorted(texts[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[1][i]), i)
    assert set(texts[2]) == set(first.values())

    _, classes = brute_links(texts[2])
    assert set(texts[3]) == set(classes.values())
    assert set(texts[4]) <= set(texts[3])

    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    rows = Counter(r["doc_id"] for r in frames[4].collect())
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == rows
    total = sum(p["length"] for p in pieces)
    assert len({p["sequence_id"] for p in pieces}) == -(-total // 2048)


def test_sequences_follow_the_training_order(spark, sf_dir, tmp_path):
    """Written as eight files of very unequal size and read again, rows still are packed by position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    position = {r["doc_id"]: r["position"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    wanted = [r["doc_id"] for r in mixed.collect()]
    first_turns = [position[i] for i in dict.fromkeys(wanted)]
    assert first_turns == sorted(first_turns)
    place = F.monotonically_increasing_id()
    rows = mixed.withColumn("_at", place).checkpoint()
    numbered = {r["_at"]: n for n, r in enumerate(rows.select("_at").sort("_at").collect())}
    ends = [len(numbered) * f // 100 for f in (1, 2, 4, 8, 16, 90, 95, 100)]
    cuts = sorted(numbered)
    for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        part = rows.filter(F.col("_at").between(cuts[a], cuts[b - 1]) if b > a else F.lit(False))
        part.sort("_at").coalesce(1).drop("_at").write.parquet(f"{tmp_path}/one-{i}")
    folder = tmp_path / "all"
    folder.mkdir()
    for i in range(8):
        for n, file in enumerate(sorted((tmp_path / f"one-{i}").glob("part-*"))):
            (folder / f"part-{i:05d}-{n}.parquet").write_bytes(file.read_bytes())
    scan = spark.read.parquet(str(folder))
    path = corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")
    for source in (scan, scan.filter("length(text) >= 0"), mixed):
        pieces = packing.packed(source, path).filter("start = 0").sort("sequence_id", "offset").collect()
        assert [p["doc_id"] for p in pieces] == wanted


def test_stages_with_tricky_rows(spark, tricky, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs, n in ((tricky, len(TRICKY)), (nothing, 0)):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path)).checkpoint()
        assert (rows.count() > 0) == (n > 0)
        assert near.one_per_class(docs).columns == exact_dedup.without_copies(docs).columns == docs.columns
        assert packing.packed(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).count() >= n
