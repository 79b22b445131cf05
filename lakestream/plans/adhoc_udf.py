"""User-defined functions, aggregates and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.functions.udf import Ngrams, digit_sum, geometric_mean
from lakestream.plans.fixtures import HOLES_SQL, holey_events
from lakestream.plans.registry import query
from lakestream.session import load


@query(
    "udf_scalar",
    """SELECT event_id, CASE WHEN event_id % 83 <> 0 THEN list_sum(list_transform(string_split(CAST(event_id * 7919 AS VARCHAR), ''), lambda d: CAST(d AS BIGINT)))::BIGINT END AS digits FROM events""",
)
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id")
    number = F.when(F.col("event_id") % 83 != 0, F.col("event_id") * 7919)
    return events.select("event_id", digit_sum(number).alias("digits"))


@query(
    "udaf_geo_mean",
    f"""WITH {HOLES_SQL}, k AS (SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, value FROM e)
      SELECT event_type, floor(exp(avg(ln(value + 1))) * 1000)::BIGINT AS geo_mean_milli FROM k GROUP BY 1""",
)
def udaf_geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type")
    events = holey_events(spark, sf_dir).select(kind, (F.col("value") + 1).alias("value"))
    means = geometric_mean(events, "event_type", "value")
    return means.select("event_type", F.floor(F.col("geo_mean") * 1000).alias("geo_mean_milli"))


@query(
    "udtf_ngrams",
    """WITH w AS (SELECT role, string_split(text, ' ') AS p FROM conversations),
      g AS (SELECT role, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) AS ngram FROM w)
      SELECT role, ngram, count(*) AS n FROM g GROUP BY 1, 2""",
)
def udtf_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("role", "text")
    return Ngrams(turns.asTable(), F.lit(2)).groupBy("role", "ngram").agg(F.count("*").alias("n"))
