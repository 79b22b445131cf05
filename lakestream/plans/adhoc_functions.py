"""Ad-hoc SQL over the tables: scalar functions, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.plans.registry import query
from lakestream.session import load


@query(
    "fn_string",
    r"""SELECT doc_id, upper(lang) AS lang, lower(source) || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS label, length(text) AS chars,
      len(string_split(text, chr(10))) AS lines, len(string_split(text, ' ')) AS words, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked,
      md5(replace(trim(text, ' '), ' ', '')) AS packed, CAST(instr(text, 'e') AS INT) AS first_e, regexp_extract(source, '([0-9]+)$', 1) AS source_number FROM documents""",
)
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        F.upper("lang").alias("lang"),
        F.concat_ws("-", F.lower("source"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("label"),
        F.length(text).cast("long").alias("chars"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("lines"),
        F.size(F.split(text, " ", -1)).cast("long").alias("words"),
        F.md5(F.regexp_replace(text, "[0-9]+", "#")).alias("masked"),
        F.md5(F.replace(F.trim(text), F.lit(" "), F.lit(""))).alias("packed"),
        F.instr(text, "e").alias("first_e"),
        F.regexp_extract("source", "([0-9]+)$", 1).alias("source_number"),
    )


@query(
    "fn_date",
    """SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, CAST(o_orderdate + INTERVAL 45 DAY AS DATE) AS due,
      date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS age, CAST(extract(quarter FROM o_orderdate) AS INT) AS quarter,
      CAST(extract(week FROM o_orderdate) AS INT) AS week, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, last_day(o_orderdate) AS month_end,
      epoch_us(o_orderdate) AS micros, strftime(o_orderdate, '%Y/%m/%d') AS text FROM orders""",
)
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_trunc("month", at).cast("timestamp_ntz").alias("month"),
        F.date_add(at.cast("date"), 45).alias("due"),
        F.datediff(F.lit("2002-01-01").cast("date"), at.cast("date")).cast("long").alias("age"),
        F.quarter(at).alias("quarter"),
        F.weekofyear(at).alias("week"),
        F.weekday(at).alias("weekday"),
        F.last_day(at.cast("date")).alias("month_end"),
        F.unix_micros(at.cast("timestamp")).alias("micros"),
        F.date_format(at, "yyyy/MM/dd").alias("text"),
    )


@query(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice)::BIGINT AS low, ceil(l_extendedprice)::BIGINT AS high,
      CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS rounded, sqrt(l_quantity) AS root, floor(ln(l_extendedprice) * 1000000)::BIGINT AS log_micro,
      ((l_partkey - 700) % 7 + 7) % 7 AS residue, least(greatest(floor((l_extendedprice - 0) / (100000 - 0) * 20) + 1, 0), 21)::BIGINT AS bucket, abs(l_discount - 0.05) AS off FROM lineitem""",
)
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.floor(price).alias("low"),
        F.ceil(price).alias("high"),
        F.round(price.cast("decimal(18,2)"), 1).cast("double").alias("rounded"),
        F.sqrt("l_quantity").alias("root"),
        F.floor(F.ln(price) * 1_000_000).alias("log_micro"),
        F.pmod(F.col("l_partkey") - 700, F.lit(7)).cast("long").alias("residue"),
        F.width_bucket(price, F.lit(0.0), F.lit(100_000.0), F.lit(20)).alias("bucket"),
        F.abs(F.col("l_discount") - F.lit(0.05)).alias("off"),
    )


@query(
    "fn_array",
    """SELECT vec_id, len(embedding) AS size, list_max(embedding)::DOUBLE AS top, list_position(embedding, list_max(embedding))::BIGINT AS top_at,
      len(list_filter(embedding, lambda x: x > 0)) AS positive,
      list_sum(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)))::BIGINT AS milli_sum,
      list_sort(list_distinct(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 10) AS BIGINT)))) AS tenths FROM embeddings""",
)
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("embedding")

    def scaled(factor: int):
        return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))

    return load(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(vector).cast("long").alias("size"),
        F.array_max(vector).cast("double").alias("top"),
        F.array_position(vector, F.array_max(vector)).alias("top_at"),
        F.size(F.filter(vector, lambda x: x > 0)).cast("long").alias("positive"),
        F.aggregate(scaled(1000), F.lit(0).cast("long"), lambda a, x: a + x).alias("milli_sum"),
        F.sort_array(F.array_distinct(scaled(10))).alias("tenths"),
    )


@query(
    "fn_unnest",
    """SELECT lang, length(word) AS letters, count(*) AS n, count(*) FILTER (WHERE contains(word, 'e')) AS with_e
      FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2""",
)
def fn_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ", -1)).alias("word"))
    return words.filter("word <> ''").groupBy("lang", F.length("word").cast("long").alias("letters")).agg(
        F.count("*").alias("n"), F.count_if(F.contains("word", F.lit("e"))).alias("with_e")
    )


@query(
    "fn_map",
    """SELECT conv_id, turn, 'role=' || role || ';chars=' || length(text) AS tags, CAST(length(text) AS VARCHAR) AS chars FROM conversations""",
)
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.map_from_entries(
        F.array(
            F.struct(F.lit("role").alias("key"), F.col("role").alias("value")),
            F.struct(F.lit("chars").alias("key"), F.length("text").cast("string").alias("value")),
        )
    )
    pairs = F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return (
        load(spark, sf_dir, "conversations")
        .withColumn("tags", tags)
        .select("conv_id", "turn", F.array_join(F.sort_array(pairs, False), ";").alias("tags"), F.col("tags")["chars"].alias("chars"))
    )


@query(
    "fn_json",
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k_next,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_variant, json_extract_string(props, '$.missing') AS missing FROM events""",
)
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k_text"),
        (F.from_json("props", "k long")["k"] + 1).alias("k_next"),
        F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k_variant"),
        F.get_json_object("props", "$.missing").alias("missing"),
    )


@query("sample_hash", "SELECT event_id, user_id FROM events WHERE md5(CAST(event_id AS VARCHAR)) < '1a'")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a tenth of the rows, the same ones on every run and layout."""
    return load(spark, sf_dir, "events").filter(F.md5(F.col("event_id").cast("string")) < "1a").select("event_id", "user_id")


@query(
    "sample_seeded",
    "SELECT event_type, count(*) AS n, true AS size_within, true AS all_in_table FROM events GROUP BY 1",
)
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows drawn at random, described per event type: within six standard deviations, and rows of the table."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    drawn = events.sample(fraction=0.1, seed=7).withColumn("drawn", F.lit(1))
    sizes = drawn.groupBy("event_type").agg(F.count("*").alias("size"))
    found = events.join(drawn.select("event_id", "drawn"), "event_id", "left").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("drawn").alias("found")
    )
    described = found.join(sizes, "event_type", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    near = F.abs(F.col("size") - F.col("n") * 0.1) <= 6 * F.sqrt(F.col("n") * 0.09) + 1
    return described.select("event_type", "n", near.alias("size_within"), (F.col("size") == F.col("found")).alias("all_in_table"))
