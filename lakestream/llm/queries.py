"""The operators over their whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.llm import (
    chat,
    exact_dedup,
    hard_negatives,
    mixing,
    near,
    packing,
    pii,
    quality,
    resampling,
    secrets,
    token_counts,
    toxicity,
    winnowing,
)
from lakestream.llm.common import documents, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir), labels(spark, sf_dir))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS bound FROM s),
r AS (SELECT *, CAST(bound AS DOUBLE) / weight AS ratio FROM w),
u AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(bound) OVER o AS BIGINT), 0) AS DOUBLE) / CAST(sum(weight) OVER l AS BIGINT) AS unit FROM r
  WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT arg_min(unit, ratio) AS unit FROM u WHERE ratio > unit),
t AS (SELECT source, source_size, CASE WHEN weight > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lead, CASE WHEN u.ratio <= k.unit OR k.unit IS NULL THEN CAST(bound AS DOUBLE) ELSE weight * k.unit END AS target FROM u, k),
h AS (SELECT *, CASE WHEN whole > 0 THEN target / whole ELSE 0.0::DOUBLE END AS share FROM t, (SELECT list_reduce(list(target ORDER BY source IS NULL, source), lambda a, b: a + b) AS whole FROM t)),
g AS (SELECT *, lead - (SELECT list_reduce(list(share * lead ORDER BY source IS NULL, source), lambda a, b: a + b) FROM h) AS gap FROM h),
c AS (SELECT *, share * (1.0::DOUBLE + 0.5::DOUBLE * gap) AS early, share * (1.0::DOUBLE - 0.5::DOUBLE * gap) AS late FROM g),
p AS (SELECT d.*, source_size, target, share, early, late, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CASE WHEN source_size > 0 THEN least(3, CAST(floor(floor(target) / source_size) AS BIGINT)) ELSE 0 END AS passes FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
n AS (SELECT *, CAST(passes * size + greatest(least(CAST(floor(target) AS BIGINT) - passes * source_size - before, size), 0) AS BIGINT) AS taken, CASE WHEN target > 0 THEN before::DOUBLE / target * share ELSE 0.0::DOUBLE END AS need FROM p),
z AS (SELECT *, sqrt(greatest(early * early + 2.0::DOUBLE * (late - early) * need, 0.0::DOUBLE)) AS root FROM n)
SELECT doc_id, size, source_size, source, target, taken, CASE WHEN taken > 0 THEN CASE WHEN early + root > 0 THEN least(2.0::DOUBLE * need / (early + root), 1.0::DOUBLE) ELSE 0.0::DOUBLE END END AS position FROM z
"""


@query("op2_source_mixing", MIX_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


CHAT_SQL = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM r),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(role := role, text := text) ORDER BY turn NULLS LAST, role NULLS FIRST, sha256(text) NULLS FIRST) AS turns FROM o GROUP BY conv_id, own),
m AS (SELECT row_number() OVER () AS mid, CASE WHEN count(*) = count(conv_id) THEN min(conv_id) END AS conv_id, n, turns FROM c GROUP BY n, turns),
k AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.n > a.n AND b.turns[1:a.n] = a.turns)),
e AS (SELECT mid, conv_id, n, unnest(range(1, n + 1)) AS i, unnest(turns) AS t FROM k)
SELECT conv_id, CAST((i - 1) // 256 AS BIGINT) AS part, CAST(n AS BIGINT) AS n_turns,
  string_agg('<|im_start|>' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM e GROUP BY mid, conv_id, n, (i - 1) // 256
"""


@query("op3_chat_snapshots", CHAT_SQL)
def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


COPIES_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256 FROM d
"""


@query("op4_exact_dedup", COPIES_SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(documents(spark, sf_dir))


def _secret_sql() -> str:
    """Per kind, gaps and matches alternate; running lengths are offsets. Then the same counts by owner."""
    parts = []
    for rank, (kind, pattern, _, group, least) in enumerate(secrets.KINDS):
        quoted = pattern.replace("'", "''").replace("\\x20", " ")
        value = f"regexp_extract(m, '{quoted}', {group})"
        kept = f"length(value) >= {least}"
        if kind == "mixed":
            kept += " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')"
        parts.append(
            f"SELECT rid, {rank} AS rank, '{kind}' AS kind, stop - length(m) AS start, stop, value FROM (SELECT rid, m, {value} AS value,"
            f" sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM (SELECT rid, unnest(regexp_extract_all(text, '(?s)(.*?)({quoted})', 1)) AS g,"
            f" unnest(regexp_extract_all(text, '(?s)(.*?)({quoted})', 2)) AS m, unnest(range(len(regexp_extract_all(text, '{quoted}')))) AS i FROM d))"
            f" WHERE {kept}"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
apart AS (SELECT * FROM found f WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.rid = f.rid AND b.rank < 3 AND b.start < f.stop AND f.start < b.stop)),
own AS (SELECT value, count(DISTINCT coalesce('s' || source, '')) AS n_owners, count(DISTINCT (coalesce('s' || source, ''), text)) AS n_repos FROM apart JOIN d USING (rid) GROUP BY value),
judged AS (SELECT apart.*, n_owners < 3 AS live, n_owners >= 3 AS shared, n_repos FROM apart JOIN own USING (value)),
joined AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3 OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (shared) AS n_shared, max(n_repos) AS most_repos FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(most_repos, 0) AS most_repos FROM d LEFT JOIN joined USING (rid)
"""


@query("op5_secret_ownership", _secret_sql())
def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "class_size", "kept")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


#: Lower-cased A-Z and the words of a text, as a list.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
o AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT rid, p, o.n, item FROM o JOIN i ON o.n = i.n AND o.s = i.s),
x AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
y AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)
"""


@query("op11_decontamination", LEAKS_SQL)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


RESAMPLING_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
o AS (SELECT rid, unnest(w) AS word FROM d),
b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(1, length(hx), 2), lambda p: CAST('0x' || substr(hx, CAST(p AS INT), 2) AS BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM o UNION SELECT word FROM b)), crc),
s AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM o) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), n),
m AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS total FROM o JOIN v USING (word) JOIN g USING (bucket) GROUP BY rid),
f AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CASE WHEN len(w) = 0 THEN 0 ELSE (total - (total % len(w) + len(w)) % len(w)) // len(w) END AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (rid)),
e AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM f),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_words, weight) AS rank, count(*) OVER () AS fit FROM e WHERE n_words >= 20)
SELECT doc_id, n_words, n_words AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN rank <= 10 * fit // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (rid)
"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resampling(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


NEGATIVES_SQL = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other, c.rid AS crid, CAST(coalesce(list_inner_product(a.v, c.v), 0) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.rid <> c.rid),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other NULLS LAST, crid) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor, place ORDER BY s.score DESC, s.other NULLS LAST, s.crid) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
