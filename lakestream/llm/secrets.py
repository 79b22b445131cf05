"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern in every text. Their hashes are counted over the whole corpus, by distinct
repositories (different texts of an owner, so a copied document is no further one) and distinct owners (sources): a
value that many owners hold is a copied example, any other one looks live. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestream.llm.common import filled, saved

# The base patterns, letters of the key names in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The last kind is the method's own: long mixed runs, kept only when their ownership looks live.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
#: kind, pattern, a cheaper pattern that every kept match contains, group with the value, shortest value
KINDS = (
    ("assign", ASSIGN, ASSIGN, 2, 12),
    ("access", ACCESS, r"AKIA[A-Z0-9]{14}", 0, 18),
    ("hex", HEX, r"[0-9a-f]{16}", 0, 16),
    ("mixed", MIXED, r"[A-Za-z0-9+/_-]{20}", 0, 20),
)
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, quick: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs; matches with a short value are dropped, not retried.

    Each hit is what lies between two matches plus the match (``\\G`` ties it to the end of the last one), so
    lengths add up to offsets in code points.
    """
    hits = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))

    def add(state: Column, hit: Column) -> Column:
        end = state["at"] + F.length(hit)
        start = end - F.length(F.regexp_extract(hit, pattern, 0))
        value = F.regexp_extract(hit, pattern, group)
        span = F.struct(
            start.cast("long").alias("start"),
            F.lit(rank).alias("rank"),
            end.cast("long").alias("end"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
        )
        found = F.when(F.length(value) >= least, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct(end.cast("long").alias("at"), F.concat(state["spans"], found).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(quick), F.aggregate(hits, start, add, lambda s: s["spans"])).otherwise(none)


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners`` of candidates ``(hash, owner, repo)``; a null owner is an owner.

    Counted from distinct (hash, owner, repo) upwards, with partial sums, so a value that is everywhere is
    summed up before it is shuffled by its hash alone.
    """
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, shared_owners: int = 3) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, most_repos``.

    Base spans are those of the first three kinds. The method adds spans of kind ``mixed``: runs of 20 or more
    characters with small and capital letters and digits that do not touch a base span and look live. A value
    is shared if ``shared_owners`` or more owners hold it, and live otherwise, however many copies there are;
    ``n_live`` and ``n_shared`` count a document's candidates of either sort, and ``most_repos`` is in how many
    repositories the most copied of them is. Null counts as an empty text,
    which has no span; a null source is an owner; repeated rows are rows of their own, but one repository. An
    empty table gives no rows. Other columns are ignored.
    """
    text = filled(F.col("text"))
    base = [spans_of(text, i, *k) for i, k in enumerate(KINDS[:3])]
    mixed = F.filter(
        spans_of(text, 3, *KINDS[3]),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"),
    )
    found = docs.select("doc_id", F.col("source").alias("owner"), F.md5(text).alias("repo"), F.concat(*base).alias("base"), mixed.alias("mixed"))
    apart = F.filter(
        "mixed", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    hashed = F.transform(
        F.concat("base", apart),
        lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], F.sha2(s["value"], 256).alias("hash")),
    )
    repo = F.when(F.size("spans") > 0, F.col("repo")).alias("repo")
    rows = found.withColumn("spans", hashed).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", repo, "spans")
    rows = saved(rows, "secrets")
    each = rows.select("row_id", "doc_id", "owner", "repo", F.explode("spans").alias("span"))
    each = each.withColumn("hash", F.col("span.hash"))
    known = ownership(each.select("hash", "owner", "repo"))
    judged = each.join(known, "hash").select(
        "row_id",
        "doc_id",
        F.struct("span.start", "span.rank", "span.end", "span.kind").alias("span"),
        (F.col("n_owners") < shared_owners).alias("live"),
        (F.col("n_owners") >= shared_owners).alias("shared"),
        "n_repos",
    )
    judged = judged.groupBy("row_id", "doc_id").agg(
        F.array_sort(F.collect_list(F.when((F.col("span.rank") < 3) | F.col("live"), F.col("span")))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if("shared").alias("n_shared"),
        F.max("n_repos").alias("most_repos"),
    )
    none = F.array().cast(judged.schema["spans"].dataType)
    zero = F.lit(0).cast("long")
    bare = rows.filter(F.size("spans") == 0).select(
        "row_id", "doc_id", none.alias("spans"), zero.alias("n_live"), zero.alias("n_shared"), zero.alias("most_repos")
    )
    every = judged.unionByName(bare)
    counts = [
        F.size(F.filter("spans", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS[:3]
    ]
    only_base = F.filter("spans", lambda s: s["rank"] < 3)
    return every.select(
        "doc_id",
        *counts,
        F.sha2(joined_spans(only_base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
        "n_live",
        "n_shared",
        "most_repos",
    )
