"""Schema governance over a table of versions ``(subject, version, field, type, nullable, has_default)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.functions.naming import DEFAULT_COMPATIBILITY, value_subject
from lakestream.operators.errors import Check
from lakestream.operators.ordered import null_safe_join

# Type a reader may use for data written with another type.
PROMOTIONS = {
    "int": ("long", "float", "double"),
    "long": ("float", "double"),
    "float": ("double",),
    "string": ("bytes",),
    "bytes": ("string",),
}


# Levels a subject may have.
LEVELS = ("BACKWARD", "FORWARD", "FULL", "NONE")


def readable(written: Column, reader: Column) -> Column:
    """Can a reader of one type read data written with the other?"""
    ok = written == reader
    for source, targets in PROMOTIONS.items():
        ok = ok | ((written == source) & reader.isin(*targets))
    return ok


def effective_level(subject_level: Column, layer_level: Column) -> Column:
    return F.coalesce(subject_level, layer_level, F.lit(DEFAULT_COMPATIBILITY))


def backward_rule(old: Column, new: Column) -> Column:
    """Why the new form of a field cannot read data written with the old one; null when it can."""
    return (
        F.when(old.isNull(), F.when(~new["has_default"], "added without default"))
        .when(new.isNull(), F.lit(None))
        .when(~readable(old["type"], new["type"]), "type not readable")
        .when(old["nullable"] & ~new["nullable"], "null not readable")
    )


def forward_rule(old: Column, new: Column) -> Column:
    """Why the old form of a field cannot read data written with the new one; null when it can."""
    return (
        F.when(new.isNull(), F.when(~old["has_default"], "removed without default"))
        .when(old.isNull(), F.lit(None))
        .when(~readable(new["type"], old["type"]), "type not readable by old")
        .when(~old["nullable"] & new["nullable"], "null not readable by old")
    )


def _violations(rule, old: Column, new: Column) -> Column:
    """``field:reason`` of every field of either version (maps by name) that breaks a rule."""
    none = F.lit(None).cast("struct<field: string, type: string, nullable: boolean, has_default: boolean>")

    def reason(name: Column, before: Column, after: Column) -> Column:
        return F.concat(name, F.lit(":"), rule(before, after))

    present = F.transform(F.map_values(new), lambda f: reason(f["field"], F.try_element_at(old, f["field"]), f))
    gone = F.filter(F.map_values(old), lambda f: ~F.map_contains_key(new, f["field"]))
    removed = F.transform(gone, lambda f: reason(f["field"], f, none))
    return F.array_compact(F.concat(present, removed))


def check_compat(versions: DataFrame, levels: DataFrame, width: int = 4096) -> DataFrame:
    """Check each version of a subject against the one before it, by the subject's ``level``.

    BACKWARD: the new schema reads old data; FORWARD: the old schema reads new data; FULL: both; NONE: always
    passes. A subject without a level gets the default one; a level that is none of these is an error.
    ``violations`` lists ``field:rule`` pairs of the rules the level asks for.

    Fields are shuffled once, by subject and run of ``width`` versions; a run is gathered into one row per
    version, whose size is the number of its fields. The last version of a run is handed to the next run.
    """
    run = ["subject", "_run"]
    field = F.struct("field", "type", "nullable", "has_default")
    documents = (
        versions.withColumn("_run", F.floor(F.col("version") / F.lit(width)).cast("long"))
        .repartition(*run)
        .groupBy(*run, "version")
        # a map once per version, which the rules look names up in
        .agg(F.map_from_entries(F.collect_list(F.struct("field", field))).alias("new"))
    )
    inside = Window.partitionBy(*run).orderBy("version")
    linked = documents.withColumns(
        {"_old": F.lag("new").over(inside), "_is_last": F.lead("version").over(inside).isNull()}
    )
    across = Window.partitionBy("subject").orderBy("_run")
    handed = linked.filter("_is_last").select(*run, F.lag("new").over(across).alias("_handed"))
    pairs = (
        null_safe_join(linked, handed.filter("_handed IS NOT NULL"), run, "left")
        .withColumn("old", F.coalesce("_old", "_handed"))
        .filter("old IS NOT NULL")
    )
    known = F.coalesce("level", F.lit(DEFAULT_COMPATIBILITY))
    unknown = F.raise_error(F.concat(F.lit("unknown compatibility level: "), known)).cast("string")
    levelled = pairs.join(levels.select("subject", "level"), "subject", "left").withColumn(
        "level", F.when(known.isin(*LEVELS), known).otherwise(unknown)
    )
    old, new, level = F.col("old"), F.col("new"), F.col("level")
    nothing = F.array().cast("array<string>")
    asked = F.concat(
        F.when(level.isin("BACKWARD", "FULL"), _violations(backward_rule, old, new)).otherwise(nothing),
        F.when(level.isin("FORWARD", "FULL"), _violations(forward_rule, old, new)).otherwise(nothing),
    )
    return (
        levelled
        .select("subject", "version", "level", F.array_join(F.sort_array(asked), ", ").alias("violations"))
        .withColumn("ok", F.col("violations") == "")
    )


def latest_schema(topics: DataFrame, versions: DataFrame) -> DataFrame:
    """Latest version and its fields per topic; ``schema_found`` is false for a topic without a subject."""
    newest = versions.groupBy("subject").agg(F.max("version").alias("version"))
    fields = (
        null_safe_join(versions, newest, ["subject", "version"], "left_semi")
        .groupBy("subject", "version")
        .agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "field", "type"))), ", ").alias("fields"))
    )
    return (
        topics.withColumn("subject", value_subject(F.col("topic")))
        .join(fields, "subject", "left")
        .withColumn("schema_found", F.col("version").isNotNull())
    )


def field_violations(schema: dict[str, tuple[str, bool]]) -> dict[str, Column]:
    """Per field, what is wrong with a text value: ``missing`` when required and null, ``type`` when uncastable."""
    return {
        name: F.when(F.col(name).isNull(), F.when(F.lit(required), "missing")).when(
            F.col(name).try_cast(kind).isNull(), "type"
        )
        for name, (kind, required) in schema.items()
    }


def conform(df: DataFrame, schema: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add ``violations``, the ``field:reason`` list of each record."""
    reasons = [F.concat(F.lit(f"{name}:"), why) for name, why in field_violations(schema).items()]
    return df.withColumn("violations", F.array_compact(F.array(*reasons)))


def conformance_checks(schema: dict[str, tuple[str, bool]]) -> list[Check]:
    """Checks for :func:`split_errors`, so that records that do not conform become dead letters."""
    return [
        Check("conform", "MissingField" if reason == "missing" else "WrongType", f"{name}:{reason}", why == reason)
        for name, why in field_violations(schema).items()
        for reason in ("missing", "type")
    ]


def conformance(df: DataFrame, schema: dict[str, tuple[str, bool]]) -> DataFrame:
    """Violations per field and reason, counted in one pass."""
    counts = [
        F.struct(
            F.lit(name).alias("field"),
            F.count_if(F.coalesce(why == "missing", F.lit(False))).alias("missing"),
            F.count_if(F.coalesce(why == "type", F.lit(False))).alias("bad_type"),
        )
        for name, why in field_violations(schema).items()
    ]
    return df.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))
