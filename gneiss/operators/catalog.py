"""Queries over what is indexed: counts, listings, model checks, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a collection without a registry row was embedded with, and reserved names.
LEGACY_MODEL = "ollama:nomic-embed-text"
LEGACY_DIMENSIONS = 768
CODE_PREFIX = "code."
REGISTRY = "gneiss-meta"


def counts(collections: DataFrame, points: DataFrame) -> DataFrame:
    """(collection, points), empty collections included."""
    n = points.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return collections.join(n, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).cast("long").alias("points"))


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """The non-null values of a field as strings."""
    return df.select(F.col(field).cast("string").alias("value")).filter("value is not null").distinct()


def scroll_where(df: DataFrame, field: str, value, limit: int | None = 10, vector_col: str = "vector") -> DataFrame:
    """Some rows (or all) whose field has the value, without their vectors."""
    found = df.filter(F.col(field) == value).drop(vector_col)
    return found if limit is None else found.limit(limit)


def model_check(collections: DataFrame, meta: DataFrame, model_id: str) -> DataFrame:
    """(collection, model_id, mismatch); a collection without a registry row is a legacy one."""
    stored = F.coalesce("model_id", F.lit(LEGACY_MODEL))
    return collections.join(meta.select("collection", "model_id"), "collection", "left").select("collection", stored.alias("model_id"), (stored != model_id).alias("mismatch"))


def source_lines(projects: DataFrame, counted: DataFrame, meta: DataFrame) -> DataFrame:
    """Projects (name, collection, kind, repo_name) with a line of text on what is indexed.

    With the columns ``configured`` (the project's own model) and ``problem`` (why its provider
    can't be had) the line also tells a mismatch, and what to do."""
    joined = projects.join(counted, "collection", "left").join(meta, "collection", "left")
    label = F.format_string("- %s (%s, repo %s)", "collection", "kind", "repo_name")
    model = F.coalesce("model_id", F.lit(f"{LEGACY_MODEL} (legacy, no record)"))
    details = [F.format_string("%d points", "points"), F.concat(F.lit("model "), model), F.when(F.col("files").isNotNull(), F.format_string("%d files", "files"))]
    if "indexed_at" in meta.columns:
        details.append(F.concat(F.lit("indexed "), F.coalesce("indexed_at", F.lit("at unknown time"))))
    missing = F.lit(": not indexed yet")
    if "configured" in projects.columns:
        wrong = F.col("configured").isNotNull() & (F.coalesce("model_id", F.lit(LEGACY_MODEL)) != F.col("configured"))
        details.append(F.when(wrong, F.concat(F.lit("other model than the configured "), F.col("configured"), F.lit(": ingest "), F.col("name"), F.lit(" with --recreate"))))
        details.append(F.concat(F.lit("no embedding provider: "), F.col("problem")))
        missing = F.concat(missing, F.lit(", ingest "), F.col("name"), F.coalesce(F.concat(F.lit(" (no embedding provider: "), F.col("problem"), F.lit(")")), F.lit("")))
    text = F.when(F.col("points").isNull(), F.concat(label, missing)).otherwise(F.concat(label, F.lit(": "), F.concat_ws(", ", *details)))
    return joined.withColumn("line", text)


def orphans(stored: DataFrame, known: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Stored collections that start with a verifiable prefix and belong to no project."""
    prefix = F.substring_index("collection", ".", 1)
    own = stored.filter(~F.col("collection").startswith(CODE_PREFIX) & (F.col("collection") != REGISTRY) & F.col("collection").contains("."))
    return own.withColumn("prefix", prefix).join(prefixes, "prefix", "left_semi").join(known, "collection", "left_anti").select("collection")
