"""What changed since the last run, and the tables that remember."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, text_hash


def with_change(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records with content_hash and change: new, changed or unchanged against the manifest."""
    known = manifest.select(F.col("record_id").alias("id"), F.col("content_hash").alias("known_hash"))
    own = records.withColumn("content_hash", content_hash(F.col("title"), F.col("body")))
    change = F.when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") != F.col("content_hash"), "changed").otherwise("unchanged")
    return own.join(known, "id", "left").withColumn("change", change).drop("known_hash")


def change_stats(changes: DataFrame) -> DataFrame:
    """One row: total, new, changed, unchanged."""
    count = [F.count_if(F.col("change") == c).alias(c) for c in ("new", "changed", "unchanged")]
    return changes.agg(F.count(F.lit(1)).alias("total"), *count)


def manifest_rows(processed: DataFrame, now: str | None = None) -> DataFrame:
    """What the manifest is to hold of processed records (with tier); of rows of one id the last by ord."""
    at = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    row = F.struct(F.col("id").alias("record_id"), content_hash(F.col("title"), F.col("body")).alias("content_hash"), "source", F.col("tier").alias("tier_used"), at.alias("indexed_at"))
    return processed.groupBy("id").agg(F.max_by(row, "ord").alias("r")).select("r.*")


def cache_rows(processed: DataFrame, now: str | None = None) -> DataFrame:
    """What the extraction cache is to hold: the result as JSON by the hash of the text; of equal texts the last by ord."""
    at = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    row = F.struct(text_hash(F.col("title"), F.col("body")).alias("text_hash"), F.to_json(F.struct("entities", "relationships")).alias("result_json"), F.col("tier").alias("tier_used"), at.alias("created_at"))
    return processed.select(row.alias("r"), "ord").groupBy("r.text_hash").agg(F.max_by("r", "ord").alias("r")).select("r.*")


def last_build(manifest: DataFrame) -> DataFrame:
    """One row: the latest indexed_at, null for an empty manifest."""
    return manifest.agg(F.max("indexed_at").alias("last_build"))
