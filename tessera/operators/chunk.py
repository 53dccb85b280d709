"""Documents as overlapping windows of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_id, none, tokens

#: A window of fewer tokens ends a document, unless it is the first.
LEAST = 20


def n_chunks(n: Column, size: int = 400, overlap: int = 50) -> Column:
    """How many windows n tokens give, in closed form."""
    return F.when(n == 0, 0).when(n < LEAST, 1).otherwise(F.floor((n - LEAST) / (size - overlap)) + 1).cast("int")


def chunk(files: DataFrame, size: int = 400, overlap: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """chunk_id, doc_id, filename, text, chunk_index, total_chunks of files (filename, text), and the files' columns named by `keep`.

    Windows of `size` tokens, each beginning size - overlap after the one before; joined by single spaces. A text
    without tokens has none. One generator over the token array, no shuffle.
    """
    step = size - overlap
    split = files.select(*keep, "filename", document_id(F.col("filename"), none(F.col("text"))).alias("doc_id"), tokens(F.col("text")).alias("tokens"))
    counted = split.withColumn("total_chunks", n_chunks(F.size("tokens"), size, overlap))
    # Windows become texts before they become rows, so that no row carries all tokens. The outer form, as
    # for the inner one Catalyst would add a filter that splits every text once more.
    window = F.when(F.col("total_chunks") > 0, F.transform(F.sequence(F.lit(0), F.col("total_chunks") - 1), lambda i: F.array_join(F.slice("tokens", i * step + 1, size), " ")))
    rows = counted.select(*keep, "filename", "doc_id", "total_chunks", window.alias("windows")).select(*keep, "filename", "doc_id", "total_chunks", F.posexplode_outer("windows").alias("chunk_index", "text")).where("chunk_index IS NOT NULL")
    return rows.select(F.format_string("%s_chunk_%04d", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "filename", "text", "chunk_index", "total_chunks", *keep)


def store_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunk_count, doc_count, filenames (distinct, none empty, sorted). Names are told apart before they are gathered; stored_files
    has them as rows."""
    named = chunks.groupBy(F.nullif("filename", F.lit("")).alias("name"), F.nullif("doc_id", F.lit("")).alias("doc")).agg(F.count(F.lit(1)).alias("chunks"))
    counts = named.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"), F.countDistinct("doc").alias("doc_count"))
    names = named.select("name").distinct().agg(F.array_sort(F.collect_list("name")).alias("filenames"))
    return counts.crossJoin(F.broadcast(names))  # a row each


def stored_files(chunks: DataFrame) -> DataFrame:
    """filename, chunks: a row for each name that isn't empty; callers put them in order, or take a page."""
    return chunks.where(none(F.col("filename")) != "").groupBy("filename").agg(F.count(F.lit(1)).alias("chunks"))
