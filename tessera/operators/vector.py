"""Exact search by cosine, over dense vectors and over the offline hashed embedding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted, none, terms
from ..functions.vectors import DIMENSIONS, bucket, dot, norm

#: Questions that are compared with all chunks at a time: 8 MB of vectors.
QUESTIONS = 4096


def top_by_cosine(vectors: DataFrame, query: list[float], k: int, id: str = "id", where: Column | None = None) -> DataFrame:
    """id, score, rank: the k rows (id, embedding) nearest to one query vector, ties (nine decimals) to the smaller id.

    `where` filters by metadata first; several conditions are joined by and. Each task keeps its k best.
    """
    rows = vectors if where is None else vectors.where(where)
    q = F.lit([float(x) for x in query])
    size = sum(float(x) ** 2 for x in query) ** 0.5
    score = F.when(norm(F.col("embedding")) * size > 0, dot(F.col("embedding"), q) / (norm(F.col("embedding")) * size))
    best = rows.select(id, score.alias("score")).where("score IS NOT NULL").orderBy(F.desc(F.round("score", 9)), id).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), id)))


def by_metadata(source: str | None = None, kind: str | None = None) -> Column | None:
    """The filter for a source, a type or both."""
    out = None
    for name, value in (("source", source), ("type", kind)):
        if value:
            out = F.col(name) == value if out is None else out & (F.col(name) == value)
    return out


def record_vectors(records: DataFrame) -> DataFrame:
    """Records as rows of the vector table, without the embedding: nulls as "", services joined by commas."""
    text = F.concat(none(F.col("title")), F.lit("\n\n"), none(F.col("body")))
    plain = [none(F.col(c)).alias(c) for c in ("type", "source", "owner", "timestamp")]
    return records.select("id", text.alias("text"), *plain, F.array_join("services_mentioned", ",").alias("services"), none(F.col("priority")).alias("priority"), none(F.col("status")).alias("status"))


def hashed_vectors(rows: DataFrame, id: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """id, parts: the offline embedding of each row, as (value: component, n: how many terms fall on it). Rows without terms have none."""
    return rows.select(id, counted(F.transform(terms(F.col(text)), lambda t: bucket(t, dimensions).cast("int"))).alias("parts"))


def _dense(parts: pa.Array, dimensions: int) -> np.ndarray:
    """Unit vectors, a row each; of zeros where there are no parts."""
    flat = parts.flatten()
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    out = np.zeros((len(parts), dimensions))
    out[row, flat.field("value").to_numpy()] = flat.field("n").to_numpy()
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best positive scores of each row, by (score at nine decimals, smaller id)."""
    rounded = np.round(scores, 9)
    rows, columns = [], []
    for i, own in enumerate(rounded):
        at = np.flatnonzero(scores[i] > 0)
        if len(at) > k:
            least = -np.partition(-own[at], k - 1)[k - 1]
            above, level = at[own[at] > least], at[own[at] == least]
            at = np.concatenate((above, level[np.argsort(ids[level], kind="stable")][: k - len(above)]))
        rows.append(np.full(len(at), i))
        columns.append(at)
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(columns) if columns else np.zeros(0, int)


def search_hashed(vectors: DataFrame, queries: DataFrame, k: int = 50, dimensions: int = DIMENSIONS) -> DataFrame:
    """query_id, chunk_id, score, rank: for each query (query_id, query) the k chunks (chunk_id, parts) nearest by the offline embedding.

    Exact. Questions go to all tasks, QUESTIONS at a time, so that what is broadcast is bounded; each
    batch of chunks is compared with them by a matrix product and gives k rows a question at most.
    Chunks that share no component with a question are none of its hits.
    """
    spark = vectors.sparkSession
    kind = queries.schema["query_id"].dataType
    asked = hashed_vectors(queries, "query_id", "query", dimensions)
    blocks = -(-queries.count() // QUESTIONS)

    def search(block: DataFrame) -> DataFrame:
        table = block.toArrow()  # QUESTIONS rows at most
        shared = spark.sparkContext.broadcast((table["query_id"].combine_chunks(), _dense(table["parts"].combine_chunks(), dimensions)))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            for b in batches:
                ids = b.column(0)
                keys = np.array(ids.to_pylist(), object)
                scores = asked @ _dense(b.column(1), dimensions).T
                row, column = best_of(keys, scores, k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(column)), pa.array(scores[row, column])], ["query_id", "chunk_id", "score"])

        return vectors.select("chunk_id", "parts").mapInArrow(near, f"query_id {kind.simpleString()}, chunk_id string, score double")

    if blocks <= 1:
        found = [search(asked.select("query_id", "parts"))]
    else:
        numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))).persist()
        found = [search(numbered.where(F.col("block") == i).select("query_id", "parts")) for i in range(2 * blocks)]
    scored = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
