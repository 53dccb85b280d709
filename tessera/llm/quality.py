"""Quality scores: hashed word n-grams, logistic regression trained with FTRL, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import read_table, spread
from .linear import features, margin, sigmoid, trained

BITS, EPOCHS = 18, 3
#: Rows to learn from, at most: those whose ids have the smallest hashes. This bounds training alone.
SAMPLE = 12_000
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample_of(labels: DataFrame, label: str, rows: int, *more: str) -> DataFrame:
    """__id, __label (and __<name> of more labels) of at most so many labelled ids that aren't held out. Of an id with several labels the least counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    least = [F.min(name).cast("double").alias(f"__{to}") for name, to in ((label, "label"), *((m, m) for m in more))]
    return known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(*least).orderBy(F.xxhash64("__id"), "__id").limit(rows)


def one_each(rows: DataFrame, *columns: str) -> DataFrame:
    """Of the rows that share a key the least by these columns, so that there are no more rows than sampled ids."""
    return rows.groupBy("key").agg(F.min(F.struct(*columns)).alias("r")).select("key", *[f"r.{c}" for c in columns])


def featured(docs: DataFrame, sample: DataFrame, bits: int) -> DataFrame:
    """One row per sampled id: key, label, features as bytes. The sample's bound makes it fit to broadcast.

    Of several rows of an id the one with the least features is learned from.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [features(t.as_py() or b"", bits).tobytes() for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["key", "label", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(sample), "__id")
    return one_each(own.select("__id", "__label", "__text").mapInArrow(hashed, "key long, label double, ids binary"), "label", "ids")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, rows: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from a bounded sample of labelled rows, learned in one task in an order that ids alone decide."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            seen += [(np.frombuffer(x, np.int32), y) for x, y in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([trained(seen, bits, epochs).tobytes()], pa.binary())], ["weights"])

    rows_ = featured(docs, sample_of(labels, label, rows), bits)
    one = rows_.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", "label", "ids")
    found = one.mapInArrow(learn, "weights binary").first()  # none if there are no labelled rows
    return np.frombuffer(bytes(found[0]) if found else trained([], bits, epochs).tobytes(), np.float32)


def scores_of(texts: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    return np.array([sigmoid(margin(weights, bits, features(t.as_py() or b"", bits))) for t in texts.cast(pa.binary())], np.float64)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Only the text counts for the score. A null or empty text has no features and gets the score of
    the constant alone. A null doc_id is kept; repeated rows get a row each. With no labelled rows
    every score is 0.5. An empty table gives an empty result; other columns play no part.
    """
    model: Broadcast = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores_of(b.column(1), model.value, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(scored, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def with_score(docs: DataFrame, weights: np.ndarray, name: str, bits: int = BITS) -> DataFrame:
    """docs, all its rows and columns, with the text's score in a column of that name."""
    model: Broadcast = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(scores_of(b.column(at), model.value, bits), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, name])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier predicts to be good, in all their columns; nothing is shuffled.

    A null or empty text is judged by the constant alone; null ids and repeated rows stay or go by their
    texts. Without labelled rows all stay; an empty table gives an empty result.
    """
    model: Broadcast = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores_of(b.column(at), model.value, bits)
            yield b.filter(pc.greater_equal(pa.array(s), threshold))

    return docs.mapInArrow(kept, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
