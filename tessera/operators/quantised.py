"""Approximate search by cosine over a stored index: vectors as codes of a product quantiser, the best of them scored again exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..sources.scratch import written
from ..sources.tables import exists

#: Pieces of a vector, each with a code of one byte; rows that the codes are learned from, at most, and rounds of that.
PIECES, SAMPLE, ROUNDS = 16, 20_000, 12
#: Candidates for each result wanted, and questions that go to all tasks at a time.
CANDIDATES, QUESTIONS = 20, 1024


@dataclass
class Index:
    """codebook (piece, code, centre), codes (id, code), vectors (id, embedding)."""

    codebook: DataFrame
    codes: DataFrame
    vectors: DataFrame

    def write(self, path: str, mode: str = "overwrite") -> None:
        self.codebook.write.mode(mode).parquet(f"{path}/codebook")
        self.codes.write.mode(mode).parquet(f"{path}/codes")
        self.vectors.write.mode(mode).parquet(f"{path}/vectors")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("codebook", "codes", "vectors")])


def _split(x: np.ndarray, pieces: int) -> np.ndarray:
    """Unit vectors in so many pieces, filled up with zeros: rows, pieces, components."""
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    width = -(-x.shape[1] // pieces)
    return np.pad(unit, ((0, 0), (0, width * pieces - x.shape[1]))).reshape(len(x), pieces, width)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _centres(x: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means, begun with the first distinct rows."""
    at = np.sort(np.unique(x, axis=0, return_index=True)[1])[:codes]
    centres = x[at].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) / 2 - x @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, c, len(centres)) for c in x.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def usable(rows: DataFrame, id: str = "id") -> DataFrame:
    """id, embedding of the rows that have a direction: no null, no component that is null or not finite, not all zeros."""
    own = rows.select(F.col(id).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.where("id IS NOT NULL").withColumn("size", norm(F.col("embedding"))).where((F.col("size") > 0) & (F.col("size") < float("inf"))).drop("size")


def learn(rows: DataFrame, pieces: int = PIECES, sample: int = SAMPLE) -> DataFrame:
    """codebook: up to 256 centres for each piece of a vector, from a sample of at most so many rows (id, embedding), by hash of the id; learned in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([_matrix(b.column(0)) for b in batches if b.num_rows] or [np.zeros((0, 1))])
        for piece in range(pieces if len(x) else 0):
            centres = _centres(_split(x, pieces)[:, piece], 256)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(centres), piece, np.int32)), pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(list(centres), pa.list_(pa.float64()))], ["piece", "code", "centre"])

    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.xxhash64("id").alias("at"), "embedding")
    return chosen.repartition(1).sortWithinPartitions("at").select("embedding").mapInArrow(run, "piece int, code int, centre array<double>")


def _book(codebook: DataFrame) -> list[np.ndarray]:
    """The centres of each piece; 256 at most."""
    rows = codebook.toArrow().sort_by([("piece", "ascending"), ("code", "ascending")])
    piece, centres = rows["piece"].to_numpy(), _matrix(rows["centre"].combine_chunks())
    return [centres[piece == p] for p in range(int(piece.max()) + 1)] if len(piece) else []


def encode(rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """id, code: a byte for each piece, the nearest centre's."""
    book = rows.sparkSession.sparkContext.broadcast(_book(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, codes = _split(_matrix(b.column(1)), max(1, len(book.value))), []
            for piece, centres in enumerate(book.value):
                codes.append(((centres * centres).sum(axis=1) / 2 - x[:, piece] @ centres.T).argmin(axis=1).astype(np.uint8))
            flat = np.stack(codes, axis=1) if codes else np.zeros((b.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "code"])

    return rows.select("id", "embedding").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, code binary")


def build(rows: DataFrame, path: str, id: str = "id", pieces: int = PIECES) -> Index:
    """Index rows (id, embedding) at path. Rows without a direction are left out; ids are unique and embeddings of one length."""
    spark, own = rows.sparkSession, usable(rows, id)
    learn(own, pieces).write.mode("overwrite").parquet(f"{path}/codebook")
    codebook = spark.read.parquet(f"{path}/codebook")
    own.write.mode("overwrite").parquet(f"{path}/vectors")
    encode(spark.read.parquet(f"{path}/vectors"), codebook).write.mode("overwrite").parquet(f"{path}/codes")
    return Index.read(spark, path)


def add(rows: DataFrame, path: str, id: str = "id") -> int:
    """Add the rows whose ids the index doesn't have, in files of their own and by the codes that were learned; how many they are."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/codebook"):
        return build(rows, path, id).codes.count()
    index = Index.read(spark, path)
    before = index.vectors.count()
    usable(rows, id).dropDuplicates(["id"]).join(index.vectors.select("id"), "id", "left_anti").write.mode("append").parquet(f"{path}/vectors")
    # Codes follow vectors, also those of an addition that was broken off in between.
    vectors = spark.read.parquet(f"{path}/vectors")
    encode(vectors.join(index.codes.select("id"), "id", "left_anti"), index.codebook).write.mode("append").parquet(f"{path}/codes")
    return vectors.count() - before


def search(index: Index, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES, leave_out_self: bool = False, exact: bool = False) -> DataFrame:
    """query_id, id, score, rank: for each query (query_id, embedding) the k rows nearest by cosine among those that its codes put first.

    Every task keeps candidates * k rows a query by the sum of its table's entries for a code's bytes; of all tasks' the best so many are joined with
    their vectors and scored exactly, ties (nine decimals) to the smaller id. Questions go to the tasks QUESTIONS at a time.

    With `exact` what codes put first is only a bound: the stored vectors are compared with all queries, and what reaches the k-th score found
    by codes counts too, so that none of the k nearest is missed.
    """
    spark = index.codes.sparkSession
    book = spark.sparkContext.broadcast(_book(index.codebook))
    kind, own_kind = (f.dataType.simpleString() for f in (queries.schema["query_id"], index.codes.schema["id"]))
    asked = usable(queries.select("query_id", "embedding"), "query_id")
    blocks = max(1, -(-asked.count() // QUESTIONS))
    most = candidates * k

    def near(block: DataFrame) -> DataFrame:
        rows = block.toArrow()  # about QUESTIONS rows
        parts = _split(_matrix(rows["embedding"].combine_chunks()), max(1, len(book.value)))
        shared = spark.sparkContext.broadcast((rows["id"].combine_chunks(), np.stack([np.pad(parts[:, p] @ c.T, ((0, 0), (0, 256 - len(c)))) for p, c in enumerate(book.value)]) if book.value else np.zeros((0, len(rows), 256))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, tables = shared.value
            ids, best, held = [], [np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)], 0
            for b in batches:
                ids.append(b.column(0))
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for i in range(0, len(codes), 1024):
                    own = codes[i : i + 1024]
                    scores = sum((t[:, own[:, p]] for p, t in enumerate(tables)), np.zeros((len(names), len(own))))
                    both = [np.concatenate((old, new), axis=1) for old, new in zip(best, (scores, np.broadcast_to(held + i + np.arange(len(own)), scores.shape)))]
                    if both[0].shape[1] > most:
                        at = np.argpartition(-both[0], most - 1, axis=1)[:, :most]
                        both = [np.take_along_axis(x, at, axis=1) for x in both]
                    best = both
                held += b.num_rows
            if held and len(names):
                n = best[0].shape[1]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(names)), n))), pa.concat_arrays(ids).take(pa.array(best[1].ravel())), pa.array(best[0].ravel())], ["query_id", "id", "near"])

        return index.codes.select("id", "code").mapInArrow(run, f"query_id {kind}, id {own_kind}, near double")

    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = reduce(DataFrame.unionByName, [near(numbered.where(F.col("block") == i).select("id", "embedding")) for i in range(blocks)])
    found = found.where("query_id <> id") if leave_out_self else found
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    kept = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("query_id", "id")
    q = asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("asked"))
    cosine = dot(F.col("asked"), F.col("embedding")) / (norm(F.col("asked")) * norm(F.col("embedding")))
    scored = kept.join(index.vectors, "id").join(q, "query_id").select("query_id", "id", cosine.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not exact:
        return best
    bound = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bound"))
    bounded = numbered.withColumnRenamed("id", "query_id").join(bound, "query_id", "left").select("block", "query_id", "embedding", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    bounded = written(bounded, "bounds")
    reached = reduce(DataFrame.unionByName, [_reached(index.vectors, bounded.where(F.col("block") == i), k, leave_out_self) for i in range(blocks)])
    again = reached.join(index.vectors, "id").join(q, "query_id").select("query_id", "id", cosine.alias("score"))
    return again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reached(vectors: DataFrame, block: DataFrame, k: int, leave_out_self: bool) -> DataFrame:
    """query_id, id: the vectors whose cosine reaches a query's bound; of each batch a query's k best, ties (nine decimals) to the smaller id."""
    rows = block.toArrow()  # about QUESTIONS rows
    names = rows["query_id"].combine_chunks()
    shared = vectors.sparkSession.sparkContext.broadcast((names, _split(_matrix(rows["embedding"].combine_chunks()), 1)[:, 0], rows["bound"].to_numpy() - 1e-8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, bound = shared.value
        own_names = np.array(names.to_pylist(), object)
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            ids = np.array(b.column(0).to_pylist(), object)
            scores = asked @ _split(_matrix(b.column(1)), 1)[:, 0].T
            row, column = np.nonzero(scores >= bound[:, None])
            if leave_out_self:
                other = own_names[row] != ids[column]
                row, column = row[other], column[other]
            # By query, score and id; each query's first k.
            place = np.empty(len(ids), np.int64)
            place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            order = np.lexsort((place[column], -np.round(scores[row, column], 9), row))
            row, column = row[order], column[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row[first])), b.column(0).take(pa.array(column[first]))], ["query_id", "id"])

    kind, own_kind = block.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"query_id {kind}, id {own_kind}")
