"""Reciprocal-rank fusion, hybrid search, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import lexical_overlap

K = 60


def fuse(first: DataFrame, second: DataFrame, k: int = K, top: int | None = None) -> DataFrame:
    """query_id, chunk_id, rrf, rank, first_score, second_score: two rankings (query_id, chunk_id, score, rank) as one.

    A rank r is worth 1 / (k + r). Ties keep the first ranking's order, then the second's.
    """
    a = first.select("query_id", "chunk_id", F.col("score").alias("first_score"), F.col("rank").alias("ra"))
    b = second.select("query_id", "chunk_id", F.col("score").alias("second_score"), F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "chunk_id"], "full")
    worth = [F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0)) for r in ("ra", "rb")]
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last())
    ranked = both.withColumn("rrf", worth[0] + worth[1]).withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("query_id", "chunk_id", "rrf", "rank", "first_score", "second_score")


def hybrid(bm25: DataFrame, vector: DataFrame, chunks: DataFrame, top: int = 20) -> DataFrame:
    """The fused top of both searches with the chunks' text and metadata; `score` is BM25's where there is one, else the cosine.

    Chunks without text are left out.
    """
    fused = fuse(bm25, vector, top=top).withColumnsRenamed({"first_score": "bm25_score", "second_score": "vector_score"})
    found = fused.join(chunks.select("chunk_id", "text", "doc_id", "filename", "chunk_index", "total_chunks"), "chunk_id")
    return found.where(F.coalesce("text", F.lit("")) != "").withColumn("score", F.coalesce("bm25_score", "vector_score"))


def rerank(candidates: DataFrame, queries: DataFrame, top: int = 5, scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """Candidates with rerank_score and rerank: each query's best by scorer(query, text), ties in the former order.

    A model is a scorer too: an iterator pandas UDF that loads it once a worker.
    """
    scored = candidates.join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank", F.row_number().over(order)).where(F.col("rerank") <= top).drop("query")


def funnel(bm25: DataFrame, vector: DataFrame, fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """query_id, bm25_hits, vector_hits, after_rrf, after_rerank."""
    names = {"bm25_hits": bm25, "vector_hits": vector, "after_rrf": fused, "after_rerank": reranked}
    stages = None
    for name, df in names.items():
        own = df.select("query_id", F.lit(name).alias("stage"))
        stages = own if stages is None else stages.unionByName(own)
    return stages.groupBy("query_id").agg(*[F.count_if(F.col("stage") == n).alias(n) for n in names])
