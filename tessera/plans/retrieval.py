"""The whole way from questions to cited answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.models import Complete, lexical_overlap
from ..operators import bm25, fusion, vector
from ..operators.citations import asked, checked, extractive


@dataclass
class Search:
    """Stages of a search for all questions (query_id, query) at once; each is computed from the one before."""

    bm25: DataFrame
    vector: DataFrame
    fused: DataFrame
    reranked: DataFrame

    def funnel(self) -> DataFrame:
        return fusion.funnel(self.bm25, self.vector, self.fused, self.reranked)


def search(chunks: DataFrame, questions: DataFrame, index: bm25.Index | None = None, vectors: DataFrame | None = None, scorer=lexical_overlap, config: Config = Config()) -> Search:
    """BM25 and vector candidates, fused, then reranked. Give index and vectors (operators.vector.hashed_vectors) where they are stored."""
    index = index or bm25.fit(chunks)
    lexical = bm25.search_many(index, questions, config.candidates)
    near = vector.search_hashed(vectors if vectors is not None else vector.hashed_vectors(chunks, "chunk_id", "text"), questions, config.candidates)
    # At most `candidates` rows a question from here on; the stages below read these twice.
    lexical, near = lexical.persist(), near.persist()
    fused = fusion.hybrid(lexical, near, chunks, config.fused)
    return Search(lexical, near, fused, fusion.rerank(fused, questions, config.answers, scorer))


def answer(found: Search, questions: DataFrame, respond=extractive, complete: Complete | None = None, config: Config = Config()) -> DataFrame:
    """query_id, query, answer, citations for every question. The raw answer is what a language model says, if `complete`
    is given; else what the expression `respond` makes of question and sources."""
    source = F.struct("rerank", "chunk_id", "filename", "chunk_index", "total_chunks", "text")
    sources = found.reranked.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    rows = questions.join(sources, "query_id", "left")
    empty = F.from_json(F.lit("[]"), "array<struct<rerank:int,chunk_id:string,filename:string,chunk_index:int,total_chunks:int,text:string>>")
    rows = rows.withColumn("sources", F.coalesce("sources", empty))
    said = rows.withColumn("answer", respond(F.col("query"), F.col("sources"))) if complete is None else asked(rows, complete, config.agent_model)
    return checked(said).select("query_id", "query", "answer", "citations")
