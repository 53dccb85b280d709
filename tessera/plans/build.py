"""Index builds: records to graph and vectors, folders to chunks and BM25."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.models import Complete, silent
from ..functions.text import terms
from ..functions.vectors import hashed_embedding
from ..operators import bm25
from ..operators.cascade import cost_summary, extract_all, tier_costs
from ..operators.chunk import chunk
from ..operators.graph_build import build_graph, resolve_unknown
from ..operators.graph_query import edges_by_relation, nodes_by_type
from ..operators.incremental import cache_rows, last_build, manifest_rows
from ..operators.normalize import normalize_all
from ..operators.vector import record_vectors
from ..sources import files, graphs, tables
from ..sources.scratch import written


def offline_embedding(records: DataFrame) -> DataFrame:
    """Records with the offline embedding of their title and the first 200 characters of their body."""
    return records.withColumn("embedding", hashed_embedding(terms(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("body", F.lit("")), 1, 200)))))


def build_records(spark: SparkSession, raw: str, store: str, complete: Complete = silent, embed: Callable[[DataFrame], DataFrame] | None = offline_embedding, resolved: bool = False, refresh_changed: bool = False, cache_failures: bool = False, config: Config = Config()) -> dict:
    """Read the exports in `raw`, bring the store up to date, return what the run cost.

    A second run over the same exports processes nothing. Results of failed model calls aren't
    cached unless asked for; with refresh_changed, changed records get new vectors.
    """
    found = files.read_sources(spark, raw)
    if not found:
        raise FileNotFoundError(f"no exports in {raw}")
    records = normalize_all(found)
    files.write_records(records, f"{store}/records")
    records = spark.read.parquet(f"{store}/records")
    cache, manifest = tables.cache_table(spark, f"{store}/cache"), tables.manifest_table(spark, f"{store}/manifest")
    extract_all(records, cache.read(), manifest.read(), complete, embed, config).write.mode("overwrite").parquet(f"{store}/extracted")
    extracted = spark.read.parquet(f"{store}/extracted")
    done = extracted.where("processed")
    cache.upsert(cache_rows(done.where((F.col("tier") != "cache") & (F.lit(cache_failures) | ~F.col("failed")))))
    manifest.upsert(manifest_rows(done))
    # What was processed is written before the rest.
    ordered = extracted.withColumn("ord", F.when(F.col("processed"), F.col("ord")).otherwise(F.col("ord") + (1 << 62)))
    graphs.save(*build_graph(resolve_unknown(ordered) if resolved else ordered, written), f"{store}/graph")
    vectors = tables.vector_table(spark, f"{store}/vectors")
    rows = record_vectors(records).withColumn("embedding", hashed_embedding(terms(F.col("text"))))
    if refresh_changed:
        changed = vectors.read().select("id", F.col("text").alias("old")).join(rows, "id").where("old <> text").drop("old")
        vectors.upsert(changed)
    added, skipped = vectors.append_absent(rows)
    return cost_summary(extracted).first().asDict() | {"vectors_added": added, "vectors_skipped": skipped}


def ingest(spark: SparkSession, documents: DataFrame, store: str, rebuild: bool = True, config: Config = Config()) -> dict:
    """Chunk files (path, filename, content), add the chunks that aren't stored yet to the store and to BM25; return counts.

    The index gets the new chunks' postings alone. Only if it doesn't hold the chunks that were stored before, say
    after a run that was broken off, is it fitted anew.
    """
    chunks = tables.chunk_table(spark, f"{store}/chunks")
    before = chunks.read().count()
    given = chunk(files.with_text(documents), config.chunk_tokens, config.overlap_tokens)
    new = chunks.add_absent(given)
    added, skipped = new.count(), given.count()
    if rebuild and before + added:
        path = f"{store}/bm25"
        indexed = spark.read.parquet(f"{path}/chunks").count() if tables.exists(spark, f"{path}/chunks/_SUCCESS") else 0
        if indexed != before or not before:
            bm25.fit(chunks.read()).write(path)
        elif added:
            bm25.fit(new).write(path, "append")
    return {"indexed": added, "skipped": skipped - added, "total_chunks_in_store": before + added}


def ingest_folder(spark: SparkSession, folder: str, store: str, config: Config = Config(), progress: Callable[[str, int], None] = lambda stage, n: None) -> dict:
    """All text, Markdown and PDF files below a folder, as one job. Files that can't be read, or are too long for a
    row, are skipped and counted. `progress` is told stages and how many files they are about."""
    found = files.list_folder(spark, folder)
    n = found.count()
    progress("found", n)
    if not n:
        return {"files_found": 0, "files_processed": 0, "files_skipped": 0, "chunks_indexed": 0, "chunks_skipped": 0, "total_chunks_in_store": tables.chunk_table(spark, f"{store}/chunks").read().count()}
    contents = files.read_folder(spark, folder)
    read = contents.select("path", F.length("content").alias("n")).where("n >= 0").count()
    progress("read", read)
    out = ingest(spark, contents, store, config=config)
    progress("stored", read)
    return {"files_found": n, "files_processed": read, "files_skipped": n - read, "chunks_indexed": out["indexed"], "chunks_skipped": out["skipped"], "total_chunks_in_store": out["total_chunks_in_store"]}


def overview(nodes: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """what, name, n, cost: nodes by type, edges by relation, records by the tier that read them, with what that cost. A row for each kind."""
    no_cost = F.lit(None).cast("double").alias("cost")
    types = nodes_by_type(nodes).select(F.lit("type").alias("what"), F.col("type").alias("name"), F.col("nodes").alias("n"), no_cost)
    relations = edges_by_relation(edges).select(F.lit("relation").alias("what"), F.col("relation").alias("name"), F.col("edges").alias("n"), no_cost)
    tiers = tier_costs(manifest.select(F.col("tier_used").alias("tier"))).select(F.lit("tier").alias("what"), F.col("tier").alias("name"), F.col("records").alias("n"), "cost")
    return types.unionByName(relations).unionByName(tiers)


def health(spark: SparkSession, store: str) -> dict:
    """What a dashboard shows: records and chunks stored, nodes and edges, when the last build was, and the overview by kind; None for what isn't there."""

    def of(make: Callable[[], object]) -> object:
        try:
            return make()
        except (FileNotFoundError, AnalysisException):
            return None

    nodes_edges = of(lambda: [t.count() for t in graphs.load(spark, f"{store}/graph")]) or [None, None]
    return {
        "records": of(lambda: tables.vector_table(spark, f"{store}/vectors").read().count()), "chunks": of(lambda: tables.chunk_table(spark, f"{store}/chunks").read().count()),
        "nodes": nodes_edges[0], "edges": nodes_edges[1], "last_build": of(lambda: last_build(tables.manifest_table(spark, f"{store}/manifest").read()).first()[0]),
        "overview": of(lambda: [r.asDict() for r in overview(*graphs.load(spark, f"{store}/graph"), tables.manifest_table(spark, f"{store}/manifest").read()).orderBy("what", "name").collect()]),  # a row a kind
    }
