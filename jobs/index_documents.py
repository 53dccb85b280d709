"""Take in new documents: cut them into passages and index their terms, for search with citations.

    python jobs/index_documents.py --documents PATH --output PATH --checkpoint PATH [--config FILE]

A stream over the folder of documents, whose checkpoint remembers the files that were taken in; a run takes what is new and ends.
It writes OUTPUT/passages (by batch and language) and OUTPUT/postings (by batch and shard of the term). A batch that is run again
replaces its own partitions, so a run that was broken off can be repeated; a passage that another batch stored isn't stored again.
"""

from __future__ import annotations

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
if os.path.dirname(HERE) not in sys.path:
    sys.path.insert(0, os.path.dirname(HERE))

from pyspark.errors import AnalysisException  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import LOG, command_line, new_folder  # noqa: E402
from tessera.functions.aliases import services_in  # noqa: E402
from tessera.functions.text import counted, terms  # noqa: E402
from tessera.operators.chunk import chunk  # noqa: E402
from tessera.plans import oracle  # noqa: E402

SETTINGS = {"chunk_tokens": 400, "overlap_tokens": 50, "files_per_batch": 1000, "shards": 16}
#: What a folder of documents has to have; other columns are left out.
DOCUMENTS = "doc_id long, text string, lang string, source string"
PASSAGES = "chunk_id string, doc_id string, filename string, text string, chunk_index int, total_chunks int, source string, services array<string>, batch long, lang string"
POSTINGS = "term string, chunk_id string, tf int, dl int, batch long, shard int"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one before anything is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def arrivals(path: str) -> str:
    """The path as a pattern that matches it alone: a stream takes such for a folder of files and for a single file alike."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def passages(documents: DataFrame, settings: dict) -> DataFrame:
    """The documents' passages, each id once: what repeats a file's name and beginning is one document, of which the least text counts."""
    files = documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text", F.coalesce("lang", F.lit("unknown")).alias("lang"), "source")
    facts = F.struct("lang", "source")
    cut = chunk(files.withColumn("facts", facts), settings["chunk_tokens"], settings["overlap_tokens"], keep=["facts"])
    order = F.struct(F.sha2("text", 256), F.col("facts"))
    row = F.struct("doc_id", "filename", "text", "chunk_index", "total_chunks", "facts")
    first = cut.groupBy("chunk_id").agg(F.min_by(row, order).alias("r"))
    return first.select("chunk_id", "r.doc_id", "r.filename", "r.text", "r.chunk_index", "r.total_chunks", "r.facts.source", services_in(F.col("r.text")).alias("services"), "r.facts.lang")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict = SETTINGS) -> dict:
    """Take in what is new at `documents`; returns how many batches, documents, passages and postings that were."""
    done = {"batches": 0, "documents": 0, "passages": 0, "postings": 0}

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        known = stored(own, f"{output}/passages", PASSAGES).where(F.col("batch") != number).select("chunk_id")
        new = passages(rows, settings).join(known, "chunk_id", "left_anti").withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(f"{output}/passages")
        # Terms are counted from what was written, each passage in its own row.
        kept = stored(own, f"{output}/passages", PASSAGES).where(F.col("batch") == number)
        split = kept.select("chunk_id", terms(F.col("text")).alias("t")).select("chunk_id", F.size("t").alias("dl"), F.explode(counted(F.col("t"))).alias("c"))
        shard = F.pmod(F.xxhash64("c.value"), F.lit(settings["shards"])).cast("int")
        posted = split.select(F.col("c.value").alias("term"), "chunk_id", F.col("c.n").alias("tf"), "dl", F.lit(number).cast("long").alias("batch"), shard.alias("shard"))
        # A shard's terms lie sorted in its files, so that a question's terms prune row groups.
        posted.repartition("shard", F.xxhash64("term") % 64).sortWithinPartitions("shard", "term", "chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "shard").parquet(f"{output}/postings")
        wrote = {"documents": rows.count(), "passages": kept.count(), "postings": stored(own, f"{output}/postings", POSTINGS).where(F.col("batch") == number).count()}
        LOG.info("batch %d: read %d documents from %s, wrote %d passages and %d postings to %s", number, wrote["documents"], documents, wrote["passages"], wrote["postings"], output)
        done["batches"] += 1
        for what, n in wrote.items():
            done[what] += n

    arriving = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(arrivals(documents))
    query = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("took in %d documents in %d batches", done["documents"], done["batches"])
    return done


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with what the postings say of it, after two runs of which the second finds nothing new."""
    folder = new_folder(spark, "job1-index-documents")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    found = stored(spark, f"{folder}/index/passages", PASSAGES)
    counts = stored(spark, f"{folder}/index/postings", POSTINGS).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("dl").alias("length"))
    return found.join(counts, "chunk_id", "left").select("chunk_id", "doc_id", "filename", "text", "chunk_index", "total_chunks", "source", "lang", F.array_join("services", ",").alias("services"), "n_terms", "n_tokens", "length")


ORACLE_SQL = rf"""
WITH {oracle.ALIASES}, {oracle.FILES}, facts AS (SELECT doc_id || '.txt' AS filename, source, coalesce(lang, 'unknown') AS lang FROM documents),
cut AS (SELECT *, regexp_extract_all(lower(text), '\S+') AS t FROM chunks)
SELECT chunk_id, doc_id, filename, text, chunk_index, total_chunks, source, lang, {oracle._mentions("text")} AS services, len(list_distinct(t)) AS n_terms, len(t) AS n_tokens, len(t)::INTEGER AS length FROM cut JOIN facts USING (filename)
"""

if __name__ == "__main__":
    command_line(__doc__, ("documents", "output", "checkpoint"), os.path.join(HERE, "index_documents.json"), SETTINGS, run)
