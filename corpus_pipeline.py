"""The corpus pipeline: quality, exact copies, near copies, a mix of sources, pieces.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, pieces, quality, simhash
from tessera.llm.common import read_table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, predicts to be good."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then the one with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it. Weights come from the text by DataFrame operations, as
    this stage has no other: the classifier's score would need Python here."""
    return mixing.repeat_by_mix(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: a row per document of the mix, with the ids of its sampled pieces and how they decode."""
    return pieces.round_trip(docs, with_ids=True)


STAGES = [("quality", good), ("exact dedup", no_copies), ("near dedup", no_near_copies), ("mix", mix), ("pieces", to_pieces)]

#: The classifier, SimHash and sampled pieces are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
