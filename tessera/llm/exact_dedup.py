"""Exact dedup over a log-structured merge index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import free_names, hot_join, read_table, scratch, without_spaces, written

#: Bits of a filter: eight for each digest, between 2^15 and 2^30 (128 MB at most).
FILTER_BITS = (1 << 15, 1 << 30)
#: bitmap_construct_agg makes bitmaps of so many bits.
BITMAP = 32768


class DigestIndex:
    """A log-structured merge index of text digests, kept as sorted Parquet runs in the shared folder.

    `flush` takes documents: every task is a memtable, which it sorts by digest and writes as one
    immutable file of a level-0 run, with a Bloom filter and page statistics on the digest. `compact` merges
    the runs flushed since the last time with the former level 1 into a new level-1 run, which holds for each digest
    its smallest identifier, (longest text, smallest doc_id, first place), and its number of rows; and
    writes that run's filter, a bitmap of the digests of more than one row (hits). `classes` probes the filter:
    rows that aren't in it stand alone and are shuffled no more; the others are joined with level 1. Hits are
    verified by comparing their texts' bytes. `seen` probes the level's whole filter for texts of further documents.

    Nulls: a null text counts as empty; a null doc_id is an identifier that comes after all others.
    Rows repeating a doc_id and a text are one document's copies: all are returned, one is kept; so no
    group of rows, however large, is gathered in one task. Empty inputs give empty runs. Other columns of
    the documents play no part. `digest_bytes` is how much of the SHA-256 the runs are keyed by.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest_bytes: int = 32):
        self.spark, self.digest_bytes = spark, digest_bytes
        self.path = path or scratch(spark, "digest-index")
        self.runs: list[str] = []
        self.new: list[str] = []
        self.merged: str | None = None
        self.sources: list[DataFrame] = []

    def _keyed(self, docs: DataFrame, *more: Column) -> DataFrame:
        sha = F.unhex(F.sha2(F.col("norm"), 256))
        doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("whole"), without_spaces(F.col("text")).alias("norm"))
        return doc.select("doc_id", F.length(F.coalesce("whole", F.lit(""))).cast("long").alias("points"), sha.alias("sha"), *more).withColumn("digest", F.substring("sha", 1, self.digest_bytes))

    @staticmethod
    def _sorted_run(df: DataFrame, path: str) -> None:
        run = df.sortWithinPartitions("digest").write.mode("overwrite")
        run.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)

    def flush(self, docs: DataFrame) -> None:
        path = f"{self.path}/level0-{len(self.runs)}"
        rows = self._keyed(docs).withColumns({"run": F.lit(len(self.runs)), "place": F.monotonically_increasing_id()})
        self._sorted_run(rows.select("digest", "sha", "doc_id", "points", "run", "place"), path)
        self.runs.append(path)
        self.new.append(path)
        self.sources.append(docs.select("doc_id", "text"))

    def _docs(self) -> DataFrame:
        docs = self.sources[0]
        for more in self.sources[1:]:
            docs = docs.unionByName(more)
        return docs

    @staticmethod
    def _first(prefix: str = "") -> Column:
        """An identifier that is smaller the longer its text is."""
        c = {n: F.col(prefix + n) for n in ("points", "doc_id", "run", "place")}
        return F.struct((-c["points"]).alias("less"), c["doc_id"].isNull().alias("none"), c["doc_id"].alias("doc_id"), c["run"].alias("run"), c["place"].alias("place"))

    @staticmethod
    def _index(best: DataFrame, *keys: str) -> DataFrame:
        return best.select(*keys, F.col("first.doc_id").alias("keep_id"), (-F.col("first.less")).alias("keep_points"), F.col("first.run").alias("keep_run"), F.col("first.place").alias("keep_place"), "group_size")

    def compact(self) -> None:
        """Merge the new runs into level 1; what level 1 held already is not read from level 0 again."""
        if self.merged and not self.new:
            return
        rows = self.spark.read.parquet(*self.new).select("digest", self._first().alias("first"), F.lit(1).cast("long").alias("n"))
        if self.merged:
            old = self.spark.read.parquet(self.merged).withColumnsRenamed({f"keep_{n}": n for n in ("points", "run", "place")} | {"keep_id": "doc_id"})
            rows = rows.unionByName(old.select("digest", self._first().alias("first"), F.col("group_size").alias("n")))
        path = f"{self.path}/level1-{len(self.runs)}"
        best = rows.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
        self._sorted_run(self._index(best, "digest"), path)
        self.merged, self.new = path, []
        self.hit_bits = self._write_filter(self.level1().where("group_size > 1"), f"{path}-hits")
        self.all_bits = None

    def level1(self) -> DataFrame:
        return self.spark.read.parquet(self.merged)

    @staticmethod
    def _at(bits: int) -> list[Column]:
        place = F.pmod(F.xxhash64("digest"), F.lit(bits))
        return [(place / BITMAP).cast("long").alias("at"), F.pmod(place, F.lit(BITMAP)).alias("bit")]

    def _write_filter(self, digests: DataFrame, path: str) -> int:
        """A table of bitmaps, FILTER_BITS at most; how many bits it has."""
        n = digests.count()
        bits = min(max(FILTER_BITS[0], 1 << (8 * max(n, 1)).bit_length()), FILTER_BITS[1])
        digests.select(*self._at(bits)).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).write.mode("overwrite").parquet(path)
        return bits

    def _probed(self, df: DataFrame, path: str, bits: int) -> DataFrame:
        """df with `maybe`: whether the filter has the digest. The filter's size is bounded, so it goes to every task."""
        filters = self.spark.read.parquet(path).withColumnsRenamed({"bits": "filter_bits"})
        byte = F.conv(F.hex(F.substring("filter_bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        probe = df.select("*", *self._at(bits)).join(F.broadcast(filters), "at", "left")
        maybe = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0, F.lit(False))
        return probe.withColumn("maybe", maybe).select(*df.columns, "maybe")

    def _hits(self, df: DataFrame) -> DataFrame:
        return self._probed(df, f"{self.merged}-hits", self.hit_bits)

    def seen(self, docs: DataFrame) -> DataFrame:
        """Those of further documents (doc_id, text) whose text is in the index, in their own rows.

        Only texts that the filter of level 1 may have are looked up; the digests found are verified by bytes.
        """
        if self.all_bits is None:
            self.all_bits = self._write_filter(self.level1(), f"{self.merged}-all")
        asked = docs.select("doc_id", "text")
        maybe = self._probed(self._keyed(asked, F.col("norm"), F.col("whole").alias("text")), f"{self.merged}-all", self.all_bits).where("maybe")
        known = self._keyed(self._docs(), F.col("norm")).select("digest", "norm")
        return maybe.join(self.level1().select("digest"), "digest", "left_semi").join(known, ["digest", "norm"], "left_semi").select("doc_id", "text")

    def _collided(self) -> DataFrame:
        """Digests that stand for more than one text, found by comparing the bytes of all hits.

        Only hits are read closely: their filter is probed in the scan, and grouping by the text
        itself combines copies before anything is shuffled.
        """
        found = self._hits(self._keyed(self._docs(), F.col("norm")).select("digest", "norm")).where("maybe")
        texts = found.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("copies"))
        return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("digest")

    def classes(self) -> DataFrame:
        """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
        index = self.level1()
        rows = self._hits(self.spark.read.parquet(*self.runs))
        total = index.agg(F.sum("group_size")).first()[0] or 0
        path = f"{self.path}/collided-{len(self.runs)}"
        self._collided().write.mode("overwrite").parquet(path)
        collided = self.spark.read.parquet(path)
        joined = hot_join(rows.where("maybe").drop("maybe"), self._hits(index).where("maybe").drop("maybe"), ["digest"], "group_size", total)
        if not collided.isEmpty():
            joined = joined.join(collided, "digest", "left_anti").unionByName(self._by_bytes(collided).select(*joined.columns))
        kept = (F.col("run") == F.col("keep_run")) & (F.col("place") == F.col("keep_place"))
        sha = F.lower(F.hex("sha")).alias("text_sha256")
        alone = rows.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
        return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), sha).unionByName(alone)

    def _by_bytes(self, collided: DataFrame) -> DataFrame:
        """The rows of digests that stand for several texts, told apart by the texts themselves."""
        rows = self._keyed(self._docs(), F.col("norm")).join(collided, "digest", "left_semi")
        rows = written(rows.withColumns({"run": F.lit(0), "place": F.monotonically_increasing_id()}), "collided-rows")
        best = rows.groupBy("digest", "norm").agg(F.min(self._first()).alias("first"), F.count(F.lit(1)).alias("group_size"))
        return rows.join(self._index(best, "digest", "norm"), ["digest", "norm"])


def exact_classes(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Texts are equal when identical without white space. Of equal ones the row with the most code
    points in the original text, then the smallest doc_id, is kept. A null text counts as empty, a null doc_id comes
    last; repeated rows are returned each, one of them kept; an empty table gives an empty result.
    """
    index = DigestIndex(docs.sparkSession, digest_bytes=digest_bytes)
    index.flush(docs)
    index.compact()
    return index.classes()


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents without the copies that exact_classes doesn't keep; all columns of docs stay.

    A document is a doc_id and a text, so of rows that repeat both one stays. Null and empty texts are equal, so
    one row of them stays; a null doc_id is one like any other. Columns may have any names; an empty table stays empty.
    """
    own, sha, place = free_names(docs, 3)
    kept = exact_classes(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    keyed = docs.withColumn(sha, F.sha2(without_spaces(F.col("text")), 256)).withColumn(own, F.col("doc_id").cast("long"))
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # Before the join, so that no key of it is hot: Spark limits each group to a row in the tasks that read it.
        first = Window.partitionBy(own, sha).orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))))
        keyed = keyed.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    left = keyed.join(kept, keyed[own].eqNullSafe(kept["kept_id"]) & (keyed[sha] == kept["kept_sha"]), "left_semi")
    return left.drop(own, sha)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
