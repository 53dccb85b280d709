"""Keyed tables as Parquet: created when missing, added to by files of their own, merged when read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


#: Additions that a table has at most before they are merged into one.
MOST_PARTS = 16


class Table:
    """A table of one row per key, as a base and additions to it, each a folder that its job marks as complete.

    `add` folders hold rows of new keys, `put` folders rows that replace what has their key. A reader merges what
    was complete when it looked; so it sees the old rows or the new ones, never a mixture. What an addition
    costs depends on its own rows and on the table's keys; after MOST_PARTS of them a new base is written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _parts(self) -> list[str]:
        """The names of the complete parts, in order: number, kind, a random end."""
        p, fs = _fs(self.spark, f"{self.path}/parts")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _live(self) -> list[str]:
        parts = self._parts()
        bases = [i for i, name in enumerate(parts) if "-base-" in name]
        return parts[bases[-1] :] if bases else parts

    def _write(self, rows: DataFrame, kind: str) -> str:
        parts = self._parts()
        n = int(parts[-1].split("-")[0]) + 1 if parts else 0
        path = f"{self.path}/parts/{n:012d}-{kind}-{uuid.uuid4().hex[:8]}"
        rows.select(*self._empty().columns).write.parquet(path)
        return path

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _load(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/parts/{x}" for x in names])

    def read(self) -> DataFrame:
        out, waiting = None, []
        for name in self._live():
            if "-put-" not in name:
                waiting.append(name)
                continue
            put = self._load([name])
            before = [x for x in (out, self._load(waiting) if waiting else None) if x is not None]
            out, waiting = put, []
            for old in before:
                out = out.unionByName(old.join(put.select(self.key), self.key, "left_anti"))
        rest = [self._load(waiting)] if waiting else []
        for more in rest:
            out = more if out is None else out.unionByName(more)
        return self._empty() if out is None else out

    def replace(self, rows: DataFrame) -> None:
        """A new base. What came before the former base is deleted; that one stays for who still reads it."""
        former = self._live()
        self._write(rows, "base")
        p, fs = _fs(self.spark, f"{self.path}/parts")
        for old in self._parts():
            if former and old < former[0]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p, old), True)

    def _merge(self) -> None:
        if len(self._live()) > MOST_PARTS:
            self.replace(self.read())

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace what has their key; of rows that share one the least in all their columns counts."""
        self._write(self._first(rows, None), "put")
        self._merge()

    def _first(self, rows: DataFrame, order: str | None) -> DataFrame:
        columns = self._empty().columns
        least = F.min(F.struct(*[F.col(c).alias(f"by_{i}") for i, c in enumerate([order] if order else [])], *columns))
        return rows.groupBy(F.col(self.key).alias("shared")).agg(least.alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns])

    def append_absent(self, rows: DataFrame, order: str | None = None) -> tuple[int, int]:
        """Add rows whose key isn't there; the numbers added and left out. Of rows that share a key the first by
        `order`, if given, then by all columns, is added."""
        added = self.add_absent(rows, order).count()
        return added, rows.count() - added

    def add_absent(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """As append_absent; the rows that were added."""
        new = self._first(rows, order).join(self.read().select(self.key), self.key, "left_anti")
        path = self._write(new, "add")
        added = self.spark.read.schema(self.schema).parquet(path)
        self._merge()
        return added


def cache_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, schemas.CACHE, "text_hash")


def manifest_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, schemas.MANIFEST, "record_id")


def chunk_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, schemas.CHUNKS, "chunk_id")


def vector_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, schemas.VECTORS, "id")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys; the optimiser broadcasts whichever side is small."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def by_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one key, by a filter that reaches the files; empty without it."""
    return rows.where(F.col(key) == value).limit(1)
