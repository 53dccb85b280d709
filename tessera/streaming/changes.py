"""A stream of records that remembers their hashes and lets through what is new or changed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import content_hash
from ..operators.normalize import COLUMNS, SOURCES
from ..sources.files import RAW

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Known(StatefulProcessor):
    """Keeps the last hash of an id. Rows of one batch count in the order of `ord`, then of their hashes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = self.last.get()
        first = known = None if before is None else before[0]
        for r in sorted(rows, key=lambda r: (r.ord is None, r.ord or 0, r.content_hash)):
            if r.content_hash != known:
                yield Row(**r.asDict(), change="new" if known is None else "changed")
                known = r.content_hash
        if known != first:
            self.last.update((known,))

    def close(self) -> None:
        pass


def changes(records: DataFrame) -> DataFrame:
    """The rows of a stream (id, ord, title, body and more) whose text isn't what the last row of their id had, with content_hash and change
    ("new", "changed"). The state is a hash for each id, in the checkpoint; nothing else of earlier rows is read again. Rows without an id are left out."""
    keyed = records.where("id IS NOT NULL").withColumn("content_hash", content_hash(F.col("title"), F.col("body")))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields) + ", change string"
    return keyed.groupBy("id").transformWithState(_Known(), outputStructType=kind, outputMode="Append", timeMode="None")


def write_changes(records: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream of changes into files by kind of change. With `once` it takes what is there and ends."""
    spark = records.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # what keeps such state; a query has its own copy of the settings once it has started
    try:
        writer = changes(records).writeStream.format("parquet").partitionBy("change").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def export_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Exports of one source ("jira", "github", ...) that arrive in a folder, each a JSON array, as a stream of records.

    Files that can't be read or aren't JSON give no records; they don't end the stream.
    """
    reader = spark.readStream.schema(RAW[name]).option("multiLine", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    rows = reader.json(folder).withColumn("ord", F.unix_micros(F.col("_metadata.file_modification_time")))
    return SOURCES[name](rows).select("ord", *COLUMNS)
