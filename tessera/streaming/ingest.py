"""Continuous ingest: new files of a folder become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.build import ingest
from ..sources.files import EXTENSIONS, base_name, extension


def ingest_stream(spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = False, config: Config = Config()) -> StreamingQuery:
    """A stream over the files below a folder. Each batch adds the chunks that aren't stored yet, so a batch run again adds nothing twice.

    With `once`, what is there is taken in and the stream ends.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    wanted = files.where(extension(files["path"]).isin(*EXTENSIONS)).select("path", base_name(files["path"]).alias("filename"), "content")

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            ingest(spark, rows, store, config=config)

    writer = wanted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
