"""Tables that cut a plan in two, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that is unset, and only in local mode, a temporary folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_cleaned: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table. All of an application's lie in one folder, which is deleted when the driver ends."""
    if (app := spark.sparkContext.applicationId) not in _cleaned:
        _cleaned.add(app)
        atexit.register(_end, spark)
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's tables; frames that read them no longer work."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _end(spark: SparkSession) -> None:
    """A driver that ends while its context is up cleans; else the folder is left to whoever owns it."""
    try:
        clean_scratch(spark)
    except Exception:
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the frame as a Parquet table in the shared folder, committed task by task."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
