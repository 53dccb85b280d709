"""The graph as tables, and as node-link JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from .tables import exists

#: Lines of node-link JSON beside its nodes and links.
HEAD, MIDDLE, END = '{"directed": true, "multigraph": false, "graph": {}, "nodes": [', '], "links": [', "]}"


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    if not exists(spark, f"{path}/nodes"):
        raise FileNotFoundError(f"there is no graph at {path}; build it first")
    return spark.read.schema(schemas.NODES).parquet(f"{path}/nodes"), spark.read.schema(schemas.EDGES).parquet(f"{path}/edges")


def export_json(nodes: DataFrame, edges: DataFrame, path: str, files: int | None = None) -> None:
    """Node-link JSON, a node or link a line, in so many files whose order is that of their names (None: as many as the sort gives; 1 makes one task sort and write all): {"directed", "multigraph", "graph", "nodes": [{"id", ...}], "links": [{"source", "target", ...}]}."""
    attributes = [c for c in nodes.columns if c not in ("id", "ord")]
    link = F.struct(F.col("from_id").alias("source"), F.col("to_id").alias("target"), "relation", "confidence", "extraction_source")
    spark, kind = nodes.sparkSession, "section int, ord long, key string, value string"
    parts = [
        spark.createDataFrame([(0, 0, "", HEAD), (2, 0, "", MIDDLE), (4, 0, "", END)], kind),
        nodes.select(F.lit(1).alias("section"), "ord", F.col("id").alias("key"), F.to_json(F.struct("id", *attributes)).alias("value")),
        edges.select(F.lit(3).alias("section"), F.lit(0).cast("long").alias("ord"), F.concat_ws("\u0000", "from_id", "to_id").alias("key"), F.to_json(link).alias("value")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # A comma before each but the first of its section: a row for each section says which that is.
    first = rows.where("section IN (1, 3)").groupBy("section").agg(F.min(F.struct("ord", "key")).alias("first"))
    led = rows.join(F.broadcast(first), "section", "left").withColumn("value", F.when(F.struct("ord", "key") > F.col("first"), F.concat(F.lit(","), "value")).otherwise(F.col("value")))
    order = ["section", "ord", "key"]
    lined = led.orderBy(*order) if files is None else led.repartitionByRange(files, *order).sortWithinPartitions(*order)
    lined.select("value").write.mode("overwrite").text(path)


def export_lines(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as JSON lines in two folders, for graphs that no one file should hold."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def import_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schemas.NODES).json(f"{path}/nodes"), spark.read.schema(schemas.EDGES).json(f"{path}/edges")


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes, edges from node-link JSON with its edges under "links" or "edges"; `ord` is a node's place.

    What export_json wrote is read line by line, in as many tasks as its files have blocks. JSON in any other layout is one value, which a
    task has to hold whole.
    """
    node = ", ".join(c for c in schemas.NODES.split(", ") if c != "ord long").replace(" ", ":").replace(",:", ",")
    link = "source:string,target:string,relation:string,confidence:double,extraction_source:string"
    if spark.read.text(path).where(F.col("value") == HEAD).isEmpty():
        whole = spark.read.schema(f"nodes array<struct<{node}>>, links array<struct<{link}>>, edges array<struct<{link}>>").option("multiLine", True).json(path)
        ns = whole.select(F.posexplode("nodes").alias("ord", "n"))
        es = whole.select(F.explode(F.coalesce("links", "edges")).alias("e"))
    else:
        nodes, links = _sections(spark, path)
        ns = nodes.select("ord", F.from_json("json", f"struct<{node}>").alias("n"))
        es = links.select(F.from_json("json", f"struct<{link}>").alias("e"))
    ns = ns.select("n.*", F.col("ord").cast("long").alias("ord"))
    es = es.select(F.col("e.source").alias("from_id"), F.col("e.target").alias("to_id"), "e.relation", "e.confidence", "e.extraction_source")
    return ns.select(*[c.split()[0] for c in schemas.NODES.split(", ")]), es


def _sections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """ord, json of the lines with nodes, and json of those with links.

    A line's place is its file, its block of that file, and its number among what its task reads, where a block's lines are consecutive.
    """
    block = ["file", "start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    place = F.struct(*block, "n")
    middle = lines.where(F.col("value") == MIDDLE).select(place.alias("middle"))  # one line
    json = F.when(F.col("value").startswith(","), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    parts = lines.where(~F.col("value").isin(HEAD, MIDDLE, END)).crossJoin(F.broadcast(middle)).withColumns({"json": json, "is_node": place < F.col("middle")})
    nodes, links = parts.where("is_node").select(*block, "n", "json"), parts.where("NOT is_node").select("json")
    # A row for each block of a file.
    counts = nodes.groupBy(*block).agg(F.count(F.lit(1)).alias("nodes"), F.min("n").alias("first"))
    before = counts.withColumn("before", F.sum("nodes").over(Window.orderBy(*block)) - F.col("nodes")).drop("nodes")
    return nodes.join(F.broadcast(before), block).select((F.col("before") + F.col("n") - F.col("first")).alias("ord"), "json"), links
