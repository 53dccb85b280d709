"""Nodes that stand for the same thing: a ticket and the entity that names it, a person and their address, a service and its other names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import OWNERS, SERVICES
from ..functions.text import engineer_id, service_id, snake
from ..sources.scratch import written

RECORDS = ("ticket", "commit", "doc", "log")


def known_links(nodes: DataFrame, services: dict[str, str] = SERVICES, owners: dict[str, str] = OWNERS) -> DataFrame:
    """a, b: nodes of the graph that are the same by how their ids are made.

    A record and the ticket or commit that an entity names; an engineer or an address and the name it stands for; a service
    and its other spellings. Both ends are nodes of the graph; the tables of names are small.
    """
    spark = nodes.sparkSession
    record = nodes.where(F.col("type").isin("ticket", "commit"))
    kind = F.when(F.col("type") == "ticket", snake("jira_ticket", F.col("id"))).otherwise(snake("commit_sha", F.col("id")))
    named = record.select(kind.alias("a"), F.col("id").alias("b"))

    def of_names(table: dict[str, str], ends: list[tuple[Column, Column]]) -> DataFrame:
        rows = spark.createDataFrame(list(table.items()), "said string, meant string")
        out = [rows.select(a.alias("a"), b.alias("b")) for a, b in ends]
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    said, meant = F.col("said"), F.col("meant")
    people = of_names(owners, [(engineer_id(said), engineer_id(meant)), (snake("email", said), engineer_id(meant))])
    spelled = of_names(services, [(service_id(said), service_id(meant))])
    links = named.unionByName(people).unionByName(spelled).where("a <> b").distinct()
    ids = nodes.select("id")
    for end in ("a", "b"):
        links = links.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return links


def groups(links: DataFrame) -> DataFrame:
    """id, least: every node that a link touches, with the least id of its component.

    Each round takes the least label among a node's neighbours, then that label's own; what is written is a row a node. Rounds are
    about as many as the logarithm of the longest way, and few here, as links are short.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "same-links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("least")), "same-labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("least").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.least("least", F.coalesce("near", "least")).alias("least"), F.col("least").alias("before"))
        jump = lower.select(F.col("id").alias("least"), F.col("least").alias("further"))
        new = written(lower.join(jump, "least", "left").select("id", F.least("least", F.coalesce("further", "least")).alias("least"), "before"), "same-labels")
        if new.where("least <> before").isEmpty():
            return new.select("id", "least")
        labels = new.drop("before")


def same_as(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, same: each node that isn't its group's representative, and that one: a record before other nodes, then the first that was ingested, then the least id."""
    of = groups(links)
    order = F.struct((~F.coalesce(F.col("type").isin(*RECORDS), F.lit(False))).alias("later"), F.coalesce("ord", F.lit(1 << 62)).alias("ord"), F.col("id").alias("id"))
    known = of.join(nodes.select("id", "type", "ord"), "id").select("id", "least", order.alias("place"))
    first = known.groupBy("least").agg(F.min("place").alias("first"))
    return known.join(first, "least").select("id", F.col("first.id").alias("same")).where("id <> same")


def merge(nodes: DataFrame, edges: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with nodes that are the same as one: under their representative's id, with its attributes, and what it lacks from the others in the order
    of ingestion. Edges lead between representatives; one within a group is gone; of several between two the surest counts, then the least relation."""
    mapped = nodes.join(same, "id", "left").withColumn("into", F.coalesce("same", "id"))
    place = F.struct(F.col("same").isNotNull().alias("other"), F.coalesce("ord", F.lit(1 << 62)).alias("ord"), F.col("id").alias("id"))
    columns = [c for c in nodes.columns if c != "id"]
    whole = mapped.withColumn("place", place).groupBy(F.col("into").alias("id")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("place"))).alias(c) for c in columns])
    ends = edges
    for end in ("from_id", "to_id"):
        ends = ends.join(same.select(F.col("id").alias(end), F.col("same").alias("into")), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
    surest = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("less"), F.col("relation").alias("relation"))
    kept = ends.where("from_id <> to_id OR from_id IS NULL").groupBy("from_id", "to_id").agg(F.min_by(F.struct("relation", "confidence", "extraction_source"), surest).alias("e"))
    return whole.select(*nodes.columns), kept.select("from_id", "to_id", "e.*")
