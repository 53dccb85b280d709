"""Build the context graph of all exports, and a report of every service: who answers for it, what is open, what changed last.

    python jobs/service_report.py --tables PATH --output PATH [--config FILE]

Reads the tables documents, orders, part and events as documentation, tickets, commits and logs; writes OUTPUT/records (by
source), OUTPUT/nodes (by type), OUTPUT/edges (by relation) and OUTPUT/services, each below a folder of the snapshot that the config names. A run
replaces that snapshot and no other, so it can be repeated at any time, also after one that was broken off.
"""

from __future__ import annotations

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
if os.path.dirname(HERE) not in sys.path:
    sys.path.insert(0, os.path.dirname(HERE))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import LOG, command_line, new_folder  # noqa: E402
from tessera import schemas  # noqa: E402
from tessera.functions.text import none  # noqa: E402
from tessera.operators.extract import extract_with_rules  # noqa: E402
from tessera.operators.graph_build import build_edges, build_nodes  # noqa: E402
from tessera.operators.graph_query import CLOSED  # noqa: E402
from tessera.operators.normalize import normalize_all  # noqa: E402
from tessera.plans import given, oracle  # noqa: E402
from tessera.sources.scratch import written  # noqa: E402

SETTINGS = {"snapshot": "latest", "resolved": False}


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each service that records mention.

    Mentions meet the records' nodes by one join and are summed up in each task before they are shuffled by service; so a service that
    most records mention is no hot key.
    """
    c = F.col
    mention = edges.where("relation = 'mentions'").select(c("from_id").alias("id"), c("to_id").alias("service_id"))
    said = mention.join(nodes.select("id", "ord", "type", "owner", "timestamp", "priority", "status"), "id")
    open_ = (c("type") == "ticket") & ~none(c("status")).isin(*CLOSED)
    owned = (c("type") == "doc") & (none(c("owner")) != "")
    summed = said.groupBy("service_id").agg(
        F.count_if(c("type") == "doc").alias("documents"), F.count_if(c("type") == "ticket").alias("tickets"), F.count_if(open_).alias("open_tickets"), F.min(F.when(open_ & (none(c("priority")) != ""), c("priority"))).alias("most_urgent"),
        F.count_if(c("type") == "commit").alias("commits"), F.max(F.when(c("type") == "commit", c("timestamp"))).alias("last_change"), F.count_if((c("type") == "log") & (c("priority") == "P1")).alias("errors"), F.min_by("owner", F.when(owned, c("ord"))).alias("owner"),
    )
    return summed.join(nodes.select(c("id").alias("service_id"), "name"), "service_id", "left")


def run(spark: SparkSession, tables: str, output: str, settings: dict = SETTINGS) -> dict:
    """Write the snapshot; returns how many rows each of its tables has."""
    snapshot = f"snapshot={settings['snapshot']}"

    def write(rows: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{output}/{name}/{snapshot}"
        rows.write.mode("overwrite").partitionBy(*by).parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    exports = given.exports(spark, tables)
    records = write(extract_with_rules(normalize_all(exports)), "records", "source")
    nodes = write(build_nodes(records).select(*[x.split()[0] for x in schemas.NODES.split(", ")]), "nodes", "type")
    edges = write(build_edges(records, written, settings["resolved"]), "edges", "relation")
    services = write(report(nodes, edges), "services")
    done = {name: df.count() for name, df in (("records", records), ("nodes", nodes), ("edges", edges), ("services", services))}
    LOG.info("read %d records of %s from %s, wrote %s to %s, %s", done["records"], ", ".join(exports), tables, done, output, snapshot)
    return done


def job2_service_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every service's row of the report, with its edges as they were written, after two runs."""
    folder = new_folder(spark, "job2-service-report")
    for _ in range(2):
        run(spark, sf_dir, folder)
    services, edges = (spark.read.parquet(f"{folder}/{name}") for name in ("services", "edges"))
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("service_id")).groupBy("service_id").agg(F.count(F.lit(1)).alias("degree"))
    return services.drop("snapshot").join(ends, "service_id", "left")


ORACLE_SQL = f"""
WITH {oracle.CORPUS}, edges AS (SELECT from_id, to_id, arg_max(relation, place) AS relation FROM edge_writes GROUP BY from_id, to_id),
mentioned AS (SELECT e.to_id AS service_id, r.*, r.type = 'ticket' AND coalesce(status, '') NOT IN {CLOSED} AS open FROM edges e JOIN records r ON r.id = e.from_id WHERE relation = 'mentions'),
summed AS (SELECT service_id, count(*) FILTER (type = 'doc') AS documents, count(*) FILTER (type = 'ticket') AS tickets, count(*) FILTER (open) AS open_tickets, min(priority) FILTER (open AND priority <> '') AS most_urgent,
           count(*) FILTER (type = 'commit') AS commits, max(timestamp) FILTER (type = 'commit') AS last_change, count(*) FILTER (type = 'log' AND priority = 'P1') AS errors, arg_min(owner, ord) FILTER (type = 'doc' AND owner <> '') AS owner FROM mentioned GROUP BY service_id),
ends AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id)
SELECT s.*, n.name, e.degree FROM summed s LEFT JOIN nodes n ON n.id = s.service_id LEFT JOIN ends e ON e.id = s.service_id
"""

if __name__ == "__main__":
    command_line(__doc__, ("tables", "output"), os.path.join(HERE, "service_report.json"), SETTINGS, run)
