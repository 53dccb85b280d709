"""A small corpus of our own: documentation, tickets, commits and logs of invented services."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

DOCS = [
    ("WIKI-7", "Inventory Service Handbook", "\n# Shelf counts\nOwner: Priya M. (priya@company.com)\nCounts boxes on shelves and answers the kiosk.\n## Dependencies\n- redis-cache (hot shelves)\n- postgres-primary\n\n- ml-feature-store (demand)\n# Colophon\n- no dependency of ours\n", "confluence", "2027-03-02"),
    ("inventory_service_guide", "Counting days", "Owner: James\nHow a stocktake is run.\nDependencies\n- barcode-reader\n- inventory-service (itself)", "confluence", "2027-01-19"),
    ("WIKI-9", "Fraud Detection Field Notes", "OWNER: rahul\nOn-call: James Liu (james@company.com)\nAsks payments before scoring. Escalation: wake the analyst\nWatched by the kiosk, as is the redis.", "confluence", "2027-02-11"),
    ("WIKI-12", "Kiosk Screens", "Owner: Vendor Desk\nPaints the feature-store banner; reads postgres-fraud. See Shop Floor Manual.", "confluence", "2027-01-30"),
]
TICKETS = [
    ("OPS-31", "Shelf counts freeze", " The inventory count stands still for 45 minutes, caused by redis-cache. Fixes OPS-9 maybe. ", "priya@company.com", "james", "open", "P1", ["inventory", "redis"], "2027-03-05T06:20:00Z", "jira"),
    ("OPS-32", "Scores arrive late", "fraud-detection depends on ml-feature-store and lags on Mondays.", "james liu", "priya", "open", None, ["fraud detection", "unheard-of"], "2027-02-22T10:05:00Z", "jira"),
    ("OPS-33", "Label wording", "Wording on the kiosk label, and a word on fraud_detection.", None, "james", "closed", "P3", [], "2027-01-08T16:40:00Z", "jira"),
    ("OPS-34", "Barcode retries", "inventory-service retries 429 too often.", "", "james", "in progress", "P2", ["inventory_service"], "2027-03-06T12:15:00Z", "jira"),
    ("OPS-35", "Scores of returns", "Returns skew fraud_detection scores.", "rahul", "priya", "open", "", [], "2027-03-07T09:00:00Z", "jira"),
]
COMMITS = [
    ("e4d5c6b", "PR-58 lower redis-cache window from 90 ms to 75ms", "priya@company.com", "redis cache", ["lib/window.go", "ops/shelf.yml"], "2027-03-04T19:30:00Z", "PR-58", "github"),
    ("9a8b7c6", "Batch shelf writes", "james@company.com", "inventory_service", ["batch.ts"], "2027-02-20T13:00:00Z", None, "github"),
    ("5f4e3d2", "Fixed OPS-31 in inventory-service", "rahul@company.com", "inventory", [], "2027-03-06T07:45:00Z", "PR 61", "github"),
    ("77aa88b", "Tidy imports", "bot@depot.example", "scripts", ["setup.cfg"], "2027-01-03T05:10:00Z", "pr-3", "github"),
]
LOGS = [
    ("EV-900", "ERROR", "inventory", "redis-cache unresponsive: timeout on shelf 12 of redis-cache after 140ms, kept the old count and put the scan in a queue", "2027-03-05T06:18:00Z", "logs"),
    ("EV-901", "ERROR", "kiosk", "429 Too Many Requests from inventory-service", "2027-03-06T12:11:00Z", "logs"),
    ("EV-902", "WARN", "postgres", "Vacuum Running since midnight", "2027-03-01T04:00:00Z", "logs"),
    ("EV-903", "INFO", "fraud detection", "modified scores/weekly.json", "2027-02-22T10:00:00Z", "logs"),
]
#: question, number of sources, answer
ANSWERS = [
    ("a", 5, "A is x [1]. B is y [9]. C z [2][7]! D\nE [0]."),
    ("b", 0, "Nothing [1] is known. Still [x] said."),
    ("c", 2, "One [1]. Two [2]. One again [1] [01]."),
    ("d", 1, None),
    ("e", 3, "Padded [007]. Large [99999999999]. Fine [3].\n"),
]
JSON_ANSWERS = [
    ("plain", '{"entities": [{"id": "a", "type": "service", "name": "A"}], "relationships": []}'),
    ("fenced", '```json\n{"entities": [{"id": "b"}], "relationships": [{"from_id": "b", "relation": "owns", "to_id": "c"}]}\n```'),
    ("wrapped", 'Here it is: {"entities": [], "relationships": [{"from": "x", "relation": "affects", "to": "y"}]} as asked.'),
    ("broken", '{"entities": [{"id": "z"'),
    ("prose", "I found nothing."),
]
TABLES = {"confluence": (DOCS, schemas.DOCS), "jira": (TICKETS, schemas.TICKETS), "github": (COMMITS, schemas.COMMITS), "logs": (LOGS, schemas.LOGS)}


def sources(spark: SparkSession) -> dict[str, DataFrame]:
    """The four exports, with the order of their rows."""
    return {name: spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema + ", ord long") for name, (rows, schema) in TABLES.items()}


def answers(spark: SparkSession) -> DataFrame:
    """ANSWERS with their sources."""
    own = spark.createDataFrame(ANSWERS, "id string, n int, answer string")
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))

    def source(i):
        return F.struct(F.format_string("c%d", i).alias("chunk_id"), F.lit("f.md").alias("filename"), (i - 1).alias("chunk_index"), F.col("n").alias("total_chunks"), F.lit("t").alias("text"))

    return own.withColumn("sources", F.transform(numbers, source))


def write_raw(folder: str) -> None:
    """The exports as JSON files, one array each, in a local folder."""
    import os

    os.makedirs(folder, exist_ok=True)
    for name, (rows, schema) in TABLES.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        with open(f"{folder}/{name}.json", "w", encoding="utf-8") as file:
            json.dump([dict(zip(columns, row)) for row in rows], file)


def sql_values(rows: list[tuple], columns: str) -> str:
    """The rows as SQL that DuckDB runs."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]::VARCHAR[]"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns})"
