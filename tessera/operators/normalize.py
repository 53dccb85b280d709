"""Tickets, commits, documentation and logs as one table of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import resolve_owner, resolve_service, services_in
from ..functions.text import none, owner_line, strip

COLUMNS = ["id", "type", "title", "body", "owner", "services_mentioned", "timestamp", "source", "priority", "status"]


def _null() -> Column:
    return F.lit(None).cast("string")


def _known(service: Column) -> Column:
    return F.coalesce(resolve_service(service), service)


def _record(df: DataFrame, source: str, kind: str, **cols: Column) -> DataFrame:
    fixed = {"type": F.lit(kind), "source": F.lit(source), "priority": _null(), "status": _null()}
    order = [F.col("ord")] if "ord" in df.columns else [F.monotonically_increasing_id().alias("ord")]
    return df.select(*order, *[(cols | {k: v for k, v in fixed.items() if k not in cols})[c].alias(c) for c in COLUMNS])


def normalize_docs(docs: DataFrame) -> DataFrame:
    body = F.col("body")
    return _record(docs, "confluence", "doc", id=F.col("id"), title=F.col("title"), body=strip(body), owner=resolve_owner(owner_line(body)), services_mentioned=services_in(body), timestamp=F.col("last_updated"))


def normalize_tickets(tickets: DataFrame) -> DataFrame:
    services = F.coalesce(F.transform("services_affected", _known), F.array().cast("array<string>"))
    return _record(tickets, "jira", "ticket", id=F.col("id"), title=F.col("summary"), body=strip(F.col("description")), owner=resolve_owner(F.col("assignee")), services_mentioned=services, timestamp=F.col("created"), priority=F.col("priority"), status=F.col("status"))


def normalize_commits(commits: DataFrame) -> DataFrame:
    """A missing pull request and an explicit null both read N/A."""
    said = [("Author: ", F.col("author")), ("\nRepo: ", F.col("repo")), ("\nFiles changed: ", F.array_join("files_changed", ", ")), ("\nPR: ", F.coalesce("pr", F.lit("N/A")))]
    body = F.concat(*[x for label, value in said for x in (F.lit(label), none(value))])
    return _record(commits, "github", "commit", id=F.col("sha"), title=F.col("message"), body=body, owner=resolve_owner(F.col("author")), services_mentioned=F.array(_known(F.col("repo"))), timestamp=F.col("timestamp"))


def normalize_logs(logs: DataFrame) -> DataFrame:
    title = F.concat(F.lit("["), F.col("level"), F.lit("] "), F.col("service"), F.lit(": "), F.substring("message", 1, 80))
    priority = F.when(F.col("level") == "ERROR", "P1").otherwise("P2")
    return _record(logs, "logs", "log", id=F.col("id"), title=title, body=F.col("message"), owner=_null(), services_mentioned=F.array(_known(F.col("service"))), timestamp=F.col("timestamp"), priority=priority, status=F.lit("active"))


#: In the order in which records count as ingested.
SOURCES = {"confluence": normalize_docs, "jira": normalize_tickets, "github": normalize_commits, "logs": normalize_logs}
#: Rows that a source can have before its order runs into the next one's.
STRIDE = 1 << 56


def normalize_all(sources: dict[str, DataFrame]) -> DataFrame:
    """All records of the sources given, in a fixed order of sources; `ord` is the order of ingestion."""
    out = None
    for i, (name, normalize) in enumerate(SOURCES.items()):
        if name in sources:
            own = normalize(sources[name]).withColumn("ord", F.col("ord") + F.lit(i * STRIDE))
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no source is given")
    return out
