"""The given tables as the four exports that the engine reads: documents as documentation, orders as tickets, parts as commits, events as logs.

What an export has and a table lacks (services, owners, what a ticket says) follows from the row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aliases import OWNERS, SERVICES
from ..functions.text import none

NAMES = list(SERVICES)
MAILS = [x for x in OWNERS if "@" in x]
#: Who writes documentation; who tickets are given to.
WRITERS = [*OWNERS, "Vendor Desk"]
ASSIGNEES = [*OWNERS, "Vendor Desk", "", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A few files of one row group give a few tasks, however many splits they have; deal the rows of such out evenly."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * least or len(df.inputFiles()) >= least else df.repartition(least)


# Expressions as SQL text: one call makes each, however many names it lists.
def _quoted(text: str | None) -> str:
    return "CAST(NULL AS string)" if text is None else f"'{text}'"


def _pick(values: list, n: str) -> str:
    return f"array({', '.join(map(_quoted, values))})[pmod({n}, {len(values)})]"


def _name(n: str) -> str:
    return _pick(NAMES, n)


def _of(n: str, size: int, *values: str) -> str:
    """The value whose place is n modulo size; the last one for all places beyond."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE pmod({n}, {size}) {arms} ELSE {values[-1]} END"


def _text(*parts: str) -> str:
    """Parts as one text; those that begin with "=" are themselves, others are expressions, of which nulls are empty."""
    return "concat({})".format(", ".join(_quoted(p[1:]) if p.startswith("=") else f"coalesce(CAST({p} AS string), '')" for p in parts))


def documentation(documents: DataFrame) -> DataFrame:
    n = "doc_id"
    owner = _text(_pick(WRITERS, n), _of(n, 2, _text("= (", _pick(MAILS, n), "=)"), "''"))
    body = _text("=Owner: ", owner, "=\nOn-call: ", _pick(WRITERS, f"{n} + 3"), "=\n## Dependencies\n- ", _name(f"{n} + 1"), "= (", "lang", "=)\n- ", _name(f"{n} + 7"), "=\n# Text\n", "text")
    key = f"replace({_pick([SERVICES[x] for x in NAMES], n)}, '-', '_')"
    return documents.selectExpr(
        _of(n, 5, _text(key, "=_guide_", n), _text("=WIKI-", n)) + " AS id", _of(n, 2, _text(_name(n), "= handbook"), _text("=Notes of ", "source")) + " AS title", body + " AS body",
        "'confluence' AS source", _text("=2024-01-", f"lpad(pmod({n}, 28) + 1, 2, '0')") + " AS last_updated", f"{n} AS ord",
    )


def tickets(orders: DataFrame) -> DataFrame:
    n = "o_orderkey"
    said = _of(
        n, 6, _text("= ", _name(n), "= stands still, caused by ", _name(f"{n} + 5"), "=. Fixes OPS-", f"{n} - 1", "= "), _text(_name(n), "= depends on ", _name(f"{n} + 5"), "= and lags"), _text("=Wording of ", _name(n), "=, see PR-", f"{n} % 1000"),
        _text(_name(n), "= unresponsive: timeout in ", _name(f"{n} + 5"), "= after ", f"{n} % 900", "= ms"), _text("=returned ", f"{n} % 150 + 400", "= to ", _pick(MAILS, n)), _text("=modified lib/x", n, "=.go by the Shop Floor Manual"),
    )
    services = _of(n, 4, "CAST(array() AS array<string>)", f"array({_name(n)})", f"array({_name(n)}, 'unheard-of')", f"array({_name(n)}, {_name(f'{n} + 9')})")
    return orders.selectExpr(
        _text("=OPS-", n) + " AS id", _text(_name(n), "= ", "lower(substring(o_orderpriority, 3, 40))") + " AS summary", said + " AS description", _pick(ASSIGNEES, n) + " AS assignee", "'james' AS reporter", "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'in progress' END AS status",
        _of(n, 11, "CAST(NULL AS string)", "''", _text("=P", "substring(o_orderpriority, 1, 1)")) + " AS priority", services + " AS services_affected", "date_format(o_orderdate, 'yyyy-MM-dd') AS created", "'jira' AS source", f"{n} AS ord",
    )


def commits(parts: DataFrame) -> DataFrame:
    n = "p_partkey"
    message = _of(n, 3, _text("=PR-", n, "= lower ", _name(n), "= window to ", "p_size", "=ms"), _text("=Fixed OPS-", n, "= in ", _name(n)), "p_name")
    changed = _of(n, 4, "CAST(array() AS array<string>)", f"array({_text('=lib/', 'lower(p_type)', '=.go')}, {_text('=ops/', n, '=.yml')})")
    return parts.selectExpr(
        f"substring(md5(CAST({n} AS string)), 1, 12) AS sha", message + " AS message", _pick(WRITERS, n) + " AS author", _name(n) + " AS repo", changed + " AS files_changed",
        _text("=2025-02-", f"lpad(pmod({n}, 28) + 1, 2, '0')") + " AS timestamp", _of(n, 3, _text("=PR-", n), "CAST(NULL AS string)") + " AS pr", "'github' AS source", f"{n} AS ord",
    )


def logs(events: DataFrame) -> DataFrame:
    n, kind = "event_id", "event_type"
    said = _of(
        n, 4, _text(_name(n), "= unresponsive: timeout on shelf ", f"{n} % 100", "= of ", _name(f"{n} + 5"), "= after ", f"{n} % 200", "=ms, kept the old count and put the scan in a queue"), _text(f"{n} % 150 + 400", "= Too Many Requests from ", _name(n)),
        _text("=Vacuum Running since ", kind), _text("=modified ", kind, "=/weekly.json ", "props"),
    )
    level = f"CASE {kind} WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END"
    return events.selectExpr(_text("=EV-", n) + " AS id", level + " AS level", f"CASE WHEN {n} % 5 < 4 THEN {_name(n)} ELSE {kind} END AS service", said + " AS message", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS timestamp", "'logs' AS source", f"{n} AS ord")


#: Each export: the table it comes from, and how.
EXPORTS = {"confluence": ("documents", documentation), "jira": ("orders", tickets), "github": ("part", commits), "logs": ("events", logs)}


def exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: make(spread(table(spark, sf_dir, source))) for name, (source, make) in EXPORTS.items()}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n, answer, sources: what an assistant says in a conversation, citing sources that are there and such as aren't."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first, second = (F.expr(_text("= [", f"{c} % {m}", "=].")) for c, m in (("turn", 7), ("conv_id", 4)))
    answer = F.regexp_replace(F.regexp_replace("text", F.lit(r"\.\n"), F.concat(first, F.lit("\n"))), F.lit(r"\. "), F.concat(second, F.lit(" ")))
    own = said.select(F.expr(_text("conv_id", "=-", "turn")).alias("id"), F.expr("CAST(conv_id % 6 AS int)").alias("n"), answer.alias("answer"), F.substring(none(F.col("text")), 1, 60).alias("quoted"))
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))

    def source(i: Column) -> Column:
        return F.struct(F.format_string("c%d", i).alias("chunk_id"), F.concat("id", F.lit(".md")).alias("filename"), (i - 1).alias("chunk_index"), F.col("n").alias("total_chunks"), F.col("quoted").alias("text"))

    return own.withColumn("sources", F.transform(numbers, source)).drop("quoted")


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, raw: events as a model's answers in JSON: plain, in fences, in prose, broken off, and not at all."""
    e = table(spark, sf_dir, "events")
    n, kind = "event_id", "event_type"
    raw = _of(
        n, 5, _text('={"entities": [{"id": "', kind, '=", "type": "service", "name": "A"}], "relationships": []}'),
        _text('=```json\n{"entities": [{"id": "', kind, '="}], "relationships": [{"from_id": "', kind, '=", "relation": "owns", "to_id": "c"}]}\n```'),
        _text('=Here it is: {"entities": [], "relationships": [{"from": "', kind, '=", "relation": "affects", "to": "y"}]} as asked.'), _text('={"entities": [{"id": "', kind, '="'), _text("=I found nothing of ", kind),
    )
    return spread(e).selectExpr(f"{n} AS id", raw + " AS raw")
