"""Questions to the graph: neighbourhood, owner, changes, incidents, dependencies.

`resolved` answers a question as meant; without it answers follow the plain rules, whose known
gaps are named at each function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aliases import services_in
from ..functions.text import dependency_lines, escalation_line, none, search_key

CLOSED = ("resolved", "closed", "done")


def service_node(nodes: DataFrame, name: str) -> DataFrame:
    """id of the node that a service's name stands for, if any: by either exact id, else the first service whose id or name has the name in it."""
    key = search_key(name)
    exact = {f"service__{name.replace('-', '_')}": 0, f"service__{name}": 1}
    fuzzy = (F.col("type") == "service") & (F.lower("id").contains(key) | F.lower(none(F.col("name"))).contains(key))
    place = F.when(F.col("id") == list(exact)[0], 0).when(F.col("id") == list(exact)[-1], 1).when(fuzzy, 2)
    return nodes.select("id", "ord", place.alias("place")).where("place IS NOT NULL").groupBy().agg(F.min_by("id", F.struct("place", "ord", "id")).alias("id")).where("id IS NOT NULL")


def start_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """id of the node itself, else of the first whose id has it in it, hyphens as underscores."""
    place = F.when(F.col("id") == node_id, 0).when(F.col("id").contains(node_id.replace("-", "_")), 1)
    return nodes.select("id", "ord", place.alias("place")).where("place IS NOT NULL").groupBy().agg(F.min_by("id", F.struct("place", "ord", "id")).alias("id")).where("id IS NOT NULL")


def reach(nodes: DataFrame, edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """id, hop of all nodes within so many hops of the start, in any direction. A hop joins its frontier, a small
    side that the optimiser may broadcast, to either end of the edges; hubs are reached once."""
    seen = start.select("id", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1).select("id")
        out = edges.join(front.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
        into = edges.join(front.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"))
        step = out.unionByName(into).withColumn("hop", F.lit(hop))
        # Every hop reads what was reached before.
        seen = seen.unionByName(step).groupBy("id").agg(F.min("hop").alias("hop")).persist()
    return seen.join(nodes.select("id"), "id", "left_semi")


#: Edges of a node and direction that its row shows at most.
SHOWN = 1000


def _shown(edges: DataFrame, near: DataFrame, own: str, other: str, columns: list[Column], name: str, count: str, shown: int) -> DataFrame:
    """id, <name>: its first edges by the other end, <count>: how many there are. Tasks drop what is beyond the first before they
    are shuffled, so that a hub is no large row, nor a large partition."""
    found = edges.join(near.select(F.col("id").alias(own)), own, "left_semi")
    numbered = found.withColumn("n", F.row_number().over(Window.partitionBy(own).orderBy(other))).where(F.col("n") <= shown)
    lists = numbered.groupBy(F.col(own).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*columns).alias("e")))), lambda x: x["e"]).alias(name))
    return lists.join(found.groupBy(F.col(own).alias("id")).agg(F.count(F.lit(1)).alias(count)), "id")


def edge_pages(edges: DataFrame, page: int = SHOWN) -> DataFrame:
    """id, direction ("out", "in"), page, edges (id, relation, confidence): all edges by either end, about so many to a row.

    A table of neighbours that is read by ids: a hub has as many pages as it needs, by hash of the other end.
    """
    sides = [edges.select(F.col(a).alias("id"), F.lit(d).alias("direction"), F.struct(F.col(b).alias("id"), "relation", "confidence").alias("e")) for a, b, d in (("from_id", "to_id", "out"), ("to_id", "from_id", "in"))]
    both = sides[0].unionByName(sides[1])
    hubs = both.groupBy("id", "direction").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > page)
    # Only hubs are joined: they are few, and AQE splits their rows where they are too many for one task.
    paged = both.join(hubs, ["id", "direction"], "left").withColumn("page", F.coalesce(F.pmod(F.xxhash64("e.id"), F.ceil(F.col("n") / page)), F.lit(0)).cast("int"))
    return paged.groupBy("id", "direction", "page").agg(F.array_sort(F.collect_list("e")).alias("edges"))


def context(nodes: DataFrame, edges: DataFrame, node_id: str, hops: int = 2, limit: int | None = None, shown: int = SHOWN) -> DataFrame:
    """The nodes within so many hops, in order of hop, then ingestion, with how many edges they have and the first `shown` of each direction, also
    those that lead out of the circle; edge_pages has all."""
    near = reach(nodes, edges, start_node(nodes, node_id), hops).persist()
    own = nodes.join(near, "id")
    relation = F.coalesce("relation", F.lit("unknown"))
    out = _shown(edges, near, "from_id", "to_id", [F.col("to_id").alias("to"), relation.alias("relation"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")], "outgoing_edges", "outgoing", shown)
    into = _shown(edges, near, "to_id", "from_id", [F.col("from_id").alias("from"), relation.alias("relation")], "incoming_edges", "incoming", shown)
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("name", F.lit("")), F.col("id"))
    plain = [none(F.col(c)).alias(c) for c in ("body", "owner", "timestamp", "source", "priority", "status")]
    full = own.join(out, "id", "left").join(into, "id", "left")
    shown = full.select("hop", "ord", "id", F.coalesce("type", F.lit("unknown")).alias("type"), title.alias("title"), *plain, F.coalesce("outgoing_edges", F.array()).alias("outgoing_edges"), F.coalesce("incoming_edges", F.array()).alias("incoming_edges"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outgoing", "incoming")])
    return shown.orderBy("hop", "ord", "id").limit(limit) if limit else shown


def _adjacent(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id of every node with an edge to or from one of the ids; those meet either end of the edges where these lie."""
    return _ends(edges, lambda end: edges.join(ids.select(F.col("id").alias(end)), end, "left_semi"))


def _ends(edges: DataFrame, found: Callable[[str], DataFrame]) -> DataFrame:
    """id of the other ends of the edges that are found by one end."""
    out = found("from_id").select(F.col("to_id").alias("id"))
    return out.unionByName(found("to_id").select(F.col("from_id").alias("id"))).distinct()


def find_owner(nodes: DataFrame, edges: DataFrame, name: str, resolved: bool = False) -> DataFrame:
    """One row: primary, escalation, source.

    Of nodes with an owner that have the service in their id or an edge to it, documentation
    counts first, then the order of ingestion. Plainly, a page that only mentions the service may come
    first; resolved, pages whose title names it do. The escalation is what the last such line of any
    page of that owner says.
    """
    key = search_key(name)
    near = _adjacent(edges, service_node(nodes, name)).withColumn("near", F.lit(True))
    about = F.array_contains(services_in(F.col("title")), name) if resolved else F.lit(False)
    owned = nodes.where(none(F.col("owner")) != "").join(near, "id", "left").where(F.lower("id").contains(key) | F.col("near") | about)
    first = F.struct((~F.coalesce(about, F.lit(False))).alias("other"), (none(F.col("source")) != "confluence").alias("later"), F.col("ord"), F.col("id"))
    best = owned.groupBy().agg(F.min_by(F.struct("owner", "source"), first).alias("o")).select(F.col("o.owner").alias("primary"), F.col("o.source").alias("source"))
    pages = nodes.where(F.col("source") == "confluence").select("owner", "ord", "id", escalation_line(F.col("body")).alias("line")).where("line IS NOT NULL")
    last = pages.join(F.broadcast(best.select(F.col("primary").alias("owner"))), "owner", "left_semi").groupBy().agg(F.max_by("line", F.struct("ord", "id")).alias("escalation"))
    return best.crossJoin(last).select("primary", "escalation", "source")  # a row each


def recent_changes(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """id, title, timestamp, owner, body of the latest commits with the service in a neighbour's id, their title or body."""
    key = search_key(name)
    commits = nodes.where(F.col("type") == "commit")
    near = _ends(edges, lambda end: edges.where(F.lower(end).contains(key))).withColumn("near", F.lit(True))
    hit = F.col("near") | F.lower(none(F.col("body"))).contains(key) | F.lower(none(F.col("title"))).contains(key)
    found = commits.join(near, "id", "left").where(F.coalesce(hit, F.lit(False)))
    return found.orderBy(F.desc(none(F.col("timestamp"))), "ord", "id").limit(limit).select("id", "title", "timestamp", "owner", "body")


def active_incidents(nodes: DataFrame, edges: DataFrame, name: str, resolved: bool = False) -> DataFrame:
    """id, title, priority, status, owner, timestamp of tickets that aren't closed and are about the service, by priority.

    Plainly, the service is looked for in texts as it is written in ids, so names with a hyphen aren't found there;
    resolved, tickets that mention the service count.
    """
    key = search_key(name)
    open_ = nodes.where((F.col("type") == "ticket") & ~none(F.col("status")).isin(*CLOSED))
    if resolved:
        found = open_.join(_adjacent(edges, service_node(nodes, name)), "id", "left_semi")
    else:
        found = open_.where(F.lower(none(F.col("body"))).contains(key) | F.lower(none(F.col("title"))).contains(key) | F.lower("id").contains(key))
    ranked = found.orderBy(F.coalesce(F.nullif("priority", F.lit("")), F.lit("P9")), "ord", "id")
    return ranked.select("id", "title", "priority", "status", "owner", "timestamp")


def dependencies(nodes: DataFrame, name: str, resolved: bool = False) -> DataFrame:
    """dependency: what pages about the service list under dependencies.

    Plainly, a page is about it if its id has the name in it; resolved, if its title names it.
    """
    pages = nodes.where(F.col("type") == "doc")
    about = F.array_contains(services_in(F.col("title")), name) if resolved else F.lower("id").contains(search_key(name))
    known = service_node(nodes, name).select(F.lit(True).alias("known"))
    listed = pages.where(about).select(F.explode(dependency_lines(F.col("body"))).alias("dependency")).distinct()
    return listed.crossJoin(F.broadcast(known)).select("dependency")  # known is a row or none


def nodes_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("nodes"))


def edges_by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("relation", F.lit("related")).alias("relation")).agg(F.count(F.lit(1)).alias("edges"))


def edges_of(edges: DataFrame, relation: str) -> DataFrame:
    """from_id, to_id, confidence of the edges of one relation ("related": those without one)."""
    return edges.where(F.coalesce("relation", F.lit("related")) == relation).select("from_id", "to_id", "confidence")


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree: edges in and out; an edge to itself counts twice, nodes without edges have 0."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, label (title, name or id, cut at 30 characters), degree: what a drawing of the graph needs."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("name", F.lit("")), F.col("id"))
    label: Column = F.when(F.length(title) > 30, F.concat(F.substring(title, 1, 30), F.lit("…"))).otherwise(title)
    return nodes.select("id", F.coalesce("type", F.lit("unknown")).alias("type"), label.alias("label")).join(degrees(nodes, edges), "id")
