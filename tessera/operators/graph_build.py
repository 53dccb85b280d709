"""The property graph of records, entities, engineers and services: a table of nodes and one of edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import engineer_id, none, service_id

TEXT = ["type", "title", "body", "source", "timestamp", "owner", "priority", "status", "name", "extraction_source"]
#: What a record writes, in this order: itself, entities, relations, its owner, services it mentions.
RECORD, ENTITY, RELATION, OWNER, MENTION = range(5)
#: What records alone say; of these the last four always, be it an empty text.
SAID, ALWAYS = ["type", "title", "body", "source"], ["timestamp", "owner", "priority", "status"]
#: What the first write of a node says that isn't a record's.
FIRST = ["type", "name", "confidence", "extraction_source"]


def _place(phase: int, idx: Column | int = 0) -> Column:
    """A write's place within its record."""
    return F.lit(phase << 32) + (F.lit(idx) if isinstance(idx, int) else idx)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _owned(records: DataFrame) -> DataFrame:
    return records.where(none(F.col("owner")) != "")


def _mentions(records: DataFrame) -> DataFrame:
    """ord, id, i, s: the services that records mention, with their places in a record's list."""
    return records.select("ord", "id", F.posexplode("services_mentioned").alias("i", "s")).where(none(F.col("s")) != "")


def _guarded_writes(records: DataFrame) -> DataFrame:
    """ord, id, place and what is written there, of writes that count only where there is no node yet: entities, owners, services."""
    c = F.col
    entity = records.select("ord", F.posexplode("entities").alias("i", "e"))
    return _union((
        entity.select("ord", c("e.id").alias("id"), _place(ENTITY, c("i")).alias("place"), "e.type", "e.name", "e.confidence", c("e.source").alias("extraction_source")),
        _owned(records).select("ord", engineer_id(c("owner")).alias("id"), _place(OWNER).alias("place"), F.lit("engineer").alias("type"), c("owner").alias("name")),
        _mentions(records).select("ord", service_id(c("s")).alias("id"), _place(MENTION, c("i")).alias("place"), F.lit("service").alias("type"), c("s").alias("name")),
    ))


def build_nodes(records: DataFrame, columns: Sequence[str] = (*TEXT, "confidence")) -> DataFrame:
    """One row per node: id, ord (the record of its first write) and the columns asked for, of schemas.NODES.

    Entities, engineers and services write only where there is no node yet; a record's write always
    counts, attribute by attribute. So a node has the attributes of its first write, overlaid
    by those of later records of its id.
    """
    c = F.col
    always, said, first = ([x for x in kinds if x in columns] for kinds in (ALWAYS, SAID, FIRST))
    body = {"body": F.substring("body", 1, 500)}
    own = records.select("ord", "id", F.lit(0).cast("long").alias("place"), *[body.get(x, c(x)).cast("string").alias(f"said_{x}") for x in said], F.struct(F.lit(True).alias("record"), *[none(c(x)).alias(x) for x in always]).alias("always"))
    guarded = _guarded_writes(records).select("ord", "id", "place", *first)
    writes = _union((own, guarded))
    # What the first write says is asked of guarded ones only: a record's counts as said. Rows are sorted by the hash, then the id, which tells most apart by a number.
    head = F.min(F.struct("ord", "place", *first)).alias("head")
    last = [F.max_by(f"said_{x}", F.when(c(f"said_{x}").isNotNull(), c("ord"))).alias(f"said_{x}") for x in said]
    # Frames that want none of these don't carry them.
    last += [F.max_by("always", F.when(c("always").isNotNull(), c("ord"))).alias("always")] if always else []
    merged = writes.groupBy(F.xxhash64("id").alias("hash"), "id").agg(head, *last)
    values = {x: c(f"head.{x}") for x in first} | {x: c(f"always.{x}") for x in always}
    values |= {x: F.coalesce(c(f"said_{x}"), values[x]) if x in values else c(f"said_{x}") for x in said}
    return merged.select("id", *[values[x].alias(x) for x in columns], c("head.ord").alias("ord"))


def _edge(df: DataFrame, start: Column, end: Column, relation: Column, confidence: Column, source: Column, place: Column) -> DataFrame:
    return df.select(start.alias("from_id"), end.alias("to_id"), relation.alias("relation"), confidence.cast("double").alias("confidence"), source.cast("string").alias("extraction_source"), "ord", place.alias("place"))


def _found(records: DataFrame, keep: Callable[[DataFrame, str], DataFrame], resolved: bool) -> DataFrame:
    """ord, i, r, from_known, to_known: the records' relations, and which of their ends the record itself has written before."""
    c = F.col
    own = F.concat(F.array("id"), F.coalesce("entities.id", F.array().cast("array<string>")))

    def known(end: Column) -> Column:
        return F.coalesce(F.array_contains("own", end), F.lit(False))

    rows = records.where(F.size("relationships") > 0).select("ord", own.alias("own"), F.posexplode("relationships").alias("i", "r")).withColumn("from_known", known(c("r.from_id")))
    if resolved:
        key = _unknown_key(c("r.to_id"))
        best = keep(_targets(records, rows.select(key.alias("key")).where("key IS NOT NULL").distinct()), "targets")
        led = rows.withColumn("key", key).where("key IS NOT NULL").join(best, "key", "left").withColumn("r", c("r").withField("to_id", F.coalesce("target", "r.to_id")))
        rows = rows.where(key.isNull()).unionByName(led.select(*rows.columns))
    return keep(rows.withColumn("to_known", known(c("r.to_id"))).drop("own"), "relations")


def build_edges(records: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, resolved: bool = False) -> DataFrame:
    """One row per (from_id, to_id), schemas.EDGES. `resolved` leads relations to "unknown__x" to what x names, as resolve_unknown does.

    A found relation counts only if both its ends had been written before the record's relations
    were; it isn't tried again. Of several writes of an edge the last counts, attribute by attribute.
    """
    c = F.col
    found = _found(records, keep, resolved)
    # Only ends that the record hasn't written itself are looked for; a node's first records are numbers, so that they are told by hash.
    ends = found.select(F.explode(F.array(*[F.when(~c(f"{x}_known"), c(f"r.{x}_id")) for x in ("from", "to")])).alias("id")).where("id IS NOT NULL").distinct()
    entity = records.select("ord", F.explode("entities.id").alias("id"), F.lit(ENTITY).alias("phase"))
    owner = _owned(records).select("ord", engineer_id(c("owner")).alias("id"), F.lit(OWNER).alias("phase"))
    service = _mentions(records).select("ord", service_id(c("s")).alias("id"), F.lit(MENTION).alias("phase"))
    writers = _union((records.select("ord", "id", F.lit(RECORD).alias("phase")), entity, owner, service))
    written_at = writers.groupBy("id").agg(F.min("ord").alias("seen"), F.min(F.when(c("phase") < RELATION, c("ord"))).alias("early"))
    # Kept, so that its size is known: where few ends are looked for, relations meet them where they lie.
    places = keep(written_at.join(ends, "id", "left_semi"), "places")
    for end in ("to", "from"):
        looked = found.where(~c(f"{end}_known")).join(places.withColumnRenamed("id", "end"), c(f"r.{end}_id") == c("end")).where((c("seen") < c("ord")) | (c("early") <= c("ord")))
        found = found.where(f"{end}_known").unionByName(looked.drop("end", "seen", "early"))
    related = _edge(found, c("r.from_id"), c("r.to_id"), c("r.relation"), c("r.confidence"), c("r.source"), _place(RELATION, c("i")))
    owned = _edge(_owned(records), c("id"), engineer_id(c("owner")), F.lit("owned_by"), F.lit(0.99), F.lit(None), _place(OWNER))
    mentioned = _edge(_mentions(records), c("id"), service_id(c("s")), F.lit("mentions"), F.lit(0.95), F.lit(None), _place(MENTION, c("i")))
    writes = _union((related, owned, mentioned))
    at = F.struct("ord", "place")
    last = [F.max_by(x, F.when(c(x).isNotNull(), at)).alias(x) for x in ("relation", "confidence", "extraction_source")]
    return writes.groupBy(F.xxhash64("from_id", "to_id").alias("hash"), "from_id", "to_id").agg(*last).drop("hash")


def needed(extracted: DataFrame, nodes: bool = True) -> DataFrame:
    """What a graph's nodes and edges, or its edges alone, are told from."""
    if nodes:
        return extracted.select("ord", "id", "type", "title", F.substring("body", 1, 500).alias("body"), "source", *ALWAYS, "services_mentioned", "entities", "relationships")
    return extracted.select("ord", "id", "owner", "services_mentioned", F.transform("entities", lambda e: F.struct(e["id"].alias("id"))).alias("entities"), "relationships")


def build_graph(extracted: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, resolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes, edges of records with entities and relationships. `ord` is the order in which records are written.

    Records are read several times on the way; `keep` may write them and what is built to tables, so that none is computed twice.
    """
    extracted = keep(needed(extracted), "extracted")
    nodes = keep(build_nodes(extracted).select(*[x.split()[0] for x in schemas.NODES.split(", ")]), "nodes")
    return nodes, keep(build_edges(extracted, keep, resolved), "edges")


def _unknown_key(to: Column) -> Column:
    return F.when(to.startswith("unknown__"), F.substring(to, 10, 1 << 30))


def _targets(extracted: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """key, target: the least of the entities and records whose id ends in the key, of the keys given or all."""
    names = extracted.select(F.explode(F.concat(F.array("id"), F.coalesce("entities.id", F.array().cast("array<string>")))).alias("target")).distinct()
    bare = F.lower(F.when(F.col("target").contains("__"), F.regexp_replace("target", "^[a-z_]+?__", "")).otherwise(F.col("target")))
    key = F.when(F.col("bare").rlike("[^a-z0-9_]"), F.regexp_replace("bare", "[^a-z0-9_]", "_")).otherwise(F.col("bare"))
    # Never null, so that the joins' filters needn't work it out once more, before names are distinct.
    keyed = names.withColumn("bare", bare).select("target", F.coalesce(key, F.lit("")).alias("key"))
    wanted = keyed if keys is None else keyed.join(keys, "key", "left_semi")
    return wanted.groupBy(F.xxhash64("key").alias("hash"), "key").agg(F.min("target").alias("target")).drop("hash")


def resolve_unknown(extracted: DataFrame) -> DataFrame:
    """Extracted records whose relations to "unknown__x" lead to what x names: an entity or record whose id ends in it.

    build_graph as such drops such relations, as no node is called so.
    """
    c = F.col
    best = _targets(extracted)
    edges = extracted.select("ord", F.posexplode("relationships").alias("i", "r")).withColumn("key", _unknown_key(c("r.to_id")))
    fixed = edges.join(best, "key", "left").withColumn("r", c("r").withField("to_id", F.coalesce("target", c("r.to_id"))))
    lists = fixed.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("relationships"))
    empty = F.from_json(F.lit("[]"), f"array<{schemas.RELATION}>")
    return extracted.drop("relationships").join(lists, "ord", "left").withColumn("relationships", F.coalesce("relationships", empty))
