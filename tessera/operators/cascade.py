"""The cascade of extraction: cache, patterns, a cheap model, a frontier model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions.models import Complete, silent
from ..functions.text import none, parse_json, text_hash
from ..sources.scratch import written
from .dedup import drop_near_duplicates
from .extract import extract_with_rules, needs_frontier
from .incremental import with_change

#: The price of a record by tier.
COSTS = {"cache": 0.0, "rule": 0.0, "llm_cheap": 0.0002, "llm_frontier": 0.003}
ASK = 'Name the engineering entities and relations in the text. Answer with JSON only: {"entities": [{"id", "type", "name"}], "relationships": [{"from_id", "relation", "to_id"}]}.'


def cheap_prompt(unresolved: Column) -> Column:
    return F.concat(F.lit(ASK + "\n\n"), F.substring(unresolved, 1, 600))


def frontier_prompt(title: Column, body: Column, source: Column) -> Column:
    return F.concat(F.lit(ASK + " Include what is only implied.\n\nSource: "), none(source), F.lit("\nTitle: "), F.substring(none(title), 1, 200), F.lit("\nBody: "), F.substring(none(body), 1, 800))


def _answers(prompts: DataFrame, model: str, complete: Complete) -> DataFrame:
    """key, n, raw: the model's answer for each prompt, null where the call failed; n is how many records have the prompt."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str | None:
            try:
                return complete(prompt, model)
            except Exception:
                return None

        for b in batches:
            yield pd.DataFrame({"prompt": b["prompt"], "n": b["n"], "raw": [one(p) for p in b["prompt"]]})

    counted = prompts.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInPandas(call, "prompt string, n long, raw string").select(_key(F.col("prompt")).alias("key"), "n", "raw")


def _key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


#: Fixed value: a prompt that more than this share of all asked records have is joined where they lie.
HOT_SHARE = 1000


def merge_answer(answer: Column, source: str) -> tuple[Column, Column]:
    """entities and relationships with what a model found: entities of new ids (without an id: none), all relations."""
    seen = F.transform("entities", lambda e: e["id"])
    new = F.filter(F.coalesce(answer["entities"], F.array()), lambda e: e["id"].isNotNull() & ~F.array_contains(seen, e["id"]))
    new = F.transform(new, lambda e: F.struct(e["id"].alias("id"), F.coalesce(e["type"], F.lit("unknown")).alias("type"), F.coalesce(e["name"], e["id"]).alias("name"), F.lit(0.85).alias("confidence"), F.lit(source).alias("source")))

    def relation(r: Column) -> Column:
        return F.struct(F.coalesce(r["from_id"], r["from"], F.lit("")).alias("from_id"), F.coalesce(r["relation"], F.lit("")).alias("relation"), F.coalesce(r["to_id"], r["to"], F.lit("")).alias("to_id"), F.lit(0.80).alias("confidence"), F.lit(source).alias("source"))

    return F.concat("entities", new), F.concat("relationships", F.transform(F.coalesce(answer["relationships"], F.array()), relation))


def _ask(rows: DataFrame, prompt: Column, model: str, tier: str, complete: Complete) -> DataFrame:
    """The rows with the answers merged and the tier raised.

    Calls cost money and may answer differently each time. So distinct prompts are asked once, and the answers
    are written before anything reads them; only a task that is lost and run again repeats its calls.
    Many records may share a prompt. At most HOT_SHARE prompts can be so frequent that they are broadcast.
    """
    answers = written(_answers(rows.select(prompt.alias("prompt")), model, complete), "answers")
    total, most = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    often = max(1000, total // HOT_SHARE)
    parsed = answers.withColumn("answer", parse_json(F.col("raw"), schemas.ANSWER))
    keyed = rows.withColumn("key", _key(prompt))
    asked = keyed.join(parsed, "key")
    if most > often:
        hot = F.broadcast(parsed.where(F.col("n") > often))
        few = keyed.join(F.broadcast(answers.where(F.col("n") > often).select("key")), "key", "left_anti")
        asked = keyed.join(hot, "key").unionByName(few.join(parsed.where(F.col("n") <= often), "key"))
    found, related = merge_answer(F.col("answer"), tier)
    merged = asked.withColumns({"entities": found, "relationships": related, "tier": F.lit(tier), "failed": F.col("failed") | F.col("raw").isNull()})
    return merged.select(*rows.columns)


def _cached(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records with result_json: what the cache holds for their text, else null.

    They are dealt by id, in as many parts as are set for shuffles: searching texts takes far longer than moving them,
    so neither texts that many records share nor parts put together by their size may fill a task.
    """
    keyed = records.withColumn("text_hash", text_hash(F.col("title"), F.col("body"))).join(cache.select("text_hash", "result_json"), "text_hash", "left")
    return keyed.drop("text_hash").repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def _cascade(cached: DataFrame, asked: Column, complete: Complete, config: Config) -> DataFrame:
    """Records with what was found in them. Only asked records whose text isn't in the cache are shown to a model."""
    ruled = written(_cached_or_ruled(cached, asked), "ruled")
    # Each tier's result decides who is asked next, and is read again with that one's; so it is written, but for records that weren't asked.
    open_ = asked & (F.col("tier") != "cache")
    cheap = open_ & F.col("unresolved_text").isNotNull()
    cheaply = written(_ask(ruled.where(cheap), cheap_prompt(F.col("unresolved_text")), config.cheap_model, "llm_cheap", complete), "cheaply-asked")
    out = ruled.where(~cheap).unionByName(cheaply)
    complex_ = open_ & needs_frontier(F.col("body"), F.col("source"), F.size("entities"), F.size("relationships"))
    return out.where(~complex_).unionByName(_ask(out.where(complex_), frontier_prompt(F.col("title"), F.col("body"), F.col("source")), config.frontier_model, "llm_frontier", complete))


def extract_tiered(records: DataFrame, cache: DataFrame, complete: Complete = silent, config: Config = Config()) -> DataFrame:
    """Records with entities, relationships, unresolved_text, tier and failed (a model's call gave nothing).

    Texts in the cache have its result. Others get patterns; where those leave names unresolved, a
    cheap model; then, if the record is complex, a frontier model.
    """
    return _cascade(_cached(records, cache), F.lit(True), complete, config)


def extract_all(records: DataFrame, cache: DataFrame, manifest: DataFrame, complete: Complete = silent, embed: Callable[[DataFrame], DataFrame] | None = None, config: Config = Config()) -> DataFrame:
    """The cascade over new and changed records, near duplicates aside; all others have the cache's result or patterns alone.

    `processed` tells the two apart. `embed` adds an embedding to records; without it nothing counts as a near duplicate.
    """
    cached = _cached(records, cache)
    marked = with_change(cached, manifest).withColumn("processed", F.col("change") != "unchanged").drop("change", "content_hash")
    if embed is None:
        # Of rows of one id, the unchanged are left out if others aren't; an id's rows lie together.
        some = F.max("processed").over(Window.partitionBy("id"))
        marked = marked.withColumn("some", some).where(F.col("processed") | ~F.col("some")).drop("some")
    else:
        todo = drop_near_duplicates(embed(marked.where("processed")), config.near_duplicate).drop("embedding")
        rest = cached.join(todo.select("id"), "id", "left_anti")
        marked = todo.unionByName(rest.withColumn("processed", F.lit(False)))
    out = _cascade(marked.select(*records.columns, "processed", "result_json"), F.col("processed"), complete, config)
    return out.select(*[c for c in out.columns if c != "processed"], "processed")


def _cached_or_ruled(cached: DataFrame, asked: Column) -> DataFrame:
    """Each record once: with the cache's result if there is one, else with what patterns find; only then is its text searched."""
    hit = F.col("result_json").isNotNull()
    searched = extract_with_rules(cached.withColumn("r", F.from_json("result_json", schemas.EXTRACTION)))
    cols = {c: F.when(hit, F.coalesce(F.col(f"r.{c}"), F.array())).otherwise(F.col(c)) for c in ("entities", "relationships")}
    out = searched.withColumns(cols | {"unresolved_text": F.when(~hit | ~asked, F.col("unresolved_text")), "tier": F.when(hit, "cache").otherwise("rule"), "failed": F.lit(False)})
    return out.select(*[c for c in cached.columns if c != "result_json"], "entities", "relationships", "unresolved_text", "tier", "failed")


def tier_costs(extracted: DataFrame) -> DataFrame:
    """tier, records, cost for every tier, also those without records."""
    spark = extracted.sparkSession
    prices = spark.createDataFrame(list(COSTS.items()), "tier string, price double")
    counts = extracted.groupBy("tier").agg(F.count(F.lit(1)).alias("records"))
    joined = F.broadcast(prices).join(counts, "tier", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return joined.select("tier", "records", (F.col("records") * F.col("price")).alias("cost"))


def cost_summary(extracted: DataFrame, processed: Column | None = None) -> DataFrame:
    """One row: total cost, the cost with the frontier model for every processed record, per cent saved."""
    price = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in COSTS.items() for x in p]), F.col("tier")), F.lit(0.0))
    naive = F.count_if(F.col("processed") if processed is None else processed) * COSTS["llm_frontier"]
    out = extracted.agg(F.sum(price).alias("total"), naive.alias("naive"))
    return out.withColumn("saved_percent", 100 * (F.col("naive") - F.col("total")) / F.greatest("naive", F.lit(0.001)))
