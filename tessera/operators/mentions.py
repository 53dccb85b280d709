"""Which of many names texts hold, by one automaton for all of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import none

#: Names of an automaton; beyond, texts are gone through once for each so many.
MOST_ALIASES = 200_000


def alias_scan(texts: DataFrame, aliases: DataFrame, id: str, text: str, most: int = MOST_ALIASES) -> DataFrame:
    """id, names: for each text the names of which an alias occurs in it, inside words too; in the order of their first alias.

    aliases (alias, name, place): the table that says what stands for what. Texts are lower-cased, aliases taken as they are; an empty
    one occurs in every text, null ones and null names in none. The same as functions.aliases.services_in, but a text is read once, whatever
    the number of aliases: an Aho-Corasick automaton over `most` of them at a time is built once in each worker from what is broadcast.
    """
    spark = texts.sparkSession
    known = aliases.where("alias IS NOT NULL AND name IS NOT NULL")
    first = known.groupBy("name").agg(F.min(F.struct("place", "name")).alias("at"))
    parts = max(1, -(-known.count() // most))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("alias"), F.lit(parts))).join(first, "name").select("part", "alias", "at.place", "name")
    own = texts.select(F.col(id).alias("id"), F.lower(none(F.col(text))).alias("text"))
    kind = f"id {own.schema['id'].dataType.simpleString()}, found array<struct<place:long,name:string>>"

    def scan(part: int) -> DataFrame:
        rows = dealt.where(F.col("part") == part).toArrow().sort_by([("place", "ascending"), ("name", "ascending")])  # about `most` rows
        shared = spark.sparkContext.broadcast((rows["alias"].to_pylist(), list(zip(rows["place"].to_pylist(), rows["name"].to_pylist()))))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from ahocorasick import Automaton

            said, meant = shared.value
            names = sorted(set(meant))
            number = {n: i for i, n in enumerate(names)}
            automaton, held = Automaton(), {}
            for alias, name in zip(said, meant):
                held.setdefault(alias, set()).add(number[name])
            always = held.pop("", set())
            for alias, of in held.items():
                automaton.add_word(alias, tuple(of))
            automaton.make_automaton()
            for b in batches:
                out = []
                for t in b.column(1).to_pylist():
                    found = set(always)
                    if held:
                        for _, of in automaton.iter(t):
                            found.update(of)
                    out.append([{"place": names[i][0], "name": names[i][1]} for i in sorted(found)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("place", pa.int64()), ("name", pa.string())])))], ["id", "found"])

        return own.mapInArrow(search, kind)

    found = reduce(DataFrame.unionByName, [scan(i) for i in range(parts)])
    if parts > 1:
        # A row for each text and part.
        found = found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    return found.select("id", F.transform("found", lambda x: x["name"]).alias("names"))
