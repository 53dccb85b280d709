"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, n_words_of, read_table, without_spaces, written

#: A source's target is at most so many times its size.
MOST_EPOCHS = 3
#: Slices of a source's keys; only the slice in which the source's rest ends is sorted.
SLICES = 4096


def document_quality(marks: Column, words: Column) -> Column:
    """A weight of 1 to 3 from a text without its white space: one more for an ending mark, one for words of 3 to 12 letters on average."""
    n = F.length(marks)
    usual = (n >= 3 * words) & (n <= 12 * words) & (words > 0)
    return 1 + F.substring(marks, -1, 1).isin(".", "!", "?").cast("int") + usual.cast("int")


def _uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """The rows of sizes (source, source_size), one for each source, with the target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. With weights w and caps c, sharing
    what is above a cap again and again ends where every target is min(c, w * level): sources reach
    their caps in ascending order of c / w, so the level follows from running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_fill = Window.orderBy("fill", F.col("source").isNull(), "source")
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    weighed = sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    run = weighed.withColumn("fill", F.col("cap") / F.col("w")).withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest))
    # The first source, in that order, whose cap is above its share at this point sets the level of all.
    level = F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(everything)["level"]
    return run.withColumn("all", level).select(*sizes.columns, F.coalesce(F.least("cap", F.col("w") * F.col("all")), "cap").alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, most: int = MOST_EPOCHS, seed: str = "", keep: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source); with `keep`, also the whole row as a struct of that name.

    A source's target holds so many complete epochs, in which every document is taken whole, and a
    rest. For the rest, each document draws an exponential key scaled by its quality weight,
    -ln(u) / weight with u from its doc_id; in ascending order of keys, ties by doc_id, documents
    are taken while their middle lies within the rest, so a source misses its target by half a
    document at most. `weight` defaults to document_quality.

    The prefix sums don't need a source in one task: keys are cut into SLICES
    slices, sums of slices say in which slice a source's rest ends, and only that slice is sorted.

    Nulls: a null text has size 0 and is taken 0 times; a null source is a source of its own, the
    last; null doc_ids draw the same key. Rows repeating a doc_id are mixed each for itself. An empty
    table gives an empty result. If all sizes are 0 so are all targets. Other columns play no part.
    """
    text = F.col("text")
    own = (without_spaces(text) if weight is None else F.lit(None)).alias("marks"), (F.lit(None) if weight is None else weight).cast("double").alias("weight")
    kept = [keep] if keep else []
    rows = docs.select("doc_id", "source", n_words_of(text).alias("size"), *own, *[F.struct("*").alias(c) for c in kept])
    key = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    quality = F.col("weight") if weight is not None else document_quality(F.col("marks"), F.col("size")).cast("double")
    base = rows.select("doc_id", "source", "size", (-F.log(_uniform(key)) / quality).alias("key"), *kept)
    base = written(base, "mix-keys")
    # 1 - exp(-key) rises with the key and is spread over (0, 1), so equal widths make slices in order.
    base = base.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES)).withColumn("named", F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))))
    by_slice = base.groupBy("named", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("in_slice"), F.count(F.lit(1)).alias("n"))
    by_slice = written(by_slice, "mix-slices")
    sums = by_slice.groupBy("named").agg(F.first("source").alias("source"), F.sum("in_slice").alias("source_size"), F.sum("n").alias("docs"))
    plan = source_targets(sums, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).drop("source")
    before = F.sum("in_slice").over(Window.partitionBy("named").orderBy("slice")) - F.col("in_slice")
    ends = by_slice.select("named", "slice", "in_slice", before.alias("before")).join(plan.select("named", "rest"), "named")
    # The slice in which a source's rest ends. Without one the source has no rest, or takes all once more.
    last = ends.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_slice") >= F.col("rest"))).groupBy("named").agg(F.min(F.struct("slice", "before")).alias("cut"))
    plan = written(plan.join(last, "named", "left").select(*plan.columns, F.col("cut.slice").alias("k"), F.col("cut.before").alias("before")), "mix-plan")
    total = plan.agg(F.sum("docs")).first()[0] or 0
    placed = hot_join(base, plan, ["named"], "docs", total)
    in_last = F.coalesce(F.col("slice") == F.col("k"), F.lit(False))
    order = Window.partitionBy("named").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size", *[F.col(c)["text"] for c in kept]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.where(in_last).withColumn("upto", F.col("before") + F.sum("size").over(order) - F.col("size"))
    inside = inside.withColumn("more", F.col("upto") + F.col("size") / 2 <= F.col("rest"))
    others = placed.where(~in_last).withColumn("more", F.coalesce(F.col("slice") < F.col("k"), F.col("rest") > 0))
    out = ["doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("more").cast("long")) * F.col("size")).alias("taken"), *kept]
    return others.select(*out).unionByName(inside.select(*out))


def repeat_by_mix(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """The mixed corpus: each row of docs as many times as the mix takes it; its columns stay, but for `weight`.

    Every row is repeated by what is taken of it alone, also where rows share a doc_id. Documents of no
    words add nothing to a mix of words and are not in it. `weight` names a column of quality weights above 0.
    """
    taken = mix(docs, None if weight is None else F.col(weight), keep="kept").where("size > 0 AND taken > 0")
    times = (F.col("taken") / F.col("size")).cast("int")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*[F.col("kept")[c].alias(c) for c in docs.columns if c != weight])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         rtrim(translate(coalesce(text, ''), E'\t\n\x0b\f\r', '     ')) AS body
  FROM documents
), d AS (
  SELECT doc_id, source, size,
         (1 + CASE WHEN body LIKE '%.' OR body LIKE '%!' OR body LIKE '%?' THEN 1 ELSE 0 END
            + CASE WHEN size > 0 AND length(replace(body, ' ', '')) BETWEEN 3 * size AND 12 * size THEN 1 ELSE 0 END)::DOUBLE AS weight,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM t
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS n FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), g AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, n) FROM l WHERE cap / w > level)), cap) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g
), k AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       ((epochs + CASE WHEN rest > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM k
"""
