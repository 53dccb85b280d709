import random

from pyspark.sql import functions as F

from tessera.functions.aliases import SERVICES, services_in
from tessera.operators.mentions import alias_scan


def test_automaton_finds_what_the_scan_finds(spark, small):
    table = spark.createDataFrame([(a, s, i) for i, (a, s) in enumerate(SERVICES.items())], "alias string, name string, place long")
    rng = random.Random(1)
    made = ["".join(rng.choice([*SERVICES, " ", "x", "REDIS", "pg", "w"]) for _ in range(rng.randint(0, 5))) for _ in range(300)] + [None, ""]
    texts = spark.createDataFrame(list(enumerate(made)), "id long, text string")
    pages = spark.read.parquet(f"{small}/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    for rows in (texts, pages):
        want = {r.id: r.names for r in rows.select("id", services_in(F.col("text")).alias("names")).collect()}
        for most in (200_000, 5):
            assert {r.id: r.names for r in alias_scan(rows, table, "id", "text", most).collect()} == want


def test_odd_aliases(spark):
    """Empty aliases are in every text, null ones in none; two names may share an alias, and a name has its first place."""
    kind = "alias string, name string, place long"
    table = spark.createDataFrame([("ab", "late", 9), ("b", "early", 2), ("ab", "shared", 3), ("zz", "late", 1), (None, "none", 0), ("c", None, 0)], kind)
    texts = spark.createDataFrame([(1, "xABx"), (2, "c"), (3, None)], "id int, text string")
    assert {r.id: r.names for r in alias_scan(texts, table, "id", "text").collect()} == {1: ["late", "early", "shared"], 2: [], 3: []}
    more = table.unionByName(spark.createDataFrame([("", "always", 5)], kind))
    assert {r.id: r.names for r in alias_scan(texts, more, "id", "text").collect()} == {1: ["late", "early", "shared", "always"], 2: ["always"], 3: ["always"]}
    assert all(r.names == [] for r in alias_scan(texts, table.limit(0), "id", "text").collect())
    assert alias_scan(texts.limit(0), table, "id", "text").count() == 0


def test_many_aliases(spark):
    """A hundred thousand names cost no more passes than one."""
    table = spark.range(100_000).selectExpr("concat('n', hex(id), '.') AS alias", "CAST(id AS string) AS name", "id AS place")
    texts = spark.createDataFrame([(1, "nff. and nabc. n186a0."), (2, "none")], "id int, text string").withColumn("text", F.lower("text"))
    small = table.withColumn("alias", F.lower("alias"))
    assert {r.id: r.names for r in alias_scan(texts, small, "id", "text").collect()} == {1: ["255", "2748"], 2: []}
