"""Results that are whole and right at any size."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, chunk, quantised
from tessera.plans import catalog, oracle
from tessera.sources import graphs


def test_exported_json_is_read_in_parts(spark, tmp_path):
    """A graph in files of several blocks each: no task reads it whole, and nodes have their places."""
    text = [F.lit(None).cast("string").alias(c) for c in ("body", "source", "timestamp", "owner", "priority", "status", "extraction_source")]
    nodes = spark.range(3000).select(F.format_string("n%05d", "id").alias("id"), F.lit("], \"links\": [").alias("type"), F.lit("a\nb\r,").alias("title"), F.format_string("%d", "id").alias("name"), *text, F.lit(0.5).alias("confidence"), (9 * F.col("id") + 5).alias("ord"))
    edges = spark.range(3000).select(F.format_string("n%05d", "id").alias("from_id"), F.lit("n00000").alias("to_id"), F.lit("r").alias("relation"), F.lit(None).cast("string").alias("extraction_source"), F.lit(1.0).alias("confidence"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for files in (None, 1, 3):
            path = str(tmp_path / f"j{files}")
            graphs.export_json(nodes, edges, path, **({} if files is None else {"files": files}))
            back, links = graphs.import_json(spark, path)
            assert back.rdd.getNumPartitions() > 5
            got = back.orderBy("ord").collect()
            assert [(r.ord, r.id, r.name, r.title) for r in got] == [(i, f"n{i:05d}", str(i), "a\nb\r,") for i in range(3000)]
            assert links.exceptAll(edges.select(*links.columns)).count() == 0 and links.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "foreign.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}],\n "edges": [{"source": "a", "target": "b"}]}')
    back, links = graphs.import_json(spark, str(tmp_path / "foreign.json"))
    assert [(r.ord, r.id) for r in back.orderBy("ord").collect()] == [(0, "a"), (1, "b")] and [tuple(r)[:2] for r in links.collect()] == [("a", "b")]


def test_quantised_topk_is_exact(spark, tmp_path):
    """Among thousands of vectors without structure, and copies, the ten nearest are those of the SQL; codes alone miss some."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 64)).astype(np.float32)
    x[4900:] = x[100]
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").coalesce(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted((q, v, rank) for q, v, _, rank in con.sql(oracle.ORACLES["quantised_topk"]).fetchall())
    got = sorted((r.query_id, r.vec_id, r["rank"]) for r in catalog.quantised_topk(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 1000
    index = quantised.build(spark.read.parquet(str(tmp_path / "embeddings.parquet")), str(tmp_path / "index"), "vec_id")
    asked = index.vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    few, all_ = (quantised.search(index, asked, 10, 1, True, exact).select("query_id", "id", "rank").collect() for exact in (False, True))
    assert sorted(map(tuple, all_)) == want and sorted(map(tuple, few)) != want


def test_store_stats_name_all_files(spark):
    """The names themselves, sorted, not only how many they are; empty ones are none."""
    rows = [("b.txt", "1"), ("a.txt", "2"), ("b.txt", "1"), ("", "3"), (None, None), ("c.txt", "")]
    got = chunk.store_stats(spark.createDataFrame(rows, "filename string, doc_id string")).collect()
    assert [r.asDict() for r in got] == [{"chunk_count": 6, "doc_count": 3, "filenames": ["a.txt", "b.txt", "c.txt"]}]
    none = chunk.store_stats(spark.createDataFrame([], "filename string, doc_id string")).collect()
    assert [tuple(r) for r in none] == [(0, 0, [])]


@pytest.mark.parametrize("k", [1, 7])
def test_many_questions_are_answered_as_one(spark, tmp_path, monkeypatch, k):
    """By matrices as by joins: a few chunks at a time, blocks of questions, stored postings, ties, scores below zero, questions that no chunk answers."""
    rng = np.random.default_rng(1)
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(f"w{int(x)}" for x in rng.exponential(9, i % 40))) for i in range(300)], "chunk_id string, text string").repartition(3)
    few = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "x z"), ("d", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(f"W{int(x)}" for x in rng.exponential(20, i % 6))) for i in range(20)] + [(50, "absent"), (51, "x x y w1")], "query_id long, query string")
    for monkey in ({}, {"PARTS": 50, "QUESTIONS": 4}):
        for name, value in monkey.items():
            monkeypatch.setattr(bm25, name, value)
        for own in (chunks, few):
            index = bm25.fit(own)
            index.write(str(tmp_path / "index"))
            want = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in bm25.search(index, asked, k).collect())
            for one in (index, bm25.Index.read(spark, str(tmp_path / "index"))):
                assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in bm25.search_many(one, asked, k).collect()) == want
    assert "Join" not in bm25._scored(bm25.fit(chunks), bm25.fit(chunks).term_stats.selectExpr("1L AS query_id", "term", "idf AS w", "1.0D AS avgdl"), [], k, "long")._jdf.queryExecution().executedPlan().toString()
