import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import registry
from tessera.llm.common import hot_join

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.sql(registry.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.sql(registry.oracle_sql()[name]).description]
    got = registry.queries()[name](spark, FOLDER).select(*names).collect()
    rounded = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(got) == rounded(want)


def test_stages_keep_the_columns(spark, hard, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    hard.write.parquet(str(tmp_path / "documents.parquet"))
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == hard.columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.where("NOT lossless").count() == 0


def test_run_is_its_stages(spark):
    """Each stage against what it says it does, on a small table."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    step = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step.append(stage(spark, step[-1], FOLDER))
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in step]
    assert set(ids[1]) <= set(ids[0]) and len(ids[1]) > 0.8 * len(ids[0])
    texts = ["".join(r.text.split()) for r in step[2].collect()]
    assert len(texts) == len(set(texts)) == len({"".join(r.text.split()) for r in step[1].collect()})
    from tessera.llm import simhash

    assert simhash.near_classes(step[3]).where("doc_id <> component_id").count() == 0
    assert {r.component_id for r in simhash.near_classes(step[2]).collect()} == set(ids[3])
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(ids[4])
    assert all(r.lossless and len(r.ids) == r.n_pieces for r in out)


def test_hot_join(spark):
    rows = spark.createDataFrame([(i % 7 and 1, i) for i in range(5000)], "k long, v long")
    sizes = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = hot_join(rows, sizes, ["k"], "n", 5000)
    assert got.count() == 5000 and got.where("k = 1").count() == rows.where("k = 1").count()


def test_entry_without_the_subpackage(tmp_path):
    """Whatever is left behind or can't be imported, the other queries stay."""
    import __spark_entry__

    here = os.path.dirname(__spark_entry__.__file__)
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'op1_exact_dedup' in e.queries())"
    for broken in ("xxhash", "corpus_pipeline", "tessera.llm.registry"):
        code = f"import sys; sys.modules['{broken}'] = None; {say}"
        out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 50 and int(out[1]) > 50 and out[2] == "False"
