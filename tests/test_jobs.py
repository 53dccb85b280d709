import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, index_documents, service_report
from tests.test_plans import same_as_sql

ROWS = 60


def documents(spark, n=ROWS):
    rows = [(i, None if i == 7 else "" if i == 8 else f"Text {i}\nuses redis and the checkout " + " ".join(f"w{j % (3 + i)}" for j in range(11 * i)), [None, "en", "de"][i % 3], f"src{i % 4}", "extra") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, chunk_id string")


def index_of(spark, folder):
    """Passages and postings as sets of rows, without the batch that wrote them."""
    passages = index_documents.stored(spark, f"{folder}/passages", index_documents.PASSAGES).drop("batch")
    postings = index_documents.stored(spark, f"{folder}/postings", index_documents.POSTINGS).drop("batch", "shard")
    return [sorted(map(repr, df.collect())) for df in (passages, postings)]


def test_new_documents_are_taken_in_once(spark, tmp_path):
    """Two runs over a growing folder hold what one run over all of it holds; a run without new files changes nothing."""
    docs, given = documents(spark), str(tmp_path / "given")
    known = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    settings = index_documents.SETTINGS | {"chunk_tokens": 60, "overlap_tokens": 10, "files_per_batch": 2}
    out, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    docs.where("doc_id < 25").repartition(3).write.parquet(given)
    first = index_documents.run(spark, given, out, str(tmp_path / "mark"), settings)
    assert first["batches"] == 2 and first["documents"] == 25 and first["passages"] > 25
    assert index_documents.run(spark, given, out, str(tmp_path / "mark"), settings) == {"batches": 0, "documents": 0, "passages": 0, "postings": 0}
    # New documents, and some that are known already, in other files.
    docs.where("doc_id >= 20").coalesce(1).write.mode("append").parquet(given)
    second = index_documents.run(spark, given, out, str(tmp_path / "mark"), settings)
    assert second["batches"] == 1 and second["documents"] == ROWS - 20
    docs.coalesce(1).write.parquet(str(tmp_path / "all"))
    index_documents.run(spark, str(tmp_path / "all"), whole, str(tmp_path / "other"), settings)
    assert index_of(spark, out) == index_of(spark, whole)
    assert first["passages"] + second["passages"] == len(index_of(spark, whole)[0])
    # A lost checkpoint: all is read again, and replaces or repeats nothing.
    index_documents.run(spark, given, out, str(tmp_path / "lost"), settings)
    assert index_of(spark, out) == index_of(spark, whole)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == known[1]


def test_a_batch_that_broke_off_is_run_again(spark, tmp_path, monkeypatch):
    """The postings of the first batch fail once; the next run repeats that batch from the start."""
    given, out = str(tmp_path / "given"), str(tmp_path / "out")
    documents(spark, 20).coalesce(1).write.parquet(given)
    real, calls = index_documents.counted, []

    def broken(values):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("no room")
        return real(values)

    monkeypatch.setattr(index_documents, "counted", broken)
    with pytest.raises(Exception, match="no room"):
        index_documents.run(spark, given, out, str(tmp_path / "mark"))
    assert index_of(spark, out)[0] and not index_of(spark, out)[1]
    assert index_documents.run(spark, given, out, str(tmp_path / "mark"))["batches"] == 1
    index_documents.run(spark, given, str(tmp_path / "fresh"), str(tmp_path / "other"))
    assert index_of(spark, out) == index_of(spark, str(tmp_path / "fresh"))


def test_no_documents(spark, tmp_path):
    documents(spark).limit(0).write.parquet(str(tmp_path / "given"))
    index_documents.run(spark, str(tmp_path / "given"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert index_of(spark, str(tmp_path / "out")) == [[], []]


def test_documents_against_sql(spark, small):
    same_as_sql(spark, small, index_documents.job1_index_documents, index_documents.ORACLE_SQL)


def test_report_against_sql(spark, small):
    same_as_sql(spark, small, service_report.job2_service_report, service_report.ORACLE_SQL)


def test_report_replaces_its_snapshot_alone(spark, small, tmp_path):
    """A snapshot of fewer tables' rows doesn't touch another, and one that is made again leaves nothing of what was there."""
    given, out = str(tmp_path / "given"), str(tmp_path / "out")
    for name in ("documents", "part", "events", "orders"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(40).write.parquet(f"{given}/{name}.parquet")
    read = lambda name: spark.read.parquet(f"{out}/{name}").where("snapshot = 'a'")
    settings = service_report.SETTINGS | {"snapshot": "a", "resolved": True}
    first = service_report.run(spark, given, out, settings)
    before = {name: sorted(map(repr, read(name).collect())) for name in ("nodes", "edges", "services")}
    assert {k: len(v) for k, v in before.items()} == {k: first[k] for k in before} and first["records"] == 160
    service_report.run(spark, small, out, settings | {"snapshot": "b"})
    assert service_report.run(spark, given, out, settings) == first
    assert {name: sorted(map(repr, read(name).collect())) for name in before} == before
    spark.read.parquet(f"{small}/events.parquet").limit(0).write.mode("overwrite").parquet(f"{given}/events.parquet")
    assert service_report.run(spark, given, out, settings)["records"] == 120
    assert read("records").where("type = 'log'").count() == 0 and read("services").agg(F.sum("errors")).first()[0] == 0


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"shards": 4}')
    assert common.settings(str(tmp_path / "c.json"), index_documents.SETTINGS)["shards"] == 4
    (tmp_path / "c.json").write_text('{"shard": 4}')
    with pytest.raises(ValueError, match="shard"):
        common.settings(str(tmp_path / "c.json"), index_documents.SETTINGS)
    for job in (index_documents, service_report):
        with open(job.__file__.replace(".py", ".json"), encoding="utf-8") as file:
            assert json.load(file) == job.SETTINGS


@pytest.mark.parametrize("job", [index_documents, service_report])
def test_command_line(small, tmp_path, job):
    paths = {"documents": f"{small}/documents.parquet", "tables": small, "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    names = ("documents", "output", "checkpoint") if job is index_documents else ("tables", "output")
    run = subprocess.run([sys.executable, job.__file__, *[x for n in names for x in (f"--{n}", paths[n])]], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    counts = json.loads(run.stdout.strip().splitlines()[-1])
    assert counts["documents" if job is index_documents else "records"] >= 200 and "wrote" in run.stderr
