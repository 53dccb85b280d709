import json

import pytest

from tests.test_plans import same_as_sql
from tessera.plans import catalog, oracle
from tessera.streaming.changes import PROVIDER, export_stream, write_changes


def ticket(id, text, **more):
    return {"id": id, "summary": text, "description": text + ".", "status": "open", "services_affected": ["redis"]} | more


def run(spark, folder, at):
    query = write_changes(export_stream(spark, str(folder), "jira"), f"{at}/out", f"{at}/mark")
    query.awaitTermination()
    return sorted((r.id, r.change, r.title) for r in spark.read.parquet(f"{at}/out").collect())


def test_exports_arrive(spark, tmp_path):
    """New and changed tickets come through once; those that stay the same, come again or can't be read don't; a restart remembers."""
    folder, before = tmp_path / "in", spark.conf.get(PROVIDER, None)
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([ticket("A", "one"), ticket("B", "two"), ticket(None, "nobody's")]))
    want = [("A", "new", "one"), ("B", "new", "two")]
    assert run(spark, folder, tmp_path) == want
    assert run(spark, folder, tmp_path) == want
    (folder / "b.json").write_text(json.dumps([ticket("A", "one"), ticket("B", "two, edited"), ticket("C", "three")]))
    (folder / "bad.json").write_bytes(b"\x00\x01 no json [[[")
    (folder / "empty.json").write_text("")
    want += [("B", "changed", "two, edited"), ("C", "new", "three")]
    assert run(spark, folder, tmp_path) == sorted(want)
    # Back to what it was is a change too.
    (folder / "c.json").write_text(json.dumps([ticket("B", "two")]))
    assert run(spark, folder, tmp_path) == sorted([*want, ("B", "changed", "two")])
    assert spark.conf.get(PROVIDER, None) == before


def test_several_versions_in_one_batch(spark, tmp_path):
    rows = [("x", 2, "b"), ("x", 1, "a"), ("x", 3, "b"), ("y", 1, "a"), ("x", 4, "a")]
    spark.createDataFrame(rows, "id string, ord long, title string").selectExpr("*", "CAST(NULL AS string) AS body").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ord long, title string, body string").parquet(str(tmp_path / "in"))
    write_changes(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = sorted((r.id, r.ord, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("x", 1, "new"), ("x", 2, "changed"), ("x", 4, "changed"), ("y", 1, "new")]


@pytest.mark.parametrize("name", ["streamed_changes"])
def test_against_sql(spark, small, name):
    same_as_sql(spark, small, catalog.QUERIES[name], oracle.ORACLES[name])


def test_known_hashes_are_not_written_again():
    """Plain rows, no frames; a state is written only where the last hash is another."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from tessera.streaming.changes import _Known

    state = []
    last = SimpleNamespace(get=lambda: state[-1] if state else None, update=state.append)
    known = _Known()
    known.init(SimpleNamespace(getValueState=lambda name, kind: last))

    def told(*rows):
        return [(r.ord, r.change) for r in known.handleInputRows(("a",), iter([Row(id="a", ord=o, content_hash=h) for o, h in rows]), None)]

    assert told((2, "y"), (1, "x"), (None, "y")) == [(1, "new"), (2, "changed")] and state == [("y",)]
    assert told((3, "y")) == [] and len(state) == 1
    assert told((5, "y"), (4, "z")) == [(4, "changed"), (5, "changed")] and len(state) == 1
