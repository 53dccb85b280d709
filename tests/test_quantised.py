import numpy as np
import pytest

from tessera.operators import quantised


def exact(x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {q: list(np.lexsort((np.arange(len(x)), -np.round(unit @ unit[q], 9)))[:k]) for q in queries}


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_recall_and_additions(spark, tmp_path, kind):
    """Of each query's ten nearest at least nine tenths are found, among rows that the codes were learned from and rows that were added."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    if kind == "clustered":
        x = rng.normal(size=(40, 64))[np.arange(6000) % 40] + 0.4 * x
    x = x.astype(np.float32).astype(float)
    path = str(tmp_path / "index")
    quantised.build(frame(spark, x[:3500]), path)
    assert quantised.add(frame(spark, x[3000:], 3000), path) == 2500 and quantised.add(frame(spark, x), path) == 0
    index = quantised.Index.read(spark, path)
    assert index.codes.count() == index.codes.select("id").distinct().count() == 6000
    queries = list(range(0, 6000, 100))
    asked = frame(spark, x).where("id % 100 = 0").withColumnRenamed("id", "query_id")
    want, got = exact(x, queries, 10), {}
    for r in quantised.search(index, asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    recall = [len(set(got[q]) & set(want[q])) / 10 for q in queries]
    print(kind, np.mean(recall), min(recall))
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.6 and all(len(got[q]) == 10 for q in queries)


def test_odd_vectors(spark, tmp_path, monkeypatch):
    """Rows without a direction take no part; copies tie by id; more questions than go at a time; nothing gives nothing."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [None, 1.0, 0.0]), (6, [2.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    data = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = quantised.build(data, str(tmp_path / "a"))
    monkeypatch.setattr(quantised, "QUESTIONS", 2)
    got = quantised.search(index, data.withColumnRenamed("id", "query_id"), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, round(r.score, 6)) for r in got] == [(1, 1, 1), (1, 6, 1), (6, 1, 1), (6, 6, 1), (7, 7, 1), (7, 1, 0)]
    alone = quantised.search(index, data.withColumnRenamed("id", "query_id"), 1, leave_out_self=True).collect()
    assert sorted((r.query_id, r.id) for r in alone) == [(1, 6), (6, 1), (7, 1)]
    none = quantised.build(data.limit(0), str(tmp_path / "b"))
    assert none.codes.count() == 0 and quantised.search(none, data.withColumnRenamed("id", "query_id"), 2).count() == 0
    assert quantised.search(index, data.limit(0).withColumnRenamed("id", "query_id"), 2).count() == 0
