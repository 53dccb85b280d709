import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import extract, graph_query
from tessera.operators.dedup import drop_near_duplicates, near_pairs
from tessera.operators.graph_build import build_graph, resolve_unknown
from tessera.operators.normalize import normalize_all
from tessera.plans import catalog, fixtures
from tessera.sources import graphs
from tessera.sources.scratch import written


def folded(records):
    """The graph by writing records one after the other, as the rules put it."""
    nodes, edges = {}, {}

    def put(table, key, **attributes):
        table.setdefault(key, {}).update({k: v for k, v in attributes.items()})

    for r in sorted(records, key=lambda r: r.ord):
        put(nodes, r.id, type=r.type, title=r.title, body=r.body[:500], source=r.source, timestamp=r.timestamp or "", owner=r.owner or "", priority=r.priority or "", status=r.status or "")
        for e in r.entities:
            if e.id not in nodes:
                put(nodes, e.id, type=e.type, name=e.name, confidence=e.confidence, extraction_source=e.source)
        for x in r.relationships:
            if x.from_id in nodes and x.to_id in nodes:
                put(edges, (x.from_id, x.to_id), relation=x.relation, confidence=x.confidence, extraction_source=x.source)
        if r.owner:
            who = "engineer__" + r.owner.lower().replace(" ", "_")
            if who not in nodes:
                put(nodes, who, type="engineer", name=r.owner)
            put(edges, (r.id, who), relation="owned_by", confidence=0.99)
        for s in r.services_mentioned:
            if s:
                what = "service__" + s.replace("-", "_")
                if what not in nodes:
                    put(nodes, what, type="service", name=s)
                put(edges, (r.id, what), relation="mentions", confidence=0.95)
    return nodes, edges


def same_graph(records_df):
    nodes, edges = build_graph(records_df, written)
    want_nodes, want_edges = folded(records_df.collect())
    got = {r.id: {k: v for k, v in r.asDict().items() if v is not None and k not in ("id", "ord")} for r in nodes.collect()}
    assert got == {k: {a: b for a, b in v.items() if b is not None} for k, v in want_nodes.items()}
    got = {(r.from_id, r.to_id): {k: v for k, v in r.asDict().items() if v is not None and k not in ("from_id", "to_id")} for r in edges.collect()}
    assert got == want_edges


def test_corpus_graph_is_the_sequential_one(spark):
    same_graph(extract.extract_with_rules(normalize_all(fixtures.sources(spark))))


def test_random_graphs_are_the_sequential_ones(spark):
    rng = random.Random(5)
    names = [f"service__s{i}" for i in range(4)] + [f"r{i}" for i in range(5)]
    rows = []
    for i in range(12):
        ents = [(rng.choice(names), rng.choice("tu"), f"n{rng.random():.3f}", rng.random(), "rule") for _ in range(3)]
        rels = [(rng.choice(names), rng.choice("ab"), rng.choice(names), rng.random(), "rule") for _ in range(4)]
        rows.append((i, f"r{rng.randrange(8)}", "ticket", f"t{i}", "b" * rng.randrange(600), rng.choice([None, "", "Jo K", "jo k"]), [rng.choice(["s1", "s2", "", "s-3"])], None, "jira", rng.choice([None, "P1"]), None, ents, rels))
    kind = schemas.RECORDS + f", entities array<{schemas.ENTITY}>, relationships array<{schemas.RELATION}>"
    same_graph(spark.createDataFrame(rows, kind).repartition(5))


def test_only_what_is_asked_for_is_built(spark, small, monkeypatch):
    """Nodes alone need no relations, edges no texts; relations that lead to what "unknown" names are those of resolve_unknown."""
    kept = {}
    monkeypatch.setattr(catalog, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    catalog.corpus_nodes(spark, small)
    assert set(kept) == {"extracted"} and not {"relationships", "body", "unresolved_text"} & set(kept["extracted"].columns)
    kept.clear()
    catalog.corpus_edges(spark, small)
    assert "nodes" not in kept and not {"title", "body", "unresolved_text"} & set(kept["extracted"].columns)
    found = written(extract.extract_with_rules(normalize_all(fixtures.sources(spark))), "records")
    one, other = (sorted(map(str, df.collect())) for df in (build_graph(found, written, resolved=True)[1], build_graph(resolve_unknown(found), written)[1]))
    assert one == other != sorted(map(str, build_graph(found, written)[1].collect()))


def test_reach_degrees_and_files(spark, tmp_path):
    nodes, edges = build_graph(extract.extract_with_rules(normalize_all(fixtures.sources(spark))), written)
    near = {r.id: r.hop for r in graph_query.reach(nodes, edges, graph_query.start_node(nodes, "redis-cache"), 1).collect()}
    assert near["service__redis_cache"] == 0 and near["WIKI-7"] == 1
    assert sum(r.degree for r in graph_query.degrees(nodes, edges).collect()) == 2 * edges.count()
    assert graph_query.context(nodes, edges, "nothing of this name").count() == 0
    graphs.save(nodes, edges, str(tmp_path / "g"))
    graphs.export_json(nodes, edges, str(tmp_path / "j"))
    again = graphs.import_json(spark, str(tmp_path / "j"))
    for back in (graphs.load(spark, str(tmp_path / "g")), again):
        assert back[0].count() == nodes.count() and back[1].exceptAll(edges.select(*back[1].columns)).count() == 0
    graphs.export_json(nodes, edges, str(tmp_path / "k"), files=3)
    joined = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(str(tmp_path / "k" / "part-*"))))
    whole = json.loads(joined)
    assert [len(whole[k]) for k in ("nodes", "links")] == [nodes.count(), edges.count()] and whole["directed"] is True
    graphs.export_json(nodes.limit(0), edges.limit(0), str(tmp_path / "e"))
    assert [t.count() for t in graphs.import_json(spark, str(tmp_path / "e"))] == [0, 0]
    graphs.export_lines(nodes, edges, str(tmp_path / "l"))
    lines = graphs.import_lines(spark, str(tmp_path / "l"))
    assert lines[0].exceptAll(nodes.select(*lines[0].columns)).count() == 0 and lines[1].count() == edges.count()


def test_a_hub_is_no_large_row(spark):
    """A node with a million edges: its row shows the first of them and how many there are; its pages have all, in rows of bounded size."""
    n = 1_000_000
    edges = spark.range(n).selectExpr("concat('r', id) AS from_id", "'hub' AS to_id", "'mentions' AS relation", "0.95D AS confidence", "CAST(NULL AS string) AS extraction_source")
    nodes = spark.createDataFrame([("hub", 0), ("r7", 1)], "id string, ord long").selectExpr("*", *[f"CAST(NULL AS string) AS {c}" for c in ("type", "title", "name", "body", "owner", "timestamp", "source", "priority", "status")])
    row = {r.id: r for r in graph_query.context(nodes, edges, "hub", hops=1, shown=20).collect()}
    assert len(row["hub"].incoming_edges) == 20 and row["hub"].incoming == n and row["hub"].incoming_edges[0]["from"] == "r0" and row["r7"].outgoing == 1
    pages = graph_query.edge_pages(edges, 1000).where("id = 'hub'").select(F.size("edges").alias("n")).agg(F.max("n"), F.sum("n"), F.count("n")).first()
    assert pages[0] < 1300 and pages[1] == n and pages[2] == 1000


def test_greedy_dedup_is_the_sequential_one(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    kept = []
    for i, v in enumerate(vectors):
        def near(w):
            return sum(a * b for a, b in zip(v, w)) / ((sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5 + 1e-9) >= 0.8

        if not any(near(vectors[j]) for j in kept):
            kept.append(i)
    rows = spark.createDataFrame(list(enumerate(vectors)), "ord long, embedding array<double>")
    assert sorted(r.ord for r in drop_near_duplicates(rows, 0.8).collect()) == kept


def pairs_by_hand(vectors, threshold):
    """Pairs of all rows, of equal vectors only those with the first of them."""
    import numpy as np

    first = {}
    first = [first.setdefault((*v, i if v[0] == 1e-6 else 0), i) for i, v in enumerate(vectors)]
    x = np.array(vectors)
    size = np.sqrt((x * x).sum(axis=1))
    cosine = x @ x.T / (size[:, None] * size[None] + 1e-9)
    a, b = np.nonzero(np.triu(cosine >= threshold, 1))
    return {(int(i), int(j)) for i, j in zip(a, b) if first[i] == i and first[j] in (j, i)}


@pytest.mark.parametrize("threshold", [-0.2, 0.3, 0.8, 0.95])
def test_near_pairs_are_all_pairs(spark, threshold):
    """Whatever the threshold and the number of cells; clusters, unrelated rows, copies, and rows that are near none."""
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors = [[x + rng.gauss(0, 0.15) for x in c] for c in centres for _ in range(6)] + [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    vectors += [vectors[3]] * 40 + [vectors[100]] * 3 + [[1e-6] * 8] * 3
    want = pairs_by_hand(vectors, threshold)
    if threshold < 0:  # too short to be near themselves, but near others below 0
        vectors, want = vectors[:-3], pairs_by_hand(vectors[:-3], threshold)
    odd = [(10_000, None), (10_001, [0.0] * 8), (10_002, [float("nan")] * 8), (10_003, [None] + [1.0] * 7)]
    rows = spark.createDataFrame([*enumerate(vectors), *odd], "ord long, embedding array<double>")
    for block, cell in ((4096, 2048), (60, 16), (1000, 100)):
        got = [(r.a, r.b) for r in near_pairs(rows, threshold, block, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_copies_make_a_star(spark):
    """Equal vectors are paired with the first of them only, and all but that one go."""
    rows = spark.range(3000).selectExpr("id AS ord", "array(1.0D, IF(id < 2900, 0.5D, id * 1.0D)) AS embedding")
    pairs = near_pairs(rows, 0.99999)
    assert pairs.where("b < 2900").count() == 2899 and pairs.where("b < 2900 AND a > 0").count() == 0
    left = [r.ord for r in drop_near_duplicates(rows, 0.99999).collect()]
    assert 0 in left and not any(0 < x < 2900 for x in left)


def test_edges_of_a_relation(spark):
    nodes, edges = build_graph(extract.extract_with_rules(normalize_all(fixtures.sources(spark))), written)
    counts = {r.relation: r.edges for r in graph_query.edges_by_relation(edges).collect()}
    assert counts and all(graph_query.edges_of(edges, k).count() == n for k, n in counts.items())
