import random

from pyspark.sql import functions as F

from tessera.operators import extract, same_as
from tessera.operators.graph_build import build_graph, resolve_unknown
from tessera.operators.normalize import normalize_all
from tessera.plans import fixtures
from tessera.sources.scratch import written


def test_groups_are_components(spark):
    rng = random.Random(6)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(35)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.least for r in same_as.groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == label


def test_a_ticket_and_its_entity_are_one_node(spark):
    records = extract.extract_with_rules(normalize_all(fixtures.sources(spark)))
    nodes, edges = build_graph(resolve_unknown(written(records, "records")), written)
    same = written(same_as.same_as(nodes, same_as.known_links(nodes)), "same")
    of = {r.id: r.same for r in same.collect()}
    assert of["jira_ticket__ops_31"] == "OPS-31"
    more, less = same_as.merge(nodes, edges, same)
    rows = {r.id: r for r in more.collect()}
    assert len(rows) == nodes.count() - len(of) and "jira_ticket__ops_31" not in rows and rows["OPS-31"].type == "ticket" and rows["OPS-31"].name == "OPS-31"
    want = {(of.get(r.from_id, r.from_id), of.get(r.to_id, r.to_id)) for r in edges.collect()}
    assert sorted((r.from_id, r.to_id) for r in less.collect()) == sorted(p for p in want if p[0] != p[1])
    assert same_as.merge(nodes, edges, same.limit(0))[0].count() == nodes.count()
    assert same_as.same_as(nodes, same_as.known_links(nodes.where(F.lit(False)))).count() == 0
