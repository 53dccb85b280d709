import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.aliases import resolve_owner, resolve_service, services_in
from tessera.functions.text import dependency_lines, escalation_line, is_simple, owner_line, parse_json, snake, tokens
from tessera.functions.vectors import cosine, hashed_embedding
from tessera.operators.chunk import chunk, n_chunks
from tessera.operators.extract import entities, relations, unresolved


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_aliases(spark):
    assert each(spark, [" PGW ", "redis", "nothing", None], resolve_service) == ["payment-gateway", "redis-cache", None, None]
    assert each(spark, ["James", "rahul s.", "Someone Else ", "", None], resolve_owner) == ["James Liu", "Rahul Sharma", "Someone Else ", None, None]
    assert each(spark, ["uses postgres-fraud and the CHECKOUT page", "", None], services_in) == [["checkout-api", "postgres-primary"], [], []]


def test_lines(spark):
    assert each(spark, ["a\nOwner: X (x@y.z)\nowner: B", "OWNER:  Jo: K ", "Owner: )x(", "no", None], owner_line) == ["x@y.z", "Jo: K", "", None, None]
    assert each(spark, ["On-call: A\nescalation B\nEscalation: C: D", "none"], escalation_line) == ["C: D", None]
    body = "# Top\n- not yet\nDependencies:\n- a-b (x)\n\n text\n-- c\n- \n# End\n- d"
    assert each(spark, [body, None], dependency_lines) == [["a-b", "c"], []]


def test_words_and_ids(spark):
    text = "a b\u0085c　d\x0be"
    assert each(spark, [text, "", None], tokens) == [["a", "b", "c", "d", "e"], [], []]
    assert each(spark, [" Ab-C.d é"], lambda c: snake("k", c)) == ["k__ab_c_d__"]
    assert each(spark, ["What is x?", "What is a very long question about all of it", "Why?", None], is_simple) == [True, False, False, False]


def test_json(spark):
    got = each(spark, ['{"entities": [{"id": "a"}]}', "```json\n{\"entities\": []}\n```", "x {\"entities\": []} y", "{broken", None], lambda c: F.size(parse_json(c, schemas.ANSWER)["entities"]))
    assert got == [1, 0, 0, None, None] or got == [1, 0, 0, -1, -1]


@pytest.mark.parametrize("n, k", [(0, 0), (1, 1), (19, 1), (20, 1), (369, 1), (370, 2), (400, 2), (720, 3)])
def test_chunk_counts(spark, n, k):
    assert each(spark, [n], n_chunks, "int") == [k]


def test_chunks_reassemble(spark):
    text = " ".join(f"w{i}" for i in range(1111))
    files = spark.createDataFrame([("a.txt", text), ("b.md", None), ("c.txt", " \n ")], "filename string, text string")
    rows = chunk(files).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(rows[0].total_chunks))
    words = rows[0].text.split()
    for r in rows[1:]:
        words += r.text.split()[50:]
    assert " ".join(words) == text
    assert rows[0].chunk_id == rows[0].doc_id + "_chunk_0000"


def test_entities(spark):
    (found,) = each(spark, ["PR-221 PR 33 pr-5 JR-1 abcdef1 see checkout-api in src/a.py, 503 then 12 ms, x@y.org"], entities)
    assert [(e.type, e.name) for e in found] == [
        ("jira_ticket", "PR-221"), ("jira_ticket", "JR-1"), ("commit_sha", "abcdef1"), ("pr_number", "33"), ("pr_number", "5"), ("email", "x@y.org"),
        ("service", "checkout-api"), ("file_path", "src/a.py"), ("error_code", "503"), ("timeout_ms", "12"),
    ]
    assert each(spark, ["éabcdef1 The New Thing and New\nYork", None], unresolved) == ["New\nYork, The New Thing", None]


def test_relations(spark):
    (found,) = each(spark, ["a-b depends on c. Caused by D! fixes jr-1 x unresponsive timeout was seen in y\ntimeout"], lambda c: relations(F.lit("R"), c))
    assert [(r.from_id, r.relation, r.to_id) for r in found] == [
        ("R", "caused_by", "unknown__d"), ("service__a_b", "depends_on", "service__c"), ("R", "fixes", "unknown__jr_1"), ("R", "affects", "unknown__y"), ("service__x", "affects", "R"),
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] is None
    (v,) = each(spark, ["to be or not to be"], lambda c: hashed_embedding(F.split(c, " ")))
    assert sum(v) == 6 and len(v) == 256
