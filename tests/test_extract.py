import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import ENDS, strip
from tessera.operators import citations
from tessera.operators.extract import ENTITIES, LINEAR, PHRASE, RELATIONS, entities, extract_with_rules, likely, relations, unresolved

#: Pieces of which texts are made that come near each pattern, and what it finds.
PIECES = {
    "jira_ticket": ["AB", "A", "ABCDEFG", "-", "1", "23", "x", "_", " ", "é"],
    "pr_number": ["PR", "pr", "-", "#", " ", "7", "12", "x", "é"],
    "email": ["a", "b1", ".", "@", "@", "-", "_", "%", " ", "co", ".io", "é", "x.org", "9"],
    "service": ["a", "b2", "7", "-", "-", "-api", "-db", "-service", "X", "_", " ", "é", "-apis", "cache"],
    "file_path": ["a", ".", "/", ".py", ".json", ".js", ".yml", "_", " ", "é", "-", "x.go"],
    "timeout_ms": ["1", "23", " ", "ms", "m", "x", "٣", "\n"],
    "depends_on": ["a", "-", "é", " ", "\n", "depends on", "Depends_on", "depends", "on"],
    "affects right": ["timeout", "Time", "out", " ", "\n", "in", "of", "from", "a-b", ".", "é"],
    "affects left": ["a", "-", " ", "unresponsive", "Unresponsive", "é", "\n"],
    "phrase": ["Ab", "Cde", "F", "g", " ", "  ", "\n", "é", "X", "_", "-", "Zz"],
}


def plain(kind):
    return {**ENTITIES, "phrase": PHRASE, **{r: p for p, r, _ in RELATIONS}, **{f"{r} {d}": p for p, r, d in RELATIONS}}[kind]


@pytest.mark.parametrize("kind", sorted(LINEAR))
def test_linear_patterns_find_the_same(spark, kind):
    rng = random.Random(kind)
    texts = {"".join(rng.choice(PIECES[kind]) for _ in range(rng.randint(1, 14))) for _ in range(6000)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    groups = [F.lit(i) for i in ((1, 2) if kind == "depends_on" else (1,))]
    both = rows.select("t", *[F.array(*[F.filter(F.regexp_extract_all("t", F.lit(p), g), lambda v: v != "") for g in groups]).alias(n) for n, p in (("want", plain(kind)), ("got", LINEAR[kind]))])
    assert both.where("want <> got").take(3) == []
    assert both.where("size(want[0]) > 0").count() > 10


def test_texts_are_tested_once_and_none_is_passed_over(spark):
    """What whole patterns find in each text is found, though most texts are searched for few of them and by lines; one pass over a batch tells which."""
    rng = random.Random(5)
    odd = ["\n", "\x0b", "\x1c", "\u0085", "\u3000", "\u0663", "\u0660", "\u0130", "\u0131", "\u017f", "\u212a", "\u65e5", " ", "4", "5", "deadbee", "0af", "f", "fix", "FIX", " 404 ", " 5\u0663\u0660 ", "503", " f\u0130x AB-12 ", " Fixed CD-\u0663", "F\u0131xes", "cau\u017fed by", "owner", ":", "modified", "AB-1"]
    pieces = [*odd, *sum(PIECES.values(), [])]
    texts = {"".join(rng.choice(pieces if rng.random() < 0.5 else own) for _ in range(rng.randint(1, 16))) for own in [*PIECES.values(), odd] for _ in range(1500)} | {""}
    rows = spark.createDataFrame([(f"R{i}", None if i % 9 == 0 else "T", t) for i, t in enumerate(sorted(texts))], "id string, title string, body string").repartition(4)
    found = extract_with_rules(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "body")

    def matches(pattern, value):
        return F.transform(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: v != ""), value)

    def typed(kind):
        return lambda v: F.concat(F.lit(kind + " "), v)

    def as_(relation):
        return lambda v: F.concat(F.lit(relation), F.substring(v, 1, 0))

    want = F.concat(*[matches(p, typed(k)) for k, p in ENTITIES.items()])
    edges = F.concat(*[matches(p, as_(r)) for p, r, _ in RELATIONS])
    phrases = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1)))), ", ")

    def names(e):
        return F.transform(e, lambda x: F.concat(x["type"], F.lit(" "), x["name"]))

    both = found.select("id", "body", want.alias("want"), names(F.col("entities")).alias("got"), names(entities(text)).alias("alone"), edges.alias("want_edges"), F.col("relationships.relation").alias("got_edges"),
                        phrases.alias("want_phrases"), F.coalesce("unresolved_text", F.lit("")).alias("got_phrases"), F.coalesce(unresolved(text), F.lit("")).alias("phrases_alone")).cache()
    assert both.where("want <> got OR want <> alone OR want_edges <> got_edges OR want_phrases <> got_phrases OR want_phrases <> phrases_alone").take(3) == []
    for kind in ENTITIES:
        assert both.where(F.exists("want", lambda v: v.startswith(kind + " "))).count() > 10, kind
    assert both.where("want_phrases <> ''").count() > 10 and both.where(F.array_contains("want_edges", "fixes")).count() > 10
    both.unpersist()
    # Few texts are searched for all.
    assert rows.where(likely(F.col("body")) == 0).count() > 0


def test_ends_are_stripped_the_same(spark):
    rng = random.Random(2)
    texts = {"".join(rng.choice([" ", "\n", "\r", "\u0085", " ", "a", "\t"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("want", F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))
    assert rows.where(strip(F.col("t")) != F.col("want")).count() == 0 and "++" in ENDS


def test_texts_that_are_hard_for_patterns(spark):
    """A megabyte of each takes seconds at most, and no recursion overflows the stack."""
    hard = ["Ab ", "Ab  Cd ", "a-a-", "1-a-", "a.", "a./", "1", "timeout ", "timeout in ", " ", "\n", "depends ", "a@", "a@b.", "x", "PR ", "PR#", "fixes ", "é", "A-", "AB-1", "owner:", "0", "ms ", "caused ", "{", "-", "a_", "-api", "a-api-"]
    rows = spark.createDataFrame([(i, (x * 1_000_000)[:1_000_000]) for i, x in enumerate(hard)], "i int, t string").repartition(4).cache()
    rows.count()
    for make in (entities, lambda t: relations(F.lit("R"), t), unresolved, strip):
        start = time.time()
        rows.select("i", make(F.col("t")).alias("x")).write.format("noop").mode("overwrite").save()
        assert time.time() - start < len(hard)
    answers = rows.withColumns({"answer": F.concat("t", F.lit(" [9]. Yes [1].")), "sources": F.array(F.struct(*[F.lit("c").alias(c) for c in ("chunk_id", "filename")], F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("t").alias("text")))})
    assert citations.checked(answers).where("size(citations) = 1").count() == len(hard)
    rows.unpersist()
