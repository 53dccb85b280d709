import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.config import Config
from tessera.functions.models import silent
from tessera.functions.text import text_hash
from tessera.operators import bm25, citations, extract, fusion, vector
from tessera.operators.cascade import extract_all, extract_tiered
from tessera.operators.incremental import manifest_rows
from tessera.operators.normalize import normalize_all
from tessera.plans import agent, build, catalog, fixtures, oracle, retrieval
from tessera.sources import files, graphs, tables
from tessera.streaming.ingest import ingest_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if x != x else f"{x:.6f}"
    return [plain(y) for y in x] if hasattr(x, "__len__") and not isinstance(x, (str, bytes)) else x


def same_as_sql(spark, folder, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want, got = con.sql(sql).df(), query(spark, folder).toPandas()
    spark.catalog.clearCache()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    rows = [sorted(repr([plain(x) for x in r]) for r in df[cols].itertuples(index=False)) for df in (want.astype(object), got.astype(object))]
    assert [r.replace("nan", "None").replace("<NA>", "None") for r in rows[0]] == [r.replace("nan", "None").replace("<NA>", "None") for r in rows[1]]


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_catalog_against_sql(spark, small, name):
    same_as_sql(spark, small, catalog.QUERIES[name], oracle.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_build_is_incremental(spark, tmp_path):
    fixtures.write_raw(str(tmp_path / "raw"))
    first = build.build_records(spark, str(tmp_path / "raw"), str(tmp_path / "store"))
    again = build.build_records(spark, str(tmp_path / "raw"), str(tmp_path / "store"))
    assert first["total"] > 0 and first["vectors_added"] == 17
    assert again["total"] == 0 and again["vectors_added"] == 0 and again["vectors_skipped"] == 17
    nodes, edges = graphs.load(spark, str(tmp_path / "store" / "graph"))
    shown = build.health(spark, str(tmp_path / "store"))
    assert sum(r["n"] for r in shown["overview"] if r["what"] == "type") == shown["nodes"] and sum(r["n"] for r in shown["overview"] if r["what"] == "tier") == 17
    assert {r["name"] for r in shown["overview"] if r["what"] == "relation"} >= {"mentions", "owned_by"} and sum(r["cost"] or 0 for r in shown["overview"]) == pytest.approx(first["total"])
    assert nodes.count() > 17 and edges.count() > 17
    store = agent.Store(nodes, edges, tables.vector_table(spark, str(tmp_path / "store" / "vectors")).read())
    out = agent.run_agent("Who mends the inventory-service when it stalls at night?", store, agent.Offline(("inventory-service",)))
    assert out["tool_call_count"] == 4 and "James Liu" in out["answer"] and not out["stopped_early"]
    assert agent.run_agent("What is pgw?", store, agent.Offline())["tool_call_count"] == 1
    assert "error" in json.loads(agent.run_tool(store, "no_such_tool", {}))
    capped = agent.run_agent("Who mends the inventory-service when it stalls at night?", store, agent.Offline(("inventory-service",)), Config(max_tool_calls=2))
    assert capped["tool_call_count"] == 2 and capped["stopped_early"]
    few = json.loads(agent.run_tool(store, "get_active_incidents", {"service_name": "inventory"}, 1))
    assert len(few) == 1 and len(json.loads(agent.run_tool(store, "get_active_incidents", {"service_name": "inventory"}))) > 1
    with pytest.raises(FileNotFoundError):
        graphs.load(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        build.build_records(spark, str(tmp_path / "none"), str(tmp_path / "store"))


def test_cascade_tiers(spark):
    records = normalize_all(fixtures.sources(spark))

    def broken(prompt, model):
        if "cheap" in model:
            raise RuntimeError
        return '{"entities": [{"id": "new"}, {"name": "no id"}], "relationships": [{"from": "new", "relation": "owns", "to": "x"}]}'

    empty = spark.createDataFrame([], "text_hash string, result_json string, tier_used string, created_at string")
    rows = {r.id: r for r in extract_tiered(records, empty, broken).collect()}
    assert rows["WIKI-7"].tier == "llm_frontier" and any(e.id == "new" and e.confidence == 0.85 for e in rows["WIKI-7"].entities)
    assert rows["EV-902"].tier == "llm_cheap" and rows["EV-902"].failed
    assert rows["OPS-33"].tier == "rule" and not rows["OPS-33"].failed
    assert all(e.source == "rule" for r in extract_tiered(records, empty, silent).collect() for e in r.entities)


def test_cascade_reads_records_once(spark, tmp_path):
    """All records are searched in one pass and kept; prompts that many share are joined where they lie; each row is there once."""
    said = [(f"T-{i}", "Notes", "fit by the Shop Floor Manual" if i % 2 else f"OPS-{i} fixed", "jira") for i in range(3000)]
    said += [("T-1", "Notes", "known before", "jira"), ("T-4", "Notes", "log line", "logs"), (None, "Notes", "without id", "jira"), ("D-1", "Guide", "Ask the Night Desk " + "x " * 200, "confluence")]
    spark.createDataFrame(said, "id string, title string, body string, source string").write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    # T-1 is unchanged in one of its two rows, T-0 in its only one.
    known = records.where("body = 'known before' OR id = 'T-0'").withColumns({"tier": F.lit("rule"), "ord": F.lit(1)})
    cache = records.where("source = 'logs'").select(text_hash(F.col("title"), F.col("body")).alias("text_hash"), F.lit('{"entities": [], "relationships": []}').alias("result_json"))
    out = extract_all(records, cache, manifest_rows(known, "2026-01-01 00:00:00"), lambda prompt, model: '{"entities": [{"id": "met"}], "relationships": []}')
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    rows = out.collect()
    assert sorted((r.id or "", r.body) for r in rows) == sorted((i or "", body) for i, _, body, _ in said if body != "known before")
    assert {r.tier for r in rows if "Manual" in r.body} == {"llm_cheap"} and all([e.id for e in r.entities][-1] == "met" for r in rows if r.tier.startswith("llm"))
    assert [(r.tier, r.processed, list(r.entities)) for r in rows if r.source == "logs"] == [("cache", True, [])]
    assert [r.processed for r in rows if r.id == "T-0"] == [False] and [r.tier for r in rows if r.id == "D-1"] == ["llm_frontier"] and not any(r.failed for r in rows)


def test_each_prompt_is_asked_once(spark, tmp_path):
    """Whatever is read of the result, and however often records share a prompt."""
    log = str(tmp_path / "calls")

    def counting(prompt, model):
        with open(log, "a", encoding="utf-8") as file:
            file.write(json.dumps([model, prompt]) + "\n")
        return '{"entities": [{"id": "met"}], "relationships": []}'

    records = normalize_all(fixtures.sources(spark))
    records = records.unionByName(records.where("id = 'EV-902'").withColumns({"id": F.lit("EV-902b"), "ord": F.lit(900).cast("long")}))
    empty = spark.createDataFrame([], "text_hash string, result_json string, tier_used string, created_at string")
    out = extract_tiered(records, empty, counting)
    rows = out.collect()
    assert out.count() == len(rows) == records.count()
    calls = [tuple(json.loads(x)) for x in open(log, encoding="utf-8")]
    assert len(calls) == len(set(calls)) > 0
    assert {m for m, _ in calls} == {Config().cheap_model, Config().frontier_model}
    assert {r.tier for r in rows if r.id.startswith("EV-902")} == {"llm_cheap"} and all(any(e.id == "met" for e in r.entities) for r in rows if r.tier != "rule")


def test_folder_and_stream_ingest(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.TXT").write_bytes(b"alpha beta \xff gamma " * 200)
    (folder / "deep" / "b.md").write_text("delta epsilon")
    (folder / "c.csv").write_text("no")
    (folder / "d.pdf").write_bytes(b"not a pdf at all")
    out = build.ingest_folder(spark, str(folder), str(tmp_path / "store"))
    assert out["files_found"] == 3 and out["chunks_indexed"] == out["total_chunks_in_store"] > 3
    assert build.ingest_folder(spark, str(folder), str(tmp_path / "store"))["chunks_indexed"] == 0
    (folder / "e.txt").write_text("zeta eta theta")
    ingest_stream(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "ck"), once=True).awaitTermination()
    stored = tables.chunk_table(spark, str(tmp_path / "store/chunks")).read()
    assert stored.where("filename = 'e.txt'").count() == 1 and stored.count() == out["total_chunks_in_store"] + 1
    index = bm25.Index.read(spark, str(tmp_path / "store/bm25"))
    q = spark.createDataFrame([(1, "theta zeta"), (2, "absent")], "query_id int, query string")
    best = bm25.search(index, q, 3).orderBy("query_id", "rank").collect()
    assert best[0].score > 0 and len(best) == 6
    got = files.with_text(files.from_uploads(spark, [("x/y.txt", b"caf\xc3\xa9 \xff")])).collect()
    assert got[0].filename == "y.txt" and got[0].text == "café �"
    with pytest.raises(ValueError):
        files.read_folder(spark, str(folder / "a.TXT"))


def test_pdf_files(spark, tmp_path):
    """With a reader at hand, pages are joined; files of hardly any text, and those that are no PDF, are told of."""
    (tmp_path / "lib").mkdir()
    fake = "class _Page:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t\nclass PdfReader:\n    def __init__(self, f):\n        raw = f.read()\n        if not raw.startswith(b'%PDF'): raise ValueError('no PDF')\n        self.pages = [_Page(t or None) for t in raw[4:].decode().split('|')]\n"
    (tmp_path / "lib" / "pypdf.py").write_text(fake)
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "pypdf.py"))
    folder = tmp_path / "docs"
    folder.mkdir()
    long = "page one of a text that is long enough, " * 2
    for name, content in (("a.pdf", f"%PDF {long}||end "), ("b.PDF", "%PDFscan"), ("c.pdf", "broken \xff"), ("d.md", "x")):
        (folder / name).write_bytes(content.encode("latin-1"))
    rows = {r.filename: r for r in files.with_text(files.read_folder(spark, str(folder))).collect()}
    assert rows["a.pdf"].text == f"{long}\n\n\n\nend" and rows["a.pdf"].warning is None and rows["d.md"].warning is None
    assert rows["b.PDF"].text == "scan" and "hardly" in rows["b.PDF"].warning and rows["c.pdf"].text == "broken \ufffd" and "not read" in rows["c.pdf"].warning
    problems = {r.filename: r.problem for r in files.file_problems(spark, str(folder)).collect()}
    assert set(problems) == {"b.PDF", "c.pdf"}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "60")
    problems = {r.filename: r.problem for r in files.file_problems(spark, str(folder)).collect()}
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert set(problems) == {"a.pdf", "b.PDF", "c.pdf"} and "too long" in problems["a.pdf"]


def test_tables_add_and_put(spark, tmp_path, monkeypatch):
    """Additions cost files of their own; what is read is the last row of each key."""
    monkeypatch.setattr(tables, "MOST_PARTS", 4)
    t = tables.Table(spark, str(tmp_path / "t"), "k string, v int, w string", "k")
    assert t.read().count() == 0
    want = {}
    for i in range(8):
        rows = [("a", i, "put"), (f"p{i}", i, "put")]
        t.upsert(spark.createDataFrame(rows + [("a", i + 100, "put")], "k string, v int, w string"))
        want |= {k: (v, w) for k, v, w in rows}
        more = [("a", -1, "no"), (f"n{i}", 2, "second"), (f"n{i}", 1, "zero")]
        assert t.append_absent(spark.createDataFrame(more, "k string, v int, w string"), "w") == (1, 2)
        want[f"n{i}"] = (2, "second")
        assert {r.k: (r.v, r.w) for r in t.read().collect()} == want and t.read().count() == len(want)
        assert len(t._live()) <= 6
    assert any("-base-" in name for name in t._live())


def test_ingest_adds_postings(spark, tmp_path):
    """A second batch adds its own postings; search finds the same as in an index fitted on all chunks."""
    folder, store = tmp_path / "docs", str(tmp_path / "store")
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.txt").write_text(" ".join(f"w{j % (i + 3)}" for j in range(30 + i)))
    (folder / "long.txt").write_text("w1 " * 4000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")
    stages = []
    out = build.ingest_folder(spark, str(folder), store, progress=lambda stage, n: stages.append((stage, n)))
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert (out["files_found"], out["files_processed"], out["files_skipped"]) == (7, 6, 1) and stages == [("found", 7), ("read", 6), ("stored", 6)]
    assert [r.filename for r in files.list_folder(spark, str(folder)).orderBy("ord").collect()] == [f"{i}.txt" for i in range(6)] + ["long.txt"]
    assert build.ingest_folder(spark, str(folder), store)["chunks_indexed"] > 0
    index, whole = bm25.Index.read(spark, f"{store}/bm25"), bm25.fit(tables.chunk_table(spark, f"{store}/chunks").read())
    assert index.chunks.count() == whole.chunks.count()
    q = spark.createDataFrame([(1, "w1 w7"), (2, "w0")], "query_id int, query string")
    found = [[(r.query_id, r.chunk_id, round(r.score, 9)) for r in bm25.search(x, q, 5).orderBy("query_id", "rank").collect()] for x in (index, whole)]
    assert found[0] == found[1]
    assert build.health(spark, store) == {"records": 0, "chunks": whole.chunks.count(), "nodes": None, "edges": None, "last_build": None, "overview": None}


def test_search_stages(spark, small):
    own = catalog.chunks(spark, small)
    asked = spark.createDataFrame([(1, "the of and"), (2, "")], "query_id int, query string")
    found = retrieval.search(own, asked)
    rows = {r.query_id: r for r in found.funnel().collect()}
    assert rows[1].bm25_hits == 50 and rows[1].after_rrf == 20 and rows[1].after_rerank == 5
    answers = {r.query_id: r for r in retrieval.answer(found, asked).collect()}
    assert len(answers[1].citations) == 2
    nothing = retrieval.answer(retrieval.search(own.limit(0), asked), asked).collect()
    assert all(r.answer == citations.NOT_ENOUGH and r.citations == [] for r in nothing)


def test_answers_of_a_model(spark, small):
    """What a model says is checked against its sources; a failed call's text is the answer."""
    asked = spark.createDataFrame([(1, "the of and"), (2, "to in"), (3, "fail")], "query_id int, query string")

    def complete(prompt, model):
        if "fail" in prompt.split("Question: ")[1].split("\n")[0]:
            raise RuntimeError("no line")
        return "So it is [1]. Or not [77]. And [2]."

    rows = {r.query_id: r for r in retrieval.answer(retrieval.search(catalog.chunks(spark, small), asked), asked, complete=complete).collect()}
    assert rows[1].answer == "So it is [1]. And [2]." and [c.ref for c in rows[2].citations] == [1, 2]
    assert "no line" in rows[3].answer and rows[3].citations == []


def test_rrf_prefers_agreement(spark):
    kind = "query_id int, chunk_id string, score double, rank int"
    a = spark.createDataFrame([(1, "x", 1.0, 1), (1, "y", 0.5, 3)], kind)
    b = spark.createDataFrame([(1, "y", 0.4, 7), (1, "z", 0.9, 1)], kind)
    assert [r.chunk_id for r in fusion.fuse(a, b).orderBy("rank").collect()] == ["y", "x", "z"]


def test_plans_stay_in_the_jvm(spark, small):
    text = bm25.search(bm25.fit(catalog.chunks(spark, small)), catalog.questions(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text
    text = vector.top_by_cosine(catalog.table(spark, small, "embeddings"), [1.0] * 64, 5, "vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text


def odd_documents(spark, folder):
    """Given documents, and such as each clause of the rule for complex records decides alone."""
    said = "so it was and so it is and nobody knew "
    texts = [
        ("", None), (None, "wiki"), ("short", "confluence"), ("short", "wiki"), ("By Anna Maria Smith", "wiki"), (said * 10, "wiki"), (said * 10 + "a@b.io c@d.io", "wiki"), (said * 30, "wiki"),
        ("JR-1 PR 22 auth-service 35 ms", "wiki"), ("JR-1 PR 22 auth-service 35 ms caused by rain", "wiki"), ("404 500 503 a@b.io", "wiki"), ("404 500 503 a@b.io, caused by rain", "wiki"), ("404 500 503", "wiki"),
        (said * 10 + "see lib/main.py and 20 ms", "wiki"), (said * 10 + "PR-7 PR-8", "wiki"),
    ]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(100_000 + i, text, "en", source, len(text or "")) for i, (text, source) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def found_by_hand(text):
    """The kinds of all entities in a text, how many relations it has, and whether it has phrases."""
    plain = lambda p: re.sub(r"^\(\?(i?)Ud?\)", lambda m: "(?i)" if m[1] else "", p)
    patterns = lambda ps: [re.compile(plain(p)) for p in ps]
    kinds = [k for k, p in zip(extract.ENTITIES, patterns(extract.ENTITIES.values())) for _ in p.finditer(text)]
    return kinds, sum(len(p.findall(text)) for p in patterns(p for p, *_ in extract.RELATIONS)), bool(patterns([extract.PHRASE])[0].search(text))


def complex_by_hand(text, lang, source):
    kinds, relations, _ = found_by_hand(f"{lang or ''} {text or ''}")
    n = len(text or "")
    return n > 800 or (len(kinds) < 2 and n > 300) or source == "confluence" or (relations == 0 and len(kinds) > 3)


def test_tiers_by_hand(spark, tmp_path):
    rows = odd_documents(spark, tmp_path)
    want = dict.fromkeys(("cache", "rule", "llm_cheap", "llm_frontier"), 0)
    for _, text, lang, source, _ in rows:
        want["llm_frontier" if complex_by_hand(text, lang, source) else "llm_cheap" if found_by_hand(f"{lang} {text or ''}")[2] else "rule"] += 1
    got = {r.tier: (r.records, r.cost) for r in catalog.tier_costs(spark, str(tmp_path)).collect()}
    price = {"cache": 0, "rule": 0, "llm_cheap": 0.0002, "llm_frontier": 0.003}
    assert got == {t: (n, pytest.approx(n * price[t])) for t, n in want.items()}
    records = catalog.document_records(spark, str(tmp_path))
    empty = spark.createDataFrame([], "text_hash string, result_json string, tier_used string, created_at string")
    assert {r.tier: r["count"] for r in extract_tiered(records, empty, silent).groupBy("tier").count().collect()} == {t: n for t, n in want.items() if n}


def test_complex_documents_by_hand(spark, tmp_path):
    rows = odd_documents(spark, tmp_path)
    got = catalog.needs_frontier(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.frontier) for r in got) == sorted((str(i), complex_by_hand(text, lang, source)) for i, text, lang, source, _ in rows)


def test_entities_of_all_kinds(spark, tmp_path):
    rows = odd_documents(spark, tmp_path)
    got = sorted((r.id, r.type) for r in catalog.entities_documents(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), k) for i, text, lang, _, _ in rows for k in found_by_hand(f"{lang or ''} {text or ''}")[0])
    assert {k for _, k in got} == set(extract.ENTITIES)
