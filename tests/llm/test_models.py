import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, mixing, quality, toxicity
from tessera.llm.common import read_table


def targets_by_hand(sizes):
    """Sharing what is above a cap again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(hard, hard_list, empty):
    rows = mixing.mix(hard).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r["size"]) for r in rows), key=repr) == sorted(((d, size(t)) for d, t, _ in hard_list), key=repr)
    sizes = defaultdict(int)
    for _, t, s in hard_list:
        sizes[s] += size(t)
    want, taken = targets_by_hand(sizes), defaultdict(int)
    longest = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    assert sorted(map(repr, mixing.mix(hard.repartition(2)).collect())) == sorted(map(repr, rows))
    assert mixing.mix(empty).count() == 0


def test_mixed_corpus(hard, empty):
    own = hard.where("doc_id > 8 AND doc_id < 40").dropDuplicates(["doc_id"])
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(own).collect()}
    got = mixing.repeat_by_mix(own)
    assert got.columns == own.columns
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert times == {d: t // n for d, (t, n) in taken.items() if t}
    assert mixing.repeat_by_mix(empty).count() == 0


def test_rows_that_share_an_id_are_repeated_each_by_its_own(spark, hard):
    """Sources of all weights hold the same ids; what one source takes of an id says nothing about another's row."""
    rows = [(i, f"{s} {'word ' * (1 + (i * n) % 7)}".strip(), s) for i in range(30) for n, s in enumerate("abc", 1)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, source string"), hard):
        want = defaultdict(int)
        for r in mixing.mix(docs).where("size > 0").collect():
            want[r.doc_id, r.source, r["size"]] += r.taken
        got, words = defaultdict(int), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
        for r in mixing.repeat_by_mix(docs).collect():
            got[r.doc_id, r.source, words(r.text)] += words(r.text)
        assert got == {k: v for k, v in want.items() if v}


def test_targets_of_odd_sizes(spark):
    sizes = {"a": 1, "b": 1000, None: 10, "B": 0, "é": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))
    nothing = spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")
    assert {r.target for r in mixing.source_targets(nothing).collect()} == {0.0}


def test_likelier_with_weight(spark):
    """Of a source that gives half its words, documents of weight 5 are taken more often than those of weight 1."""
    docs = spark.createDataFrame([(i, "w " * 10, "s%d" % (i % 2), 5.0 if i % 4 < 2 else 1.0) for i in range(8000)], "doc_id long, text string, source string, w double")
    more = spark.createDataFrame([(10_000, "w " * 40_000, "s0", 1.0)], docs.schema)  # takes no part in the comparison
    taken = defaultdict(list)
    for r in mixing.mix(docs.unionByName(more), F.col("w")).where("doc_id < 8000").collect():
        taken[r.source, r.doc_id % 4 < 2].append(r.taken / r["size"])
    share = {k: np.mean(v) % 1 for k, v in taken.items()}
    picked = [s for s in ("s0", "s1") if 0.05 < np.mean(taken[s, True] + taken[s, False]) % 1 < 0.95]
    assert picked and all(share[s, True] > 1.3 * share[s, False] for s in picked)
    mixed = mixing.repeat_by_mix(docs, "w")
    assert mixed.columns == ["doc_id", "text", "source"]


def test_quality(spark, hard, hard_list, empty, labels):
    weights = quality.train(hard, labels)
    rows = quality.score(hard, weights).collect()
    assert len(rows) == len(hard_list)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert {r.score for r in quality.score(empty.unionByName(hard.limit(5)), quality.train(empty, labels)).collect()} == {0.5}
    kept = quality.keep_good(hard, labels)
    assert kept.columns == hard.columns and kept.count() == sum(r.predicted for r in rows)


def test_labels_of_held_out_rows_are_not_learned(hard, labels):
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(hard, labels) == quality.train(hard, flipped)).all()


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    scores = quality.op7_quality(spark, folder).where("held_out").join(read_table(spark, folder, "labels"), "doc_id").collect()
    good = [r.predicted for r in scores if r.quality == 1]
    bad = [r.predicted for r in scores if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.6 and len(scores) > 50


def test_toxicity(spark, hard, hard_list, empty, labels):
    chain = toxicity.train_chain(hard, labels)
    rows = toxicity.score_chain(hard, chain).collect()
    assert len(rows) == len(hard_list) and all(0 <= r.p_toxic <= 1 for r in rows)
    assert toxicity.score_chain(empty, toxicity.train_chain(empty, labels)).count() == 0
    folder = "/root/testdata/sf0.1"
    held = read_table(spark, folder, "labels").where(quality.held_out(F.col("doc_id")))
    docs = read_table(spark, folder, "documents")
    own = toxicity.score_chain(docs.join(held.select("doc_id"), "doc_id", "left_semi"), toxicity.train_chain(docs, read_table(spark, folder, "labels")))
    found = own.join(held, "doc_id").collect()
    assert np.mean([r.is_toxic for r in found if r.toxic]) > 0.8 and np.mean([r.is_toxic for r in found if not r.toxic]) < 0.02


def ftrl_by_hand(rows, epochs, alpha, beta, l1, l2):
    """Weights by feature from rows ({feature: value}, label), one coordinate after the other."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else ((1 if z[i] > 0 else -1) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def grams_by_hand(text, bits=quality.BITS):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode())
    one = [crc32(w) for w in words]
    all_ = one + [(a * 0x9E3779B1 & 0xFFFFFFFF) ^ b for a, b in zip(one, one[1:])] + [0x52455054 for a, b in zip(one, one[1:]) if a == b]
    return [(((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - bits) for h in all_]


def test_quality_by_hand(spark, hard, hard_list, labels):
    """The whole query over a small table: sample, hashing, updates and scores, one number at a time."""
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = min(known.get(r.doc_id, 1), r.quality)
    order = [r.id for r in spark.createDataFrame([(i,) for i in known], "id long").orderBy(F.xxhash64("id"), "id").collect()]

    def row(ids):
        x = Counter(ids)
        return {i: c / max(1, len(ids)) ** 0.5 for i, c in x.items()} | {"constant": 1.0}

    chosen = []
    for i in order:
        own = [grams_by_hand(t) for d, t, _ in hard_list if d == i]
        if own:
            chosen.append((row(min(own, key=lambda g: np.array(g, np.int32).tobytes())), known[i]))
    w = ftrl_by_hand(chosen, quality.EPOCHS, 0.3, 1.0, 0.2, 0.5)
    want = sorted((repr(d), 1 / (1 + np.exp(-sum(w.get(i, 0.0) * v for i, v in row(grams_by_hand(t)).items())))) for d, t, _ in hard_list)
    got = sorted((repr(r.doc_id), r.score) for r in quality.score(hard, quality.train(hard, labels)).collect())
    assert [g[0] for g in got] == [x[0] for x in want] and np.allclose([g[1] for g in got], [x[1] for x in want], atol=1e-4)
    assert len({round(g[1], 3) for g in got}) > 5


def test_one_id_labelled_and_repeated(spark, labels):
    """However many rows share a labelled id, one of them is learned from."""
    docs = spark.range(0, 50_000, 1, 4).selectExpr("3L AS doc_id", "concat('text ', id) AS text")
    sample = quality.sample_of(labels, "quality", 10)
    assert quality.featured(docs, sample, 18).count() <= 1
    assert len(toxicity.train_chain(docs, labels)) == 3


def test_fits_in_tasks_are_those_of_one_process(spark, hard, labels):
    """Each link's fits are tasks of their own; the chain is the one that fitting in turn gives."""
    rows = toxicity.chain_sample(hard, labels, bits=10).orderBy(F.xxhash64("key"), "key", "ids").collect()
    ids = [np.frombuffer(bytes(r.ids), np.float32).reshape(2, -1) for r in rows]
    folds = np.array([crc32(str(r.key).encode()) // 5 % toxicity.FOLDS for r in rows])
    want = toxicity.fit_chain(ids, np.array([r.marks for r in rows]), folds, 10)
    got = toxicity.train_chain(hard, labels, bits=10)
    assert len(rows) > 30 and len(got) == 3
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert toxicity.train_chain(hard, labels.limit(0)) == []


def test_later_links_learn_from_unseen_predictions():
    """Each row's input for a later link comes from a model that was fitted on the other folds."""
    rng = np.random.default_rng(0)
    rows = [np.stack((np.array([i % 50, 50 + i % 3], np.float32), np.ones(2, np.float32))) for i in range(120)]
    labels, folds = rng.integers(0, 2, (120, 2)).astype(float), np.arange(120) % 4
    chain = toxicity.fit_chain(rows, labels, folds, bits=8, epochs=2)
    assert [len(w) for w in chain] == [257, 258]

    def weights(at, column, dense):
        own = [({int(f): float(v) for f, v in rows[i].T} | {"c": 1.0} | {f"p{j}": d for j, d in enumerate(dense[i])}, labels[i, column]) for i in at]
        return ftrl_by_hand(own, 2, toxicity.ALPHA, 1.0, toxicity.L1, toxicity.L2)

    nothing, unseen = np.zeros((120, 0)), np.zeros(120)
    for f in range(4):
        w = weights([i for i in range(120) if folds[i] != f], 0, nothing)
        for i in np.flatnonzero(folds == f):
            unseen[i] = 1 / (1 + np.exp(-sum(w.get(int(x), 0.0) for x in rows[i][0]) - w["c"]))

    def as_array(w, extra):
        out = np.zeros(257 + extra)
        for k, v in w.items():
            out[k if isinstance(k, int) else 256 + extra if k == "c" else 256 + int(k[1:])] = v
        return out

    assert np.allclose(chain[0], as_array(weights(range(120), 0, nothing), 0), atol=1e-4)
    assert np.allclose(chain[1], as_array(weights(range(120), 1, unseen[:, None]), 1), atol=1e-4)
    whole = weights(range(120), 0, nothing)
    seen = np.array([1 / (1 + np.exp(-sum(whole.get(int(x), 0.0) for x in r[0]) - whole["c"])) for r in rows])
    assert not np.allclose(chain[1], as_array(weights(range(120), 1, seen[:, None]), 1), atol=1e-4)


def near_by_hand(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good[i], v) if i in good else v
    x = {i: np.array(v, np.float32).astype(float) for i, v in good.items()}
    out = []
    for q in x:
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x[q], v)), i) for i, v in x.items() if i != q))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(160)]
    rows += [(i, rows[0][1]) for i in range(200, 240)]  # ties
    rows += [(300, None), (301, [0.0] * 8), (302, [None] * 8), (303, [float("nan")] * 8), (320, [float("inf")] + [1.0] * 7), (305, [1.0]), (None, [1.0] * 8), (7, rows[9][1]), (340, [30.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    want = near_by_hand(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    same = len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want})
    assert same >= 0.97 * len(want)
    exact = {(w[0], w[2]): w[3] for w in near_by_hand(rows, 10_000)}
    assert all(exact[g[0], g[2]] == g[3] for g in got)
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id IN (0, 1, 2, 300)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)]


def test_recall_of_lists(spark):
    folder = "/root/testdata/sf0.1"
    v = read_table(spark, folder, "embeddings")
    rows = {r.vec_id: np.array(r.embedding) for r in v.collect()}
    ids, x = np.array(list(rows)), np.array(list(rows.values()))
    found = defaultdict(set)
    for r in ann.op6_nearest(spark, folder).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for q in ids[ids % 20 == 0]:
        s = x @ rows[q]
        s[ids == q] = -9
        hits.append(len(found[q] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("aim", [ann.AIM, 0.2])
def test_every_query_has_k_rows(spark, monkeypatch, aim):
    """Several lists, all vectors in the sample: queries whose lists miss neighbours lose no rank."""
    monkeypatch.setattr(ann, "AIM", aim)
    v = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    got = defaultdict(list)
    for r in ann.nearest(v).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    assert all([n for n, _ in g] == list(range(1, 21)) and len(set(g)) == 20 for g in got.values())
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    for q, g in got.items():
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        # Here the bound is exact, so no query with k rows has a wrong one.
        assert {i for _, i in g} == set(ids[np.lexsort((ids, -s))[:20]].tolist())


def varied(kind, n=6_000, dims=24):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, dims))
    x = centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "uneven norms":
        x *= np.exp(0.7 * rng.normal(size=(n, 1)))
    if kind == "outlier":
        x[7] *= 60
    if kind == "copies":
        x[: n // 3] = x[0]
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["unit", "uneven norms", "outlier", "copies"])
def test_recall_of_vectors_of_many_lists(spark, kind):
    """More vectors than are sampled, tens of lists: every query has its rows, and its nearest with few exceptions."""
    x = varied(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q in range(0, len(x), 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        kth = np.sort(s)[-20]
        assert len({i for i, _ in found[q]}) == len(found[q]) == 20 and q not in {i for i, _ in found[q]}
        assert np.allclose([v for _, v in found[q]], s[[i for i, _ in found[q]]], rtol=1e-12)
        hits.append(np.mean([v >= kth - 1e-12 for _, v in found[q]]))
    print(kind, "mean", np.mean(hits), "least", min(hits))
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.5


def test_a_query_is_written_once_however_many_lists_it_reads(spark, monkeypatch):
    """Vectors without structure, for which most lists are read: what is written grows with the queries, not with queries times lists."""
    x = np.random.default_rng(3).normal(size=(6_000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    real, rows = ann.written, defaultdict(list)

    def counted(frame, name):
        out = real(frame, name)
        rows[name].append(out.count())
        return out

    monkeypatch.setattr(ann, "written", counted)
    monkeypatch.setattr(ann, "BLOCK", 1024)
    monkeypatch.setattr(ann, "CELL_QUERIES", 100)
    found = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert rows["routes"][0] == 300 and "others" not in rows
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert np.mean([len(set(found[q]) & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in range(0, 6_000, 20)]) >= 0.95


@pytest.mark.parametrize("scores", [1 << 21, 64])
def test_best_in_cell_is_exact(monkeypatch, scores):
    """Lists that share vectors, copies, ties, queries that are among them; each query reads some of the lists."""
    monkeypatch.setattr(ann, "SCORES", scores)
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, size=(300, 4)).astype(np.float32)
    x[50:150] = x[50]
    lists = rng.integers(0, 5, 300) * 3
    ids = rng.permutation(1000)[:300]
    again = rng.permutation(300)[:80]
    at, own = np.concatenate((np.arange(300), again)), np.concatenate((lists, (lists[again] + 3) % 15))
    asked = np.concatenate((np.arange(40, 70), np.arange(10)))
    least = np.where(np.arange(40) % 4 == 0, 3.0, -np.inf)
    row, read = np.nonzero(rng.random((40, 15)) < 0.5)
    got = list(zip(*(a.tolist() for a in ann.best_in_cell(own, ids[at], x[at], ids[asked], x[asked], least, row, read, 7))))
    want = []
    for n, q in enumerate(asked):
        seen = {i: float(x[q].astype(float) @ x[i].astype(float)) for i, l in zip(at, own) if l in set(read[row == n].tolist()) and i != q}
        want += sorted(((int(ids[q]), int(ids[i]), s) for i, s in seen.items() if s >= least[n]), key=lambda r: (-r[2], r[1]))[:7]
    assert sorted(got) == sorted(want)
    assert all(len(a) == 0 for a in ann.best_in_cell(own[:1], ids[:1], x[:1], ids[:1], x[:1], np.zeros(1), np.zeros(0, int), np.zeros(0, int), 7))


def test_lists_are_pruned_and_balanced():
    for kind in ("unit", "uneven norms", "outlier"):
        x = varied(kind)
        index = ann.Index.fit(x[:2048], len(x) // ann.LIST_SIZE, float(np.linalg.norm(x.astype(float), axis=1).max()))
        index.calibrate(x[:2048], 20)
        row, lists = index.assign(x)
        assert set(row) == set(range(len(x)))
        sizes = np.bincount(lists, minlength=index.size)
        s = x[::20].astype(float) @ x[:2048].T.astype(float)
        at, _, _ = index.route(x[::20], sizes, 20, -np.partition(-s, 20, axis=1)[:, 20])
        assert sizes.max() <= 6 * ann.LIST_SIZE and len(at) / len(x[::20]) <= 0.5 * index.size
