import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components, exact_dedup, simhash, suffixes
from tessera.llm.common import written

SPACE = re.compile(r"[\x20\x09-\x0D]")


def order(x):
    return (x is None, x or 0)


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[SPACE.sub("", text or "")].append((doc_id, len(text or "")))
    out = []
    for norm, own in groups.items():
        best = min(own, key=lambda x: (-x[1], order(x[0])))
        kept = False
        for x in own:
            is_best = x == best and not kept
            kept |= is_best
            out.append((x[0], best[0], len(own), is_best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(hard, hard_list, empty):
    want = exact_by_hand(hard_list)
    assert sorted(map(tuple, exact_dedup.exact_classes(hard).collect()), key=repr) == want
    assert exact_dedup.exact_classes(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(hard)
    assert kept.columns == hard.columns and kept.count() == sum(r[3] for r in want)
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_when_digests_collide(hard, hard_list):
    got = exact_dedup.exact_classes(hard, digest_bytes=1).collect()
    assert sorted(map(tuple, got), key=repr) == exact_by_hand(hard_list)


def test_filters_prune_and_levels_merge(spark):
    """Rows that the filter rules out are joined with nothing; a merge reads no run twice."""
    docs = spark.range(0, 3000).selectExpr("id AS doc_id", "if(id % 10 = 0, 'copy', concat('text ', id)) AS text")
    index = exact_dedup.DigestIndex(spark)
    for i in range(3):
        index.flush(docs.where(f"doc_id % 3 = {i}"))
        assert len(index.new) == 1
        index.compact()
        assert index.new == []
    maybe = index._hits(spark.read.parquet(*index.runs)).where("maybe").count()
    assert 300 <= maybe < 600
    sizes = {(r.kept, r.group_size): r["count"] for r in index.classes().groupBy("kept", "group_size").count().collect()}
    assert sizes == {(True, 1): 2700, (True, 300): 1, (False, 300): 299}
    more = spark.createDataFrame([(1, "te xt 7"), (2, "copy"), (3, "nothing like it"), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in index.seen(more).collect()} == {1, 2}


def test_one_row_repeated_many_times(spark):
    """Rows alike in all columns: one is kept, and no task gathers them."""
    docs = spark.range(0, 100_000, 1, 8).selectExpr("7L AS doc_id", "'the same text' AS text").unionByName(spark.createDataFrame([(8, "another"), (7, "the same  text")], "doc_id long, text string"))
    rows = exact_dedup.exact_classes(docs)
    assert {(r.kept, r.group_size): r["count"] for r in rows.groupBy("kept", "group_size").count().collect()} == {(False, 100_001): 100_000, (True, 100_001): 1, (True, 1): 1}
    assert "explode" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pipeline_drops_a_row_repeated_many_times(spark):
    """One row is a third of the table: each task that reads some passes on one."""
    docs = spark.range(0, 100_000, 1, 8).selectExpr("if(id < 99990, 7L, id) AS doc_id", "if(id < 99990, 'the same text', concat('text ', id)) AS text", "id AS n_chars")
    kept = exact_dedup.drop_exact_copies(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(7, "the same text")] + [(i, f"text {i}") for i in range(99_990, 100_000)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_index_grows_by_runs(spark, hard, hard_list):
    index = exact_dedup.DigestIndex(spark)
    for part in range(3):
        index.flush(hard.where(f"coalesce(doc_id, 0) % 3 = {part}"))
        index.compact()
    assert sorted(map(tuple, index.classes().collect()), key=repr) == exact_by_hand(hard_list)


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def near_by_hand(rows):
    marks = [fingerprint_by_hand(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (marks[i] ^ marks[j]).bit_count() <= 2 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, (doc_id, _, _) in zip(group, rows):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(((d, format(m, "016x"), least.get(g)) for (d, _, _), m, g in zip(rows, marks, group)), key=repr)


def test_simhash(hard, hard_list, empty):
    got = simhash.near_classes(hard)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == near_by_hand(hard_list)
    assert simhash.near_classes(empty).count() == 0
    kept = simhash.drop_near_copies(hard)
    assert kept.columns == hard.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} >= {c for _, _, c in near_by_hand(hard_list) if c is not None}
    assert simhash.drop_near_copies(empty).count() == 0


def pairs_within(marks, radius=2):
    return {(a, b) for i, a in enumerate(marks) for b in marks[i + 1 :] if (a ^ b).bit_count() <= radius}


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 63), st.integers(0, 63)), max_size=150))
def test_tiles_lose_no_link(centres, flips):
    marks = sorted({centres[c % len(centres)] ^ (1 << a) ^ (1 << b) for c, a, b in flips} | set(centres), key=lambda m: (m.bit_count(), m))
    a, b, _, _ = simhash.link_bins(np.zeros(len(marks), np.int64), np.array(marks, np.uint64), 8)
    assert closure(zip(a.tolist(), b.tolist()), marks) == closure(pairs_within(marks), marks)


def test_tiles_are_compared_and_skipped():
    """A bin of many tiles skips those whose bit counts are too far off; small bins share tiles."""
    rng = np.random.default_rng(3)
    marks = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    marks = np.concatenate((marks, marks[:300] ^ np.uint64(3)))
    marks = marks[np.lexsort((marks, np.bitwise_count(marks)))]
    a, b, compared, skipped = simhash.link_bins(np.zeros(len(marks), np.int64), marks)
    n = -(-len(marks) // simhash.TILE)
    assert len(a) == 300 and all(np.bitwise_count(a ^ b) <= 2)
    assert n < compared < n * (n + 1) // 2 and skipped > 0
    bins = np.arange(len(marks)) // 3
    assert simhash.link_bins(bins, marks)[2] >= n


def test_tile_pairs_of_the_given_table_are_skipped(spark):
    """Of sf0.1, whole: the classes are those of comparing everything, and part of the tile pairs needn't be compared."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = written(simhash.fingerprints(docs).select("fp").distinct(), "test-marks")
    rows = np.array([(r.t, r.k, r.fp) for r in simhash.bins_of(marks).collect()], np.int64)
    fp = rows[:, 2].view(np.uint64)
    order = np.lexsort((fp, np.bitwise_count(fp), rows[:, 1], rows[:, 0]))
    own, fp = rows[order, :2], fp[order]
    bins = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]).any(axis=1))))
    a, b, compared, skipped = simhash.link_bins(bins, fp)
    print(len(fp), bins[-1] + 1, compared, skipped)
    assert skipped > 0
    every = np.unique(fp)
    pairs = []
    for i in range(0, len(every), 512):
        x, y = np.nonzero(np.bitwise_count(every[i : i + 512, None] ^ every[None]) <= simhash.RADIUS)
        pairs += zip(every[i + x].tolist(), every[y].tolist())
    nodes = every.tolist()
    assert closure(zip(a.tolist(), b.tolist()), nodes) == closure(pairs, nodes)


@pytest.mark.parametrize("bin_", [8, 64, 2048])
def test_hot_bins_are_split(spark, monkeypatch, bin_):
    monkeypatch.setattr(simhash, "BIN", bin_)
    monkeypatch.setattr(simhash, "HOT_BIN", 20)
    rng = np.random.default_rng(1)
    marks = sorted({int(m) for m in rng.integers(0, 2**63, 40)} | {(1 << a) | (1 << b) for a in range(20) for b in range(20)})
    df = spark.createDataFrame([(m,) for m in marks], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.link_fingerprints(df).collect()]
    assert closure(links, marks) == closure(pairs_within(marks), marks)
    ends = components.components(simhash.link_fingerprints(df)).collect()
    want = closure(pairs_within(marks), marks)
    assert {r.u: r.v for r in ends} == {n: r for n, r in want.items() if n != r}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)] + [(200, x) for x in range(300, 340)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.u: r.v for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, **{x: 200 for x in range(300, 340)}}
    assert components.components(df.limit(0)).count() == 0


def repeats_by_hand(rows, length=200):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _, _), t in zip(rows, texts):
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((doc_id, len(t), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(hard, hard_list, empty):
    want = repeats_by_hand(hard_list)
    got = suffixes.remove_repeats(hard).drop("kept")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert suffixes.remove_repeats(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-2, 2), st.integers(0, 40), st.integers(1, 12)), max_size=30))
def test_joined_spans_cover_the_same(spans):
    key, start, stop = suffixes.joined_spans(*np.array([(k, a, a + n) for k, a, n in spans], np.int64).reshape(-1, 3).T)
    places = lambda x: {(k, i) for k, a, b in x for i in range(a, b)}
    got = list(zip(key.tolist(), start.tolist(), stop.tolist()))
    assert places(got) == places((k, a, a + n) for k, a, n in spans)
    assert all(k != m or b < c for (k, _, b), (m, c, _) in zip(got, got[1:]))


def test_repeats_where_one_id_is_repeated(spark):
    """Rows that share an id are texts of their own, with spans of their own."""
    body = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(400))
    rows = [(1, body), (1, "x" * 30 + body[:300]), (1, "nothing repeats here"), (None, body[100:350]), (2, None)] + [(3, f"{i} {i * i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect())
    want = repeats_by_hand([(d, t, None) for d, t in rows])
    assert got == Counter((d, n, r, k) for d, n, r, k, *_ in want)


def test_repeats_with_hot_anchors_and_small_segments(hard, hard_list, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_ANCHOR", 1)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    got = suffixes.remove_repeats(hard).drop("kept")
    assert sorted(map(tuple, got.collect()), key=repr) == repeats_by_hand(hard_list)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=30), min_size=1, max_size=9))
def test_loser_tree(runs):
    coded = []
    for own in runs:
        row = suffixes._coded(0, [(s, b"", 0, 0, [(1, 1)]) for s in sorted(set(own))])
        coded.append(suffixes._Run(row))
    want = sorted((s, i) for i, own in enumerate(runs) for s in set(own))
    at = [sorted(set(own)) for own in runs]
    got, before = [], b""
    for run, i, agree in suffixes.merged(coded):
        s = at[run][i]
        n = 0
        while n < min(len(s), len(before)) and s[n] == before[n]:
            n += 1
        assert agree == n
        got.append(s)
        before = s
    assert got == [s for s, _ in want]
