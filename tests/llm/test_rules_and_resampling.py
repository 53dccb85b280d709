import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import quality_rules, resampling
from tessera.llm.common import read_table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_of(text, n_grams):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    return words, [" ".join(words[i : i + g]) for g in range(1, n_grams + 1) for i in range(len(words) - g + 1)]


def resampled_by_hand(docs, target, n_grams, buckets, percent, least_words, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [Counter(map(bucket, grams_of(t, n_grams)[1])) for _, t in docs]
    s, t = sum(own, Counter()), sum((Counter(map(bucket, grams_of(x, n_grams)[1])) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (d, text), counts in zip(docs, own):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[b] for b, n in counts.items())
        rows.append((d, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(grams_of(text, n_grams)[0])))
    good = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    places = [*range(1, percent * len(good) // 100 + 1)] + [None] * len(good)
    return sorted([(*r[:4], p) for r, p in zip(good, places)] + [(*r[:4], None) for r in rows if r[4] < least_words], key=repr)


@pytest.mark.parametrize("n_grams, buckets, percent", [(1, 10_000, 10), (3, 97, 40)])
def test_resampling_by_hand(spark, hard, hard_list, n_grams, buckets, percent):
    wanted = ["word next line", None, hard_list[13][1]]
    target = spark.createDataFrame([(t,) for t in wanted], "text string")
    got = resampling.resample(hard, target, n_grams, buckets, percent, 5).collect()
    want = resampled_by_hand([(d, t) for d, t, _ in hard_list], wanted, n_grams, buckets, percent, 5, "2024")
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr) == want


def test_resampling_of_long_texts_in_pieces(spark, hard, hard_list):
    got = resampling.bucket_counts(hard, 3, 50, piece=100, step=1000).collect()
    want = []
    for d, t, _ in hard_list:
        counts = Counter(zlib.crc32(g.encode()) % 50 for g in grams_of(t, 3)[1])
        want.append(repr((d, sum(counts.values()), sorted(counts.items()))))
    assert sorted(repr((r.doc_id, r.n_features, sorted(zip(r.buckets, r.counts)))) for r in got) == sorted(want)
    counted = spark.createDataFrame([(sum(max(0, w - g) for g in range(3)), w) for w in range(9)], "n long, w int")
    assert all(r.x == r.w for r in counted.select("w", resampling.n_words(counted.n, 3).alias("x")).collect())


def test_resampling_of_nothing(spark, hard, empty):
    assert resampling.resample(empty, empty).count() == 0
    assert resampling.resample(hard, empty).count() == hard.count()


def test_resampling_against_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    columns = "doc_id, n_features, weight, score, rank"
    want = con.sql(f"SELECT {columns} FROM ({resampling.ORACLE_SQL})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in resampling.op11_resample(spark, small).select(*columns.split(", ")).collect())


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(runs)
    inside = {j for i, r in enumerate(runs) if times[r] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules_by_hand(spark, hard, hard_list, labels, empty):
    more = ["a b c d e f g h " * 3, "a b c d e f g h i " * 2 + "x", "w " * 30, "# * $\n# * $\n\n\n# * $ ", " ".join(map(str, range(40))) + " 3 4 5 6 7 8 9 10 end"]
    texts = [(d, t) for d, t, _ in hard_list] + [(1000 + i, t) for i, t in enumerate(more)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = quality_rules.apply_rules(rows, labels).collect()
    want = sorted(repr((d, *base_by_hand(t or ""))) for d, t in texts)
    assert sorted(repr((r.doc_id, *[r[c] for c in quality_rules.BASE])) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    assert quality_rules.apply_rules(empty, labels).count() == 0
    unlearned = quality_rules.apply_rules(hard, labels.limit(0)).collect()
    assert len(unlearned) == len(hard_list) and all(r.kept != r.base_failed for r in unlearned)


def test_trees_walk_and_keep_their_directions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, len(quality_rules.FEATURES)))
    y = ((x[:, 0] + 0.6 * np.sin(3 * x[:, 1]) + x[:, 4] * x[:, 5] + rng.normal(size=1500)) < 0).astype(float)
    for directions in (np.array([-1, -1, 1, *[0] * (x.shape[1] - 3)]), np.array([1, 0, -1, *[0] * (x.shape[1] - 3)])):
        model = quality_rules.fit(x, y, directions)
        again = quality_rules.Trees.from_bytes(model.to_bytes())
        p = again.probability(x)

        def walk(row):
            total = model.start
            for node in model.roots:
                while model.nodes[node][2] != node:
                    node = model.nodes[node][2 if row[model.nodes[node][0]] <= model.nodes[node][1] else 3]
                total += model.nodes[node][4]
            return 1 / (1 + np.exp(-total))

        assert np.allclose(p, [walk(r) for r in x])
        for f in np.flatnonzero(directions):
            moved = np.repeat(x[:100], 60, axis=0)
            moved[:, f] = np.tile(np.linspace(-4, 4, 60), 100)
            steps = np.diff(again.probability(moved).reshape(100, 60), axis=1) * directions[f]
            assert (steps >= -1e-12).all()
    assert ((quality_rules.fit(x, y, np.zeros(x.shape[1], int)).probability(x) > 0.5) == y).mean() > 0.8


def test_quality_rules_on_held_out_rows(spark):
    """Good documents stay but for the plain rules; bad ones go."""
    folder = "/root/testdata/sf0.1"
    got = quality_rules.op12_quality_rules(spark, folder).join(read_table(spark, folder, "labels"), "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert len(good) > 500 and sum(r.kept for r in good) >= 0.99 * len(good)
    assert len(bad) > 100 and sum(r.kept for r in bad) <= 0.03 * len(bad)
