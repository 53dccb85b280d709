"""Quality rules: statistics of documents, two plain rules, and gradient-boosted trees scored as flat arrays of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread, written
from .quality import one_each, sample_of

#: The plain rules: fewer words than this, or more than so many of a hundred in windows that the text holds twice.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Rows to learn from, at most: those whose ids have the smallest hashes. This bounds training alone.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 60, 3, 64, 0.2, 1.0, 2.0
#: Documents whose probability of being good is lower go.
THRESHOLD = 0.3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see of a text, and in which direction a score may move as it rises: -1 never up, 0 either way.
FEATURES = {
    "symbols a code point": -1,
    "share of lines that repeat an earlier one": -1,
    "share of words in repeated windows": -1,
    "share of words that equal the word before": -1,
    "code points a word": 0,
    "capitals a letter": 0,
    "digits a code point": 0,
    "other marks a code point": 0,
    "share of words that are marks alone": 0,
    "words a line": 0,
    "logarithm of the number of words": 0,
}
DIRECTIONS = np.array(list(FEATURES.values()))

_BYTES = {
    "points": [i for i in range(256) if i & 0xC0 != 0x80], "spaces": [*range(9, 14), 32], "symbols": list(b"#*$%&|<>"), "capitals": list(range(65, 91)), "letters": [*range(65, 91), *range(97, 123)], "digits": list(range(48, 58)),
    "marks": [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "#*$%&|<>"],
}
#: A row for each class of bytes: 1 where a byte is of it.
CLASSES = np.array([[i in own for i in range(256)] for own in map(set, _BYTES.values())], np.int64)
#: Drops every ASCII character that is no letter or digit.
_NO_MARKS = bytes(i for i in range(128) if not chr(i).isalnum())


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, equal for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many places of a sequence lie in a window of so many that occurs twice or more in it, its first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # Runs of 1, 2, 4, ... get numbers; where no two of them are equal no longer ones are.
    size, runs = 1, ids
    while size < window:
        step = min(size, window - size)
        if int(runs.max()) + 1 == len(runs):
            return 0
        runs, size = _paired(runs[:-step], runs[step:]), size + step
    starts = np.flatnonzero(np.bincount(runs)[runs] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def statistics_of(text: bytes) -> tuple[list[int], list[float]]:
    """BASE, then FEATURES, of a UTF-8 text; of an empty one all are 0."""
    words = text.split()  # of bytes: at white space as in the contracts
    points, spaces, symbols, capitals, letters, digits, marks = (CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    lines = [x for x in text.split(b"\n") if x.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    base = [len(words), points - spaces, symbols, len(lines) - len(set(lines)), repeated(ids) if len(words) > WINDOW else 0]
    n, seen = max(1, len(words)), max(1, points - spaces)
    alone = sum(map(text.count, (b" & ", b" | ", b" - ")))
    return base, [symbols / seen, base[3] / max(1, len(lines)), base[4] / n, int(np.count_nonzero(ids[1:] == ids[:-1])) / n, seen / n, capitals / max(1, letters), digits / seen, marks / seen, alone / n, n / max(1, len(lines)), float(np.log1p(len(words)))]


STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, BASE and features of every row of docs (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics_of(t.as_py() or b"") for t in b.column(1).cast(pa.binary())]
            base = np.array([x for x, _ in found], np.int64).reshape(-1, len(BASE))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES))
            flat = np.array([x for _, x in found], np.float64).ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, base.T), pa.ListArray.from_arrays(ends, flat)], ["doc_id", *BASE, "features"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, STATISTICS)


class Trees:
    """Boosted trees as flat arrays: feature, threshold, left, right and value of each node; a leaf leads to itself.

    A row goes left where its feature is at most the threshold. `roots` are the trees' first nodes.
    """

    def __init__(self, start: float = 0.0):
        self.start, self.roots, self.nodes = start, [], []

    def add(self, feature: int = 0, threshold: float = 0.0) -> int:
        """A leaf of value 0, until it is split."""
        self.nodes.append([feature, threshold, len(self.nodes), len(self.nodes), 0.0])
        return len(self.nodes) - 1

    def to_bytes(self) -> bytes:
        return np.concatenate(([self.start, len(self.roots)], self.roots, np.array(self.nodes).ravel())).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Trees:
        flat = np.frombuffer(raw)
        out, n = cls(float(flat[0])), int(flat[1])
        out.roots, out.nodes = flat[2 : 2 + n].astype(np.int64), flat[2 + n :].reshape(-1, 5)
        return out

    def probability(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Of label 1, for each row of x: all trees of all rows go down a level at a time."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        nodes = np.asarray(self.nodes, np.float64)
        feature, left, right = (nodes[:, i].astype(np.int64) for i in (0, 2, 3))
        at, rows = np.tile(np.asarray(self.roots, np.int64), (len(x), 1)), np.arange(len(x))[:, None]
        for _ in range(depth):
            at = np.where(x[rows, feature[at]] <= nodes[at, 1], left[at], right[at])
        return 1 / (1 + np.exp(-(self.start + nodes[at, 4].sum(axis=1))))


def _best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, low: float, high: float, directions: np.ndarray, bins: int):
    """gain, feature, bin, and the children's values within [low, high], of the split that gains most; None if none does."""
    n = binned.shape[1]
    places = (binned[rows] + np.arange(n) * bins).ravel()
    sums = [np.bincount(places, np.repeat(v[rows], n), n * bins).reshape(n, bins).cumsum(axis=1) for v in (g, h)]
    (gl, hl), (ga, ha) = sums, (float(g[rows].sum()), float(h[rows].sum()))
    gr, hr = ga - gl, ha - hl
    left, right = (np.clip(-a / (b + L2), low, high) for a, b in ((gl, hl), (gr, hr)))

    def cost(a, b, value):
        return a * value + 0.5 * (b + L2) * value * value

    gain = cost(ga, ha, np.clip(-ga / (ha + L2), low, high)) - cost(gl, hl, left) - cost(gr, hr, right)
    good = (hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT) & ((right - left) * directions[:, None] >= 0)
    gain = np.where(good, gain, 0.0)
    best = int(gain.argmax())
    if gain.flat[best] <= 1e-9:
        return None
    return best // bins, best % bins, float(left.flat[best]), float(right.flat[best])


def fit(x: np.ndarray, y: np.ndarray, directions: np.ndarray = DIRECTIONS, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Trees for the logistic loss of y in {0, 1} over rows x, by histograms of at most so many quantiles a feature.

    Monotonic constraints: a split on a constrained feature has to order its children's values, and each child's subtree stays on its
    side of their middle; so along such a feature, all else equal, the score never moves against its direction.
    """
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    model = Trees(float(np.log(share / (1 - share))))
    if not len(y):
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = model.add()
        model.roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, float(-g.sum() / (h.sum() + L2)), 0)]
        while todo:
            node, rows, low, high, value, level = todo.pop()
            split = _best_split(binned, g, h, rows, low, high, directions, bins) if level < depth else None
            if split is None or split[1] >= len(cuts[split[0]]):
                model.nodes[node][4] = rate * value
                margin[rows] += rate * value
                continue
            feature, at, left, right = split
            children = model.add(), model.add()
            model.nodes[node] = [feature, float(cuts[feature][at]), *children, 0.0]
            goes, middle = binned[rows, feature] <= at, (left + right) / 2
            bounds = {-1: ((middle, high), (low, middle)), 0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}[int(directions[feature])]
            todo += [(c, rows[m], *b, v, level + 1) for c, m, b, v in zip(children, (goes, ~goes), bounds, (left, right))]
    return model


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> bytes:
    """Trees from a bounded sample of labelled rows that aren't held out, learned in one task in an order that ids alone decide."""
    sample = sample_of(labels, label, rows)
    own = stats.select(F.col("doc_id").alias("__id"), "features").join(F.broadcast(sample), "__id")  # no more rows than `rows`
    one = one_each(own.select(F.col("__id").alias("key"), F.col("__label").alias("label"), "features"), "label", "features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for b in batches:
            x += b.column(2).to_pylist()
            y += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(np.array(x, np.float64).reshape(-1, len(FEATURES)), np.array(y)).to_bytes()], pa.binary())], ["trees"])

    found = one.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key").mapInArrow(learn, "trees binary").first()
    return bytes(found[0]) if found else Trees().to_bytes()


def judged(stats: DataFrame, trees: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, BASE, base_failed, kept and score of rows of statistics."""
    model: Broadcast = stats.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trees.from_bytes(model.value)
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, len(FEATURES))
            words, repeats = (b.column(1 + BASE.index(c)).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)
            score = own.probability(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double")


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for every row of docs (doc_id, text).

    A document stays if it has LEAST_WORDS words, at most MOST_REPEATED of a hundred in repeated windows, and a probability of being good,
    by trees over statistics of its text, of `threshold` at least. Texts are read once; their statistics are written.

    Nulls: a null text counts as empty and fails for its words; labels or ids that are null are not learned from. Rows that repeat a doc_id are
    judged each by its text. Of an id with several labels the least counts. Without labelled rows the plain rules decide alone. An empty table gives an
    empty result; texts of any length are counted whole; other columns play no part.
    """
    stats = written(statistics(docs), "statistics")
    return judged(stats, train(stats, labels), threshold)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
