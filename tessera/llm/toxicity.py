"""Toxicity by a classifier chain: each category's linear model also sees the earlier categories' probabilities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread, written
from .linear import Ftrl, sigmoid
from .quality import one_each, sample_of

BITS, EPOCHS, FOLDS = 18, 4, 4
#: Labelled rows to learn from, at most. This bounds training alone.
SAMPLE = 10_000
THRESHOLD = 0.5
ALPHA, L1, L2 = 1.0, 1.5, 0.1
#: Beginnings of words that count as features too, in letters.
STEMS = (3, 4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers the features of, beyond which it starts anew, and letters that they have at most.
REMEMBERED, LONG = 300_000, 64

#: The chain, in order: a category and, from the labels, whether a labelled row has it. `labels` marks toxic
#: and poor texts; a text that either mark finds fault with is flawed. Each is told more easily once the ones
#: before it are: a flawed text that isn't poor is toxic. None of them is known from the text itself.
CATEGORIES: tuple[tuple[str, Callable[[Column, Column], Column]], ...] = (
    ("flawed", lambda toxic, quality: (toxic > 0) | (F.coalesce(quality, F.lit(1.0)) < 1)),
    ("poor", lambda toxic, quality: F.coalesce(quality, F.lit(1.0)) < 1),
    ("toxic", lambda toxic, quality: toxic > 0),
)


class Words:
    """The hashed distinct words of a text and beginnings of words, each with 1 + log2 of how many distinct words have it."""

    def __init__(self, bits: int):
        self.shift, self.known = 32 - bits, {}

    def _of(self, word: str) -> list[int]:
        parts = [b"=" + word.encode()] + [b"^" + word[:n].encode() for n in STEMS if len(word) > n]
        return [((crc32(p) * 0x9E3779B1) & 0xFFFFFFFF) >> self.shift for p in parts]

    def __call__(self, text: str | None) -> np.ndarray:
        """A column of ids and a column of values for each feature, in order of ids."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for w in set(LETTERS.findall((text or "").lower())):
            ids = known.get(w)
            if ids is None:
                ids = self._of(w)
                if len(w) <= LONG:
                    known[w] = ids
            out += ids
        ids, counts = np.unique(np.array(out, np.int64), return_counts=True)
        return np.stack((ids.astype(np.float32), 1 + np.log2(counts).astype(np.float32)))


class _Link(Ftrl):
    """One link of the chain: a feature counts what Words says, however long the text is."""

    def __init__(self, bits: int, extra: int):
        super().__init__(bits, extra, alpha=ALPHA, l1=L1, l2=L2)

    def _row(self, row: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tail = (1 << self.bits) + np.arange(self.extra + 1)
        return np.concatenate((row[0].astype(np.int64), tail)), np.concatenate((row[1], dense, [1.0]))


def _fit(rows: Sequence[np.ndarray], labels: np.ndarray, dense: np.ndarray, bits: int, epochs: int) -> np.ndarray:
    model = _Link(bits, dense.shape[1])
    for _ in range(epochs):
        for x, y, d in zip(rows, labels, dense):
            model.update(x, y, d)
    return model.weights


def _probability(weights: np.ndarray, bits: int, row: np.ndarray, dense: np.ndarray) -> float:
    tail = weights[1 << bits :].astype(np.float64)
    return float(sigmoid(weights[row[0].astype(np.int64)].astype(np.float64) @ row[1] + tail[:-1] @ dense + tail[-1]))


def fit_part(rows: Sequence[np.ndarray], labels: np.ndarray, seen: np.ndarray, folds: np.ndarray, fold: int | None, bits: int, epochs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A link's weights from all rows but those of a fold; which rows these are, and their probabilities."""
    own = folds == fold if fold is not None else np.zeros(len(rows), bool)
    rest, own = np.flatnonzero(~own), np.flatnonzero(own)
    w = _fit([rows[i] for i in rest], labels[rest], seen[rest], bits, epochs)
    return w, own, np.array([_probability(w, bits, rows[i], seen[i]) for i in own])


def fit_chain(rows: Sequence[np.ndarray], labels: np.ndarray, folds: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> list[np.ndarray]:
    """Weights for each column of labels (rows x categories), fitted in this process.

    What later models learn from are probabilities for rows that the model that gave them hadn't
    seen: it was fitted on the other folds. The weights returned are fitted on all rows.
    """
    seen, chain = np.zeros((len(rows), 0)), []
    for k in range(labels.shape[1]):
        chain.append(fit_part(rows, labels[:, k], seen, folds, None, bits, epochs)[0])
        out = np.zeros(len(rows))
        if k + 1 < labels.shape[1]:
            for fold in np.unique(folds):
                _, own, p = fit_part(rows, labels[:, k], seen, folds, fold, bits, epochs)
                out[own] = p
        seen = np.column_stack((seen, out))
    return chain


def chain_sample(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, label: str = "toxic", bits: int = BITS, rows: int = SAMPLE) -> DataFrame:
    """key, marks, ids: a bounded sample of labelled ids, one row of each, with the categories' labels and the text's features."""
    sample = sample_of(labels, label, rows, "quality")
    own = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(sample), "__id")
    marks = F.array(*[f(F.col("__label"), F.col("__quality")).cast("double") for _, f in categories])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Words(bits)
        for b in batches:
            ids = [words_of(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["key", "marks", "ids"])

    dealt = own.select("__id", marks.alias("marks"), "__text").mapInArrow(hashed, "key long, marks array<double>, ids binary")
    return one_each(dealt, "marks", "ids")


def train_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, label: str = "toxic", bits: int = BITS, rows: int = SAMPLE, epochs: int = EPOCHS) -> list[np.ndarray]:
    """The chain's weights, as fit_chain gives them for chain_sample in an order that ids decide; none without labelled rows.

    The sample is written once. A link's fits, one on all rows and one without each fold, don't need each
    other: each is a task that reads the sample. The driver gets the weights, and a probability for each sampled row.
    """
    sample = written(chain_sample(docs, labels, categories, label, bits, rows), "chain-sample")
    whole = sample.coalesce(1).sortWithinPartitions(F.xxhash64("key"), "key", "ids")

    def fit(k: int, fold: int | None, before: np.ndarray | None) -> DataFrame:
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, marks, ids = [], [], []
            for b in batches:
                keys += b.column(0).to_pylist()
                marks += [m[k] for m in b.column(1).to_pylist()]
                ids += [np.frombuffer(x, np.float32).reshape(2, -1) for x in b.column(2).to_pylist()]
            if keys:
                folds = np.array([crc32(str(x).encode()) // 5 % FOLDS for x in keys], int)
                seen = np.zeros((len(keys), 0)) if before is None else before
                w, own, p = fit_part(ids, np.array(marks, float), seen, folds, fold, bits, epochs)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(keys)], pa.int32()), "weights": pa.array([w.tobytes() if fold is None else None], pa.binary()), "own": pa.array([own], pa.list_(pa.int32())), "p": pa.array([p], pa.list_(pa.float64()))})

        return whole.mapInArrow(learn, "n int, weights binary, own array<int>, p array<double>")

    chain, seen = [], None
    for k in range(len(categories)):
        folds = range(FOLDS) if k + 1 < len(categories) else []
        found = reduce(DataFrame.unionByName, [fit(k, fold, seen) for fold in (None, *folds)]).collect()  # a row for each fit
        if not found:
            return []
        out = np.zeros(found[0].n)
        for r in found:
            out[r.own] = r.p
        chain += [np.frombuffer(bytes(r.weights), np.float32) for r in found if r.weights is not None]
        seen = out[:, None] if seen is None else np.column_stack((seen, out))
    return chain


def score_chain(docs: DataFrame, chain: list[np.ndarray], categories=CATEGORIES, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability p_<category> for each category, is_toxic (the last one's is over the threshold).

    Whole texts of docs (doc_id, text) are scored, one row for each. A null or empty text has no
    features: its probabilities follow from the constants. Null ids and repeated rows are kept. A chain
    that was fitted on no rows gives 0 throughout. An empty table gives an empty result; other columns play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{name}" for name, _ in categories]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Words(bits)
        for b in batches:
            out = np.zeros((b.num_rows, len(names)))
            for i, t in enumerate(b.column(1)):
                row = words_of(t.as_py())
                for k, w in enumerate(model.value):
                    out[i, k] = _probability(w, bits, row, out[i, :k])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[:, k]) for k in range(len(names))]], ["doc_id", *names])

    cols = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(scored, ", ".join(["doc_id long", *[f"{n} double" for n in names]]))
    return cols.withColumn("is_toxic", F.col(names[-1]) >= threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_chain(docs, train_chain(docs, labels))
