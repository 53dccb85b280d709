"""BM25 ranking over an inverted index kept as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted, terms

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of questions that are broadcast at most; beyond, postings of a term are dealt over so many tasks.
ASKED, SALTS = 200_000, 16
#: Questions that go to all tasks at a time, and what a task adds up at a time: parts of scores, and scores.
QUESTIONS, PARTS = 4096, 2_000_000
#: Entries beside terms; a term has no white space.
CHUNKS, TOKENS = " chunks", " tokens"


@dataclass
class Index:
    """postings (term, chunk_id, tf, dl), counts (term, df; and how many chunks and tokens there are), chunk_ids.

    `counts` may have several rows of a term, of additions that were made one after the other.
    """

    postings: DataFrame
    counts: DataFrame
    chunks: DataFrame
    #: What postings are made of, where they aren't read from files: chunk_id, dl, counts (value, n) of a chunk in its row.
    forward: DataFrame | None = None

    def __post_init__(self) -> None:
        """term_stats (term, df, idf), corpus (one row: n, avgdl, avg_idf).

        A term in more than half of all chunks has a negative raw idf; it gets EPSILON times the mean raw
        idf of all terms instead.
        """
        # That terms are terms is told after counting, so that all that reads the counts reads one exchange.
        df = self.counts.groupBy("term").agg(F.sum("df").alias("df"), F.max(_is_term()).alias("is_term"))
        one = {name: F.max(F.when(~F.col("is_term") & (F.col("term") == name), F.col("df"))) for name in (CHUNKS, TOKENS)}
        corpus = df.agg(F.coalesce(one[CHUNKS], F.lit(0)).alias("n"), (one[TOKENS] / one[CHUNKS]).alias("avgdl"))
        # The corpus is one row.
        raw = df.where("is_term").crossJoin(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw").alias("avg_idf"))
        stats = raw.select("term", "df", "raw").crossJoin(F.broadcast(mean))
        idf = F.when(F.col("raw") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("raw"))
        self.term_stats, self.corpus = stats.select("term", "df", idf.alias("idf")), corpus.crossJoin(mean)

    def persist(self) -> Index:
        """Keep chunks' counts of terms where they were counted, how many chunks have a term, and the terms' statistics."""
        if self.forward is not None:
            self.forward = self.forward.persist()
            self.postings, self.chunks = _postings(self.forward), self.forward.select("chunk_id")
            self.counts = _counts(self.forward, F.transform("counts", lambda c: c["value"]))
        else:
            self.postings.persist()
        self.counts = self.counts.groupBy("term").agg(F.sum("df").alias("df")).persist()
        self.__post_init__()
        self.term_stats.persist()
        return self

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Postings lie in files sorted by term, so that a query's terms prune row groups. With mode "append", what is
        there stays: the chunks of this index are added, at the cost of their own postings."""
        self.postings.repartition("term").sortWithinPartitions("term", "chunk_id").write.mode(mode).parquet(f"{path}/postings")
        self.counts.groupBy("term").agg(F.sum("df").alias("df")).write.mode(mode).parquet(f"{path}/counts")
        self.chunks.select("chunk_id").write.mode(mode).parquet(f"{path}/chunks")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "counts", "chunks")])


def _is_term() -> Column:
    return ~F.col("term").isin(CHUNKS, TOKENS)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _postings(forward: DataFrame) -> DataFrame:
    rows = forward.select("chunk_id", "dl", F.explode("counts").alias("c"))
    return rows.select(F.col("c.value").alias("term"), "chunk_id", "dl", F.col("c.n").cast("long").alias("tf"))


def _counts(rows: DataFrame, terms_of: Column) -> DataFrame:
    """term, df of rows (dl, and a chunk's distinct terms). Two more entries a chunk, that no term can be, so that one pass counts chunks and tokens as well."""
    one = F.lit(1).cast("long")
    own = [F.struct(F.lit(name).alias("term"), n.cast("long").alias("df")) for name, n in ((CHUNKS, one), (TOKENS, F.col("dl")))]
    return rows.select(F.explode(F.concat(F.array(*own), F.transform(terms_of, lambda t: F.struct(t.alias("term"), one.alias("df"))))).alias("c")).select("c.term", "c.df")


def fit(chunks: DataFrame) -> Index:
    """The index of chunks (chunk_id, text). A chunk's terms are counted in its row; all that is shuffled are
    partial counts of chunks by term."""
    words = chunks.select("chunk_id", terms(F.col("text")).alias("t")).select("chunk_id", "t", F.size("t").alias("dl"))
    forward = words.select("chunk_id", "dl", counted(F.col("t")).alias("counts"))
    # Which terms a chunk has is cheaper to tell than how often; nothing else is needed to count chunks by term.
    return Index(_postings(forward), _counts(words, F.array_distinct("t")), chunks.select("chunk_id"), forward)


def search(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, chunk_id, score, rank: each query's (query_id, query) k best chunks, ties (nine decimals) to the smaller id.

    Terms count as often as the query has them. Chunks without any of its terms have score 0 and fill
    up what is missing to k; for that the 2k smallest ids are enough, as fewer than k of them can be
    hits of a query that needs more. All queries are answered by one pass over their terms' postings.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = asked.join(index.term_stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    if asked.limit(ASKED + 1).count() <= ASKED:
        joined = index.postings.join(F.broadcast(weighed), "term")
    else:
        salted = index.postings.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))
        joined = salted.join(weighed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["term", "salt"]).drop("salt")
    hits = joined.crossJoin(F.broadcast(index.corpus.select("avgdl")))
    tf = F.col("tf")
    part = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    some = index.chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k)
    # They add nothing to the score of a hit, so hits need not be told apart from them.
    fill = queries.select("query_id").crossJoin(F.broadcast(some)).withColumn("part", F.lit(0.0))
    fill = fill if index.forward is None else fill.repartition(_partitions(fill), "chunk_id")
    scored = hits.select("query_id", "chunk_id", part.alias("part")).unionByName(fill).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", "rank")


def search_many(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """As `search`, for many questions against many chunks.

    There nearly every chunk has some word of nearly every question, and rows of (question, chunk, term) grow with the product of both. Here a
    chunk's counts of terms are a row, and a task adds up its chunks' scores in matrices and keeps k chunks a question. Questions go
    to all tasks QUESTIONS at a time, or fewer if they have more than ASKED terms.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = asked.join(index.term_stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")).crossJoin(F.broadcast(index.corpus.select("avgdl")))
    n, pairs = queries.count(), weighed.persist().count()
    blocks = max(1, -(-n // QUESTIONS), -(-pairs // ASKED))
    # They add nothing to the score of a hit; that of those among them that are hits is told by the tasks.
    always = [r.chunk_id for r in index.chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k).collect()]
    found = []
    for i in range(blocks):
        own = weighed if blocks == 1 else weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found.append(_scored(index, own, always, k, queries.schema["query_id"].dataType.simpleString()))
    some = F.explode(F.array(*map(F.lit, always)).cast("array<string>")).alias("chunk_id")
    fill = queries.select("query_id", some, F.lit(None).cast("double").alias("score"))
    scored = reduce(DataFrame.unionByName, found).unionByName(fill).groupBy("query_id", "chunk_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def _scored(index: Index, weighed: DataFrame, always: list[str], k: int, kind: str) -> DataFrame:
    """query_id, chunk_id, score: of each task a question's k best chunks, and its score for the chunks named by `always`."""
    if index.forward is not None:
        rows = index.forward.select("chunk_id", "dl", "counts")
    else:
        own = index.postings.join(F.broadcast(weighed.select("term").distinct()), "term", "left_semi")
        rows = own.groupBy("chunk_id", "dl").agg(F.collect_list(F.struct(F.col("term").alias("value"), F.col("tf").alias("n"))).alias("counts"))
    table = weighed.toArrow().combine_chunks()  # some questions' terms
    names, words = (table[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    by_term = np.argsort(words.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(words.indices.to_numpy()[by_term], np.arange(len(words.dictionary) + 1))
    avgdl = table["avgdl"][0].as_py() if len(table) else 1.0
    shared = weighed.sparkSession.sparkContext.broadcast((names.dictionary, words.dictionary, starts, names.indices.to_numpy()[by_term], table["w"].to_numpy()[by_term], avgdl, np.array(sorted(always), object)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, starts, query, weight, avgdl, always = shared.value
        n = len(names)
        best = _Best(n, k)
        for b in batches:
            if not b.num_rows or not n:
                continue
            ids, counts = np.array(b.column(0).to_pylist(), object), b.column(2)
            flat = counts.flatten()
            at = pc.index_in(flat.field("value"), value_set=words)
            row = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            term, row, tf = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[hit], row[hit], flat.field("n").to_numpy(zero_copy_only=False)[hit].astype(float)
            dl = b.column(1).to_numpy(zero_copy_only=False).astype(float)[row]
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            width = starts[term + 1] - starts[term]
            # So many chunks at a time that neither their parts nor their scores are more than PARTS, if one chunk's aren't.
            load = np.bincount(row, width, len(ids)) + n
            group = (np.cumsum(load) // PARTS).astype(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(ids)]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                a, z = np.searchsorted(row, [lo, hi])
                w = width[a:z]
                ends = np.cumsum(w)
                place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[term[a:z]] - (ends - w), w)
                scores = np.bincount(query[place] * (hi - lo) + np.repeat(row[a:z] - lo, w), weight[place] * np.repeat(part[a:z], w), n * (hi - lo)).reshape(n, hi - lo)
                best.add(ids[lo:hi], scores)
                for c in np.flatnonzero(np.isin(ids[lo:hi], always)):
                    q = np.flatnonzero(scores[:, c])
                    yield _rows(names, q, np.repeat(ids[lo + c : lo + c + 1], len(q)), scores[q, c])
        yield _rows(names, *best.rows())

    return rows.mapInArrow(run, f"query_id {kind}, chunk_id string, score double")


def _rows(names: pa.Array, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([names.take(pa.array(query, pa.int64())), pa.array(ids, pa.string()), pa.array(scores, pa.float64())], ["query_id", "chunk_id", "score"])


class _Best:
    """The k best chunks of each question among those added so far, by (score at nine decimals, smaller id)."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(scores != 0, scores, -np.inf)
        if scores.shape[1] > self.k:
            self.least = np.maximum(self.least, np.round(np.partition(scores, -self.k, axis=1)[:, -self.k], 9))
        query, column = np.nonzero((scores > self.least[:, None] - 1e-8) & (scores > -np.inf))
        if not len(query):
            return
        query, ids, scores = np.concatenate((self.query, query)), np.concatenate((self.ids, ids[column])), np.concatenate((self.scores, scores[query, column]))
        rounded = np.round(scores, 9)
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -rounded, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = query[place == self.k - 1]
        self.least[last] = rounded[order][place == self.k - 1]
        kept = place < self.k
        self.query, self.ids, self.scores = query[kept], ids[order][kept], scores[order][kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.query, self.ids, self.scores
