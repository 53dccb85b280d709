"""SimHash near-dedup: tiled exact comparison of fingerprints by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import hot_join, partitions, read_table, spread, written
from .components import components

SEED, WORDS, RADIUS = 42, 3, 2
#: Fingerprints fall into three blocks, first bit and width. Two that differ in 2 bits agree in one whole block.
THIRDS = [(0, 21), (21, 21), (42, 22)]
#: How many fingerprints a bin is to hold on average: so many tiles that those of far bit counts can be skipped.
BIN = 2048
#: Or into four blocks of 16 bits. Two that differ in 2 bits agree in two whole blocks.
BLOCK_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: Bins of more fingerprints are dealt out anew, by finer blocks.
HOT_BIN = 20_000
#: Rows of a tile, tiles that are compared with themselves in one step, links that are held before they become a forest.
TILE, TILES, LINKS = 256, 32, 1 << 20


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash, unsigned, of a UTF-8 text; 0 for a text without words."""
    found = text.lower().split()  # of bytes: A to Z only, and white space as in the contracts
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(found) - n :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], stops[i : i + (1 << 15)])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        # Sums of up to 255 rows fit a byte; that is much faster than adding into longs.
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        marks = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long. A null text counts as empty."""
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, an index each, after joining the classes of a and b: the smallest index of each class."""
    while True:
        least = np.minimum(labels[a], labels[b])
        new = labels.copy()
        for ends in (a, b):
            np.minimum.at(new, ends, least)
            np.minimum.at(new, labels[ends], least)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= RADIUS


def link_bins(bins: np.ndarray, marks: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Links of a spanning forest of what is within RADIUS in the tiles; how many tile pairs were compared and skipped.

    bins: runs of equal numbers; marks: fingerprints, in ascending order of bit counts within a bin. The
    rows are cut into tiles, whatever bins they are of; each is compared with itself. Where a bin goes
    on, its rows in a tile are compared with those in the tiles that follow, until one's least bit count is
    above their largest by more than RADIUS: that one and the bin's rest are skipped. What is within
    RADIUS is a link in any case, also between rows of different bins that a tile happens to hold.
    """
    n, counts = len(marks), np.bitwise_count(marks).astype(np.int16)
    labels, held, n_held = np.arange(n), [], 0
    compared = skipped = 0

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal labels, held, n_held
        held.append((a, b))
        n_held += len(a)
        if n_held > LINKS:
            labels, held, n_held = _forest(labels, *map(np.concatenate, zip(*held))), [], 0

    for start in range(0, n, tile * TILES):
        rows = marks[start : start + tile * TILES]
        whole = len(rows) // tile
        for first, block in ((start, rows[: whole * tile].reshape(whole, tile)), (start + whole * tile, rows[None, whole * tile :])):
            if block.size:
                t, a, b = np.nonzero(_near(block[:, :, None], block[:, None, :]))
                later = a < b
                at = first + t[later] * block.shape[1]
                link(at + a[later], at + b[later])
                compared += len(block)
    for end in range(tile, n, tile):
        own = bins[end - 1]
        if bins[end] != own:
            continue
        start = max(end - tile, int(np.searchsorted(bins, own)))
        stop = int(np.searchsorted(bins, own, side="right"))
        for i in range(end, stop, tile):
            if counts[i] - counts[end - 1] > RADIUS:
                skipped += -(-(stop - i) // tile)
                break
            a, b = np.nonzero(_near(marks[start:end, None], marks[None, i : min(i + tile, stop)]))
            link(start + a, i + b)
            compared += 1
    if held:
        labels = _forest(labels, *map(np.concatenate, zip(*held)))
    tied = np.flatnonzero(labels != np.arange(n))
    return marks[tied], marks[labels[tied]], compared, skipped


def _link_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole bins at a time; a bin that a batch leaves unfinished waits for the next one."""
    bins, marks, numbers = [], [], {}
    last, number = None, -1

    def done(bins: list, marks: list) -> pa.RecordBatch:
        a, b, _, _ = link_bins(np.concatenate(bins), np.concatenate(marks))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        new = np.concatenate(([True if last is None else bool((keys[:, 0] != last).any())], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        own = number + np.cumsum(new)
        last, number = keys[:, -1], int(own[-1])
        mark = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cut = int(np.searchsorted(own, number))  # what comes before the last bin is complete
        if cut or (len(own) and bins and own[0] != bins[-1][-1]):
            yield done([*bins, own[:cut]], [*marks, mark[:cut]])
            bins, marks = [], []
        bins.append(own[cut:])
        marks.append(mark[cut:])
    if bins:
        yield done(bins, marks)


def _block(width: int, i: int):
    return F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))


def _by(keys: list) -> Column:
    """A row for each of these (t, k)."""
    return F.explode(F.array(*[F.struct(t.cast("long").alias("t"), k.cast("long").alias("k")) for t, k in keys])).alias("x")


def _apart(bins: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Bins of up to HOT_BIN; the others, if there are any."""
    hot = bins.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BIN).select("t", "k")
    hot = written(hot, "hot-bins")
    return (bins, None) if hot.isEmpty() else (bins.join(hot, ["t", "k"], "left_anti"), bins.join(hot, ["t", "k"], "left_semi"))


def bins_of(marks: DataFrame) -> DataFrame:
    """t, k, fp: the bins (t, k) of distinct fingerprints, in one of which any two within RADIUS meet.

    Every fingerprint goes to three bins, each by a hash of one of its three blocks, of about BIN fingerprints;
    where all fit one bin, to that. A bin of over HOT_BIN (blocks that many share) is dealt anew to six bins, one for each
    two of its four blocks; and those of over HOT_BIN in the same way by what is left of the fingerprint: then 48 bits
    are equal, so that no bin can hold more than 65,536, however many documents there are.
    """
    n = marks.count() // BIN
    thirds = [(F.lit(i), F.pmod(F.xxhash64(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))), F.lit(n))) for i, (at, width) in enumerate(THIRDS)]
    bins, hot = _apart(marks.select("fp", _by(thirds if n > 1 else [(F.lit(0), F.lit(0))])).select("x.t", "x.k", "fp"))
    if hot is None:
        return bins
    six = [(F.lit(3 + i), F.shiftleft(_block(16, p), 16) + _block(16, q)) for i, (p, q) in enumerate(BLOCK_PAIRS)]
    more, hot = _apart(hot.select("fp").distinct().select("fp", _by(six)).select("x.t", "x.k", "fp"))
    bins = bins.unionByName(more)
    if hot is None:
        return bins
    rest = F.lit(None)
    for i, (p, q) in enumerate(BLOCK_PAIRS):
        r, s = (x for x in range(4) if x not in (p, q))
        rest = F.when(F.col("t") == 3 + i, F.shiftleft(_block(16, r), 16) + _block(16, s)).otherwise(rest)
    part = [F.shiftrightunsigned("rest", 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    again = [(9 + 6 * F.col("t") + i, F.shiftleft("k", 16) + F.shiftleft(part[p], 8) + part[q]) for i, (p, q) in enumerate(BLOCK_PAIRS)]
    return bins.unionByName(hot.withColumn("rest", rest).select("fp", _by(again)).select("x.t", "x.k", "fp"))


def link_fingerprints(marks: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within RADIUS: the bins' tiles, compared."""
    dealt = bins_of(marks).repartition(partitions(marks.sparkSession), "t", "k").sortWithinPartitions("t", "k", F.bit_count("fp"), "fp")
    return dealt.mapInArrow(_link_partition, "a long, b long")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, group_size for every row of docs (doc_id, text).

    Texts are lower-cased (A to Z), cut into words and into shingles of three; fingerprints that
    differ in two bits or fewer are linked, and component_id is the smallest doc_id of all that
    links lead to. Equal fingerprints are one node from the start, so copies make no pairs.

    Nulls and empty texts have fingerprint 0, linked like any other. A null doc_id is no
    candidate for component_id (null if its group has no other). Repeated rows are returned each.
    An empty table gives an empty result; other columns play no part.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    ties = components(link_fingerprints(nodes.select("fp")))
    named = ties.withColumnRenamed("u", "fp").withColumnRenamed("v", "root")
    of = nodes.join(named, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    of = of.select("fp", "n", "root").join(least, "root").select("fp", "n", "component_id", "group_size")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    out = hot_join(rows, of, ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near_classes stays, the one with the smallest doc_id; all columns stay.

    Rows that share a doc_id stay or go together. Null and empty texts are one group; rows without a doc_id stay if
    no row of their group has one. Columns may have any names; an empty table stays empty.
    """
    gone = near_classes(docs).groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())).alias("stays")).where("NOT stays")
    gone = gone.select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone"]), "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))
