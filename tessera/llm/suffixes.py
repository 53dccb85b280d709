"""Removal of repeated byte strings by a distributed merge sort of front-coded suffix runs."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import hot_join, partitions, read_table, spread, written

LENGTH = 200
#: Bytes of an anchor; a string of LENGTH bytes has WINDOW places for one.
ANCHOR = 40
#: Strings that share an anchor with over so many others are cut into slices, the narrower the more there are.
HOT_ANCHOR = 5_000
#: Bytes scanned at a time, and suffixes in a run.
SEGMENT, RUN = 1 << 20, 30_000
#: Units in a part, on average: a part's runs are what one merge holds in memory.
PART = 20_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
RUN_KIND = "part int, lcp binary, size binary, tail binary, left_size binary, left binary, low binary, high binary, times binary, keys binary, at binary, key long, start long, stop long"


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes at every place of raw (uint8)."""
    n = len(raw) - ANCHOR + 1
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw).data, strides=(1,))
    h = words[:n] * MULTIPLIERS[0]
    for i in range(1, ANCHOR // 8):
        h += words[8 * i : 8 * i + n] * MULTIPLIERS[i]
        h ^= h >> np.uint64(29)
        h *= MULTIPLIERS[0]
    return h ^ (h >> np.uint64(32))


def units(raw: np.ndarray, stop: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor's place, anchor's hash, first and last string, for every run of strings that share an anchor.

    raw: bytes of texts end to end; stop: for each byte, where its text ends. A string is `length` bytes of
    one text, known by its place. Its anchor is the ANCHOR bytes in it with the least hash, the
    leftmost of such; so equal strings have equal anchors at equal distances.
    """
    out = []
    window = length - ANCHOR + 1
    for begin in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = raw[begin : begin + SEGMENT + length - 1]
        n = len(part) - length + 1
        h = anchor_hashes(part)
        low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < window:
            low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
        at = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.arange(n)
        valid = place + begin + length <= stop[begin : begin + n]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (stop[begin + 1 : begin + n] != stop[begin : begin + n - 1])))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [n - 1]))
        keep = valid[first]
        first, last = first[keep], last[keep]
        out.append((begin + at[first], h[at[first]].view(np.int64), begin + first, begin + last))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, np.repeat(ends, sizes)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SEGMENT bytes together."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > SEGMENT:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def _anchors(length: int):
    """g, key, unit for each unit: the anchor's hash, the text's key, and (place << 16 | reach back << 8 | least reach back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for i, j in _groups(texts):
                raw, start, stop = _joined(texts[i:j])
                at, g, first, last = units(raw, stop, length)
                own = np.searchsorted(start, first, side="right") - 1
                # Empty texts share their start with the next one; the last of them is the one with bytes.
                packed = (at - start[own]) << 16 | (at - first) << 8 | (at - last)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(keys[i + own]), pa.array(packed)], ["g", "key", "unit"])

    return run


def _lcp(a: bytes, b: bytes, at: int) -> int:
    """How far a and b agree, known to agree up to `at`."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    at = min(at, n)
    while at < n and a[at] == b[at]:
        at += 1
    return at


def joined_spans(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same places of the same keys by as few spans as possible."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    text = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    upto = np.maximum.accumulate(stop + (text << 40)) - (text << 40)
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] > upto[:-1]))))
    return key[first], start[first], np.maximum.reduceat(stop, first)


def _coded(part: int, items: list[tuple]) -> dict:
    """A front-coded run of sorted, distinct (string, left, low, high), each with its places if it has one only."""
    lcp, tails, before = [], [], b""
    for string, *_ in items:
        n = _lcp(string, before, 0)
        lcp.append(n)
        tails.append(string[n:])
        before = string
    places = [p for *_, own in items if len(own) == 1 for p in own]
    return {
        "part": part, "lcp": np.array(lcp, "<u2").tobytes(), "size": np.array([len(t) for t in tails], "<u2").tobytes(), "tail": b"".join(tails),
        "left_size": np.array([len(x[1]) for x in items], "<u2").tobytes(), "left": b"".join(x[1] for x in items),
        "low": np.array([x[2] for x in items], np.uint8).tobytes(), "high": np.array([x[3] for x in items], np.uint8).tobytes(), "times": np.array([min(2, len(x[4])) for x in items], np.uint8).tobytes(),
        "keys": np.array([k for k, _ in places], "<i8").tobytes(), "at": np.array([a for _, a in places], "<i8").tobytes(),
    }


def _runs(parts: int, length: int):
    """Sorted runs of the candidate units' suffixes, by part; and what is repeated within a run already, as (key, start, stop)."""
    names = [x.split()[0] for x in RUN_KIND.split(", ")]
    schema = pa.schema([(n, pa.int32() if n == "part" else pa.int64() if n in ("key", "start", "stop") else pa.binary()) for n in names])

    def flush(items: dict) -> Iterator[pa.RecordBatch]:
        inside, by_part = [], {}
        for (string, left, low, high), own in items.items():
            by_part.setdefault(int.from_bytes(string[:8], "big") % parts, []).append((string, left, low, high, own))
            if len(own) > 1:
                inside += [(k, a - high, a - low + length) for k, a in own]
        rows = [_coded(p, sorted(own, key=lambda x: x[:4])) for p, own in sorted(by_part.items())]
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 2000], schema)
        if inside:
            key, start, stop = joined_spans(*np.array(inside, np.int64).T)
            part = (key.astype(np.uint64) * MULTIPLIERS[0] >> np.uint64(32)) % np.uint64(parts)
            found = {"part": pa.array(part.astype(np.int32)), "key": pa.array(key), "start": pa.array(start), "stop": pa.array(stop)}
            yield pa.RecordBatch.from_arrays([found.get(n, pa.nulls(len(key), schema.field(n).type)) for n in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[tuple, list] = {}
        held = 0
        for b in batches:
            for key, text, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if not found.is_valid:
                    continue
                t = text.as_py()
                for u in sorted(set(found.as_py())):
                    width, a, high, low = u >> 56, u >> 16 & 0xFFFFFFFFFF, u >> 8 & 255, u & 255
                    step = 1 << width
                    for x in range(low - low % step, high + 1, step):
                        lo, hi = max(low, x), min(high, x + step - 1)
                        # What all strings of the slice share, whichever of them a text has.
                        core = t[a : a + ANCHOR] if step > 255 else t[a - x : a - x - step + 1 + length] + bytes([x])
                        string = xxh3_64_intdigest(core).to_bytes(8, "big") + t[a : a - lo + length]
                        items.setdefault((string, t[a - hi : a], lo, hi), []).append((key, a))
                        held += 1
            if held >= RUN:
                yield from flush(items)
                items, held = {}, 0
        if items:
            yield from flush(items)

    return run


class _Run:
    """The strings of a front-coded run, one after the other, with how far each agrees with the one before."""

    def __init__(self, row: dict):
        self.lcp = np.frombuffer(row["lcp"], "<u2").tolist()
        self.sizes = np.frombuffer(row["size"], "<u2").tolist()
        self.tail, self.i, self.at, self.string = row["tail"], -1, 0, b""

    def next(self) -> bool:
        self.i += 1
        if self.i >= len(self.lcp):
            return False
        end = self.at + self.sizes[self.i]
        self.string = self.string[: self.lcp[self.i]] + self.tail[self.at : end]
        self.at = end
        return True


def merged(runs: list[_Run]) -> Iterator[tuple[int, int, int]]:
    """Run, place in it and agreement with the one before, for all strings in order: a loser tree over front-coded runs.

    Every waiting string knows how far it agrees with the last one that came out. Of two, the one
    that agrees further is smaller, without a look at any byte; only if both agree equally far are bytes
    compared, from there on. Then the loser knows how far it agrees with the winner. A run's next
    string knows its agreement with the winner from the front coding.
    """
    k = 1
    while k < len(runs):
        k *= 2
    agree = [0] * k
    strings: list[bytes | None] = [None] * k
    for i, r in enumerate(runs):
        if r.next():
            strings[i] = r.string

    def first(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two leaves."""
        a, b = strings[i], strings[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if agree[i] != agree[j]:
            return (i, j) if agree[i] > agree[j] else (j, i)
        n = _lcp(a, b, agree[i])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            agree[j] = n
            return i, j
        agree[i] = n
        return j, i

    loser = [0] * k
    winner = list(range(k))
    size = k
    while size > 1:
        for p in range(size // 2):
            winner[p], loser[size // 2 + p] = first(winner[2 * p], winner[2 * p + 1])
        size //= 2
    top = winner[0]
    while strings[top] is not None:
        run = runs[top]
        yield top, run.i, agree[top]
        if run.next():
            strings[top], agree[top] = run.string, run.lcp[run.i]
        else:
            strings[top] = None
        node = (top + k) // 2
        while node:
            top, loser[node] = first(top, loser[node])
            node //= 2


def repeated(group: np.ndarray, agree: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray, times: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """For every reach back o, the items whose string from o before the anchor occurs again.

    Items are sorted by group and right context; agree: how far each one's agrees with the one
    before. Two strings are equal if the o bytes left of the anchors are, and the length - o bytes from
    there. Classes of equal left parts are refined byte by byte; classes of equal right parts are
    stretches of the sorted order without an agreement of less than that.
    """
    n = len(group)
    reach = int(high.max(initial=0))
    back = np.full((n, reach + 1), 256, np.int16)
    for i, x in enumerate(lefts):
        back[i, 1 : len(x) + 1] = np.frombuffer(x, np.uint8)[::-1]
    left = np.concatenate(([0], np.cumsum(group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    alive = np.arange(n)
    for o in range(reach + 1):
        alive = alive[high[alive] >= o]
        if o:
            refined = left[alive] * 257 + back[alive, o]
            _, left_of, count = np.unique(refined, return_inverse=True, return_counts=True)
            left[alive] = left_of
            # An item without a partner on the left has none further back either, unless it counts twice itself.
            alive = alive[(count[left_of] > 1) | (times[alive] > 1)]
        if not len(alive):
            return
        own = alive[low[alive] <= o]
        right = np.cumsum(agree < length - o + 8)
        _, same, count = np.unique(left[own] * (n + 1) + right[own], return_inverse=True, return_counts=True)
        total = np.bincount(same, weights=times[own], minlength=len(count))
        yield own[total[same] > 1], o


def _merge(length: int):
    """Merge the runs of a part; give (key, start, stop) of what is repeated, for strings that stand alone in their run.

    What its run showed to be repeated is passed on.
    """

    def run(table: pa.Table) -> pa.Table:
        known = table["lcp"].is_null()
        inside = table.filter(known).select(["key", "start", "stop"])
        rows = table.filter(pc.invert(known)).to_pylist()
        return pa.concat_tables([inside, across(rows)]) if rows else inside

    def across(rows: list[dict]) -> pa.Table:
        runs = [_Run(r) for r in rows]
        order = list(merged(runs))
        n_of = np.cumsum([0] + [len(r.lcp) for r in runs])
        where = np.array([n_of[r] + i for r, i, _ in order], np.int64)
        agree = np.array([a for _, _, a in order], np.int64)

        def column(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[name], kind) for r in rows])

        low, high, times = (column(x, "u1")[where].astype(np.int64) for x in ("low", "high", "times"))
        lefts = [r["left"][e - s : e] for r in rows for s, e in zip(np.frombuffer(r["left_size"], "<u2").tolist(), np.cumsum(np.frombuffer(r["left_size"], "<u2").astype(np.int64)).tolist())]
        lefts = [lefts[i] for i in where.tolist()]
        group = np.cumsum(agree < 8)  # the first 8 bytes are the group's hash
        single = column("times", "u1") == 1
        place = np.full(len(single), -1, np.int64)
        place[single] = np.arange(np.count_nonzero(single))
        keys, at = column("keys", "<i8"), column("at", "<i8")
        found_key, found_start, found_stop = [], [], []
        opened = np.full(len(where), -1, np.int64)  # by item: the reach back at which its present stretch began
        last = np.full(len(where), -2, np.int64)

        def close(items: np.ndarray) -> None:
            p = place[where[items]]
            items, p = items[p >= 0], p[p >= 0]
            found_key.append(keys[p])
            found_start.append(at[p] - last[items])
            found_stop.append(at[p] - opened[items] + length)

        for items, o in repeated(group, agree, lefts, low, high, times, length):
            begin = items[last[items] != o - 1]
            close(begin[last[begin] >= 0])
            opened[begin] = o
            last[items] = o
        close(np.flatnonzero(last >= 0))
        none = [np.zeros(0, np.int64)]
        spans = joined_spans(*[np.concatenate(x or none) for x in (found_key, found_start, found_stop)])
        return pa.table(dict(zip(("key", "start", "stop"), spans)))

    return run


def _cut(b: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of b, and how many maximal runs are removed."""
    kept, at, n = [], 0, 0
    for start, stop in sorted(spans):
        if start > at or not n:
            kept.append(b[at:start])
            n += 1
        at = max(at, stop)
    kept.append(b[at:])
    return b"".join(kept), n


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            t = text.as_py() or b""
            left, n = _cut(t, [(s["start"], s["stop"]) for s in spans.as_py()]) if spans.is_valid else (t, 0)
            rows.append((doc_id, len(t), len(t) - len(left), n, sha256(left).hexdigest(), left))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for every row of docs (doc_id, text).

    Removed is each byte of a text that lies in a string of `length` bytes (ANCHOR to 255) which also starts at
    another place of any text. Strings don't cross texts and are judged on the input.

    1. Strings are gathered in units that share an anchor. Anchors that occur once in the whole corpus
       are left out: no string around them can occur twice.
    2. Each task sorts the suffixes at the remaining anchors and front-codes them; parts of the runs are
       exchanged by the hash of what equal strings must share, so that equal ones meet.
    3. A loser tree merges a part's runs, and the agreements between neighbours tell equal right sides.

    One text has its own strings in a few units, so nothing grows but with texts. Units of an anchor that
    n texts share are cut into slices of HOT_ANCHOR / n of their width, each dealt out by more bytes; and of
    strings that a run holds twice or more one goes on, without its places. So no part grows with a hot string.

    A null text counts as empty; texts shorter than `length` lose nothing. Null doc_ids are kept.
    Rows that repeat a doc_id and a text are texts of their own: each is another place for the other. An
    empty table gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    # Where ids tell texts apart they are the key; else rows are numbered, in a table so that their numbers stay.
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        keyed = ids.select(F.col("doc_id").alias("key"), "doc_id", "text")
    else:
        keyed = written(ids.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "numbered")
    anchors = written(spread(keyed.select("key", "text")).mapInArrow(_anchors(length), "g long, key long, unit long"), "anchors")
    shared = anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = anchors.count()
    parts = int(max(2 * partitions(spark), (shared.agg(F.sum("n")).first()[0] or 0) // PART))
    # Slices are 2^width bytes wide: a whole unit if few share the anchor, a byte if very many do.
    width = F.greatest(F.lit(0), 8 - F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / HOT_ANCHOR)))).cast("long")
    units_ = hot_join(anchors, shared, ["g"], "n", total).select("key", F.shiftleft(width, 56).bitwiseOR(F.col("unit")).alias("unit"))
    lists = units_.groupBy("key").agg(F.collect_list("unit").alias("units"))
    # The texts are dealt out by key once, for the units now and for what is removed in the end.
    dealt = keyed.repartition(partitions(spark), "key")
    with_units = dealt.join(lists, "key", "left").select("key", "text", "units", "doc_id")
    runs = with_units.mapInArrow(_runs(parts, length), RUN_KIND)
    spans = runs.groupBy("part").applyInArrow(_merge(length), "key long, start long, stop long")
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = dealt.join(spans, "key", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_finished, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
