"""Approximate nearest neighbours over balanced posting lists whose centroids are searched by a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, spread, written

#: One posting list for so many vectors; lists at most, and bytes that their centroids may take: tasks hold them all.
LIST_SIZE, MOST_LISTS, INDEX_BYTES = 256, 65_536, 64_000_000
#: Vectors that centroids are fitted on: so many a list, at least and at most, and bytes; all vectors are indexed.
SAMPLE_EACH, LEAST_SAMPLE, MOST_SAMPLE, SAMPLE_BYTES = 32, 2048, 262_144, 128_000_000
#: Vectors whose norms are within such a factor share a band; a band has lists of its own, if it has so many sampled vectors.
BAND, BAND_SAMPLE = 1.25, 32
#: A vector lies in up to REPLICAS lists: others than its nearest if at most 1 + MARGIN times as far, and if at
#: least APART times as far from the chosen ones as from the vector.
REPLICAS, MARGIN, APART = 3, 0.02, 0.5
#: Neighbours of a centroid in the graph, and how many candidates an assignment keeps.
DEGREE, BEAM = 16, 24
#: Recall at which the ratio that prunes lists is set, measured in the sample: over all neighbours, and of nearly every query.
AIM, EACH_AIM, K = 0.95, 0.9, 20
#: Lists that a query reads first, and of them whatever the ratio says; what they hold bounds what it looks for in the others.
NEAR, ALWAYS = 6, 2
#: So many centroids are compared with a vector by a matrix product, which is faster; beyond, the graph is walked.
DIRECT = 8192
#: Lists with so many entries, or bytes of vectors, lie in one block. Vectors and queries of a block that one task compares at a
#: time: a block of over twice as many entries is cut into such cells. Scores that it holds at a time.
BLOCK, BLOCK_BYTES, CELL_QUERIES, SCORES = 8192, 16_000_000, 4096, 1 << 21


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def _halves(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Which of k groups of like size each row falls in: cut again and again across the direction of most spread."""
    own, waiting, used = np.zeros(len(x), np.int64), [(np.arange(len(x)), k)], 1
    while waiting:
        rows, parts = waiting.pop()
        if parts < 2 or len(rows) < 2:
            continue
        part = x[rows] - x[rows].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(4):
            axis = part.T @ (part @ axis)
            axis /= max(np.linalg.norm(axis), 1e-30)
        order = rows[np.argsort(part @ axis, kind="stable")]
        left = parts // 2
        cut = len(order) * left // parts
        own[order[cut:]] = used
        waiting += [(order[:cut], left), (order[cut:], parts - left)]
        used += 1
    return own


def _balanced_centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centroids by k-means that begins with groups of like size and in which full clusters are dear.

    A cluster's distance grows with how far it is above the mean size. Rows are compared with all
    centroids while those are few, else with those near the group that halving puts them in.
    """
    rng = np.random.default_rng(7)
    own = _halves(x, k, rng)
    for _ in range(rounds):
        size = np.bincount(own, minlength=k).astype(float)
        total = np.zeros((k, x.shape[1]))
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
        tax = 1 + 0.2 * np.clip(size * k / len(x) - 1, -0.5, 2)
        near = None if k <= 2048 else np.concatenate([np.argpartition(_distances(c[i : i + 512], c), 32, axis=1)[:, :32] for i in range(0, k, 512)])
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            if near is None:
                own[i : i + 4096] = np.argmin(_distances(part, c) * tax, axis=1)
            else:
                some = near[own[i : i + 4096]]
                d = ((part * part).sum(1)[:, None] + (c * c).sum(1)[some] - 2 * np.einsum("ij,ikj->ik", part, c[some])) * tax[some]
                own[i : i + 4096] = np.take_along_axis(some, np.argmin(d, axis=1)[:, None], 1)[:, 0]
    return c.astype(np.float32)


@dataclass
class Centroids:
    """One band's centroids with the graph that is walked to find those near a vector.

    Vectors carry one more coordinate, the square root of reach^2 - norm^2, queries 0 there: then the
    nearest by distance are those of the largest inner product, whatever the norms.
    """

    points: np.ndarray
    links: np.ndarray
    entry: np.ndarray
    reach: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, reach: float) -> Centroids:
        x = lifted(sample, reach)
        points = _balanced_centroids(x, min(lists, len(x)))
        n, near = len(points), []
        for i in range(0, n, 1024):
            d = _distances(points[i : i + 1024], points)
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            near.append(np.argsort(d, axis=1)[:, : min(DEGREE, max(1, n - 1))])
        # A ring keeps the graph connected where nearest neighbours alone would leave islands.
        ring = np.stack(((np.arange(n) + 1) % n, (np.arange(n) - 1) % n), axis=1)
        spread_out = np.linspace(0, n - 1, min(n, 8)).astype(np.int64)
        return cls(points, np.concatenate((np.concatenate(near), ring), axis=1), spread_out, reach)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each row, nearest first, and their distances: best-first walks over the graph, all rows in step.

        A step looks at the neighbours of a few centroids of each row's beam, however many centroids there are.
        """
        n, beam = len(x), min(beam, len(self.points))
        if beam == len(self.points):
            dist = _distances(x, self.points)
            ids = np.argsort(dist, axis=1, kind="stable")
            return ids, np.sqrt(np.take_along_axis(dist, ids, 1))
        if len(self.points) <= DIRECT:
            dist = _distances(x, self.points)
            some = np.sort(np.argpartition(dist, beam - 1, axis=1)[:, :beam], axis=1)
            dist = np.take_along_axis(dist, some, 1)
            order = np.argsort(dist, axis=1, kind="stable")
            return np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))
        far = np.float32(np.inf)

        def measured(ids: np.ndarray) -> np.ndarray:
            diff = self.points[ids] - x[:, None, :]
            return np.einsum("ijk,ijk->ij", diff, diff)

        ids = np.broadcast_to(self.entry, (n, len(self.entry))).copy()
        dist, done = measured(ids), np.zeros(ids.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            open_ = np.where(done | ~np.isfinite(dist), far, dist)
            pick = np.argsort(open_, axis=1, kind="stable")[:, :4]
            can = np.isfinite(np.take_along_axis(open_, pick, 1))
            if not can.any():
                return ids, np.sqrt(dist)
            done[rows, pick] = True
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
            both = np.concatenate((ids, new), 1)
            d = np.concatenate((dist, np.where(np.repeat(can, self.links.shape[1], axis=1), measured(new), far)), 1)
            done = np.concatenate((done, np.zeros(new.shape, bool)), 1)
            # Of a centroid reached again the first place counts: it is the one that knows whether it is done.
            order = np.argsort(both, axis=1, kind="stable")
            ordered = np.take_along_axis(both, order, 1)
            again = np.zeros(both.shape, bool)
            np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            d[again] = far
            best = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(a, best, 1) for a in (both, d, done))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, list): each vector's nearest list, and others as near but for MARGIN that don't lie behind a chosen one."""
        rows, lists = [], []
        for i in range(0, len(x), 1024):
            part = lifted(x[i : i + 1024], self.reach)
            ids, dist = (a[:, :BEAM] for a in self.search(part, BEAM))
            chosen = np.full((len(part), REPLICAS), -1)
            chosen[:, 0] = ids[:, 0]
            n = np.ones(len(part), int)
            for j in range(1, ids.shape[1]):
                ok = (dist[:, j] <= (1 + MARGIN) * dist[:, 0]) & (n < REPLICAS)
                for r in range(REPLICAS):
                    there = chosen[:, r] >= 0
                    gap = np.linalg.norm(self.points[ids[:, j]] - self.points[np.maximum(chosen[:, r], 0)], axis=1)
                    ok &= ~there | (gap >= APART * dist[:, j])
                chosen[ok, n[ok]] = ids[ok, j]
                n[ok] += 1
            at = np.nonzero(chosen >= 0)
            rows.append(i + at[0])
            lists.append(chosen[at])
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, int), np.zeros(0, int))


@dataclass
class Index:
    """The bands, longest vectors first, with the number of their first list; the ratio that prunes lists, and how many it
    leaves a query of the sample."""

    bands: list[Centroids]
    firsts: list[int]
    reach: float
    ratio: float = 1.0
    left: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, reach: float) -> Index:
        """Bands of norms, each a factor of BAND wide or wider, with lists in proportion to their sampled vectors."""
        norm = np.sqrt((sample.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norm, kind="stable")
        bands, firsts, start, used = [], [], 0, 0
        while start < len(order):
            # A band goes on until it is wide and full enough; too few vectors left join it.
            top = reach if not bands else float(norm[order[start]])
            end = max(start + min(BAND_SAMPLE, len(order)), int(np.searchsorted(-norm[order], -top / BAND, side="left")))
            end = len(order) if len(order) - end < BAND_SAMPLE else end
            own = sample[order[start:end]]
            bands.append(Centroids.fit(own, max(1, round(lists * len(own) / len(order))), top))
            firsts.append(used)
            used += len(bands[-1].points)
            start = end
        return cls(bands, firsts, reach)

    @property
    def size(self) -> int:
        return self.firsts[-1] + len(self.bands[-1].points)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, list) of each vector in its band: the shortest-reaching one that reaches it."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        band = np.zeros(len(x), int)
        for j, own in enumerate(self.bands[1:], 1):
            band[norm <= own.reach * (1 + 1e-12)] = j
        rows, lists = [np.zeros(0, int)], [np.zeros(0, int)]
        for j, own in enumerate(self.bands):
            at = np.flatnonzero(band == j)
            row, found = own.assign(x[at])
            rows.append(at[row])
            lists.append(found + self.firsts[j])
        return np.concatenate(rows), np.concatenate(lists)

    def near(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Lists of all bands near each query, nearest first, and their distances' ratios to the nearest one's of
        the same band; whether they are all lists.

        For each band a query is given the length that the band reaches: its length changes no order,
        and so ratios mean the same for all queries and bands.
        """
        ids, ratios = [], []
        long = q.astype(np.float64)
        unit = long / np.sqrt((long**2).sum(1))[:, None]
        for first, own in zip(self.firsts, self.bands):
            i, d = own.search(lifted(unit * own.reach, None), beam)
            ids.append(i + first)
            ratios.append(d / np.maximum(d[:, :1], 1e-12))
        ids, ratios = np.concatenate(ids, 1), np.concatenate(ratios, 1)
        order = np.argsort(ratios, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(ratios, order, 1), ids.shape[1] == self.size

    def route(self, q: np.ndarray, sizes: np.ndarray, k: int, least: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, list, whether it is a near one: the lists that a query reads.

        A list is pruned if its distance exceeds `ratio` times that of its band's nearest one, or if its band can't
        reach `least`, a bound that the query's k best all reach. The near lists are the first NEAR of those and, whatever that
        says, the first ALWAYS and as many as it takes to hold k vectors besides itself for certain: sizes count a vector up to REPLICAS times.
        """
        top = np.concatenate([np.full(len(b.points), b.reach) for b in self.bands])
        rows, lists, near = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, bool)]
        for i in range(0, len(q), 256):
            part, beam = q[i : i + 256], max(64, 2 * self.left)
            length, floor = np.sqrt((part.astype(np.float64) ** 2).sum(1))[:, None], least[i : i + 256, None]
            while True:
                ids, ratios, all_ = self.near(part, beam)
                full = sizes[ids]
                held = np.cumsum(full, axis=1)
                admitted = ratios <= (self.ratio if ratio is None else ratio)
                admitted &= length * top[ids] * (1 + 1e-9) >= floor
                place = np.arange(ids.shape[1])
                close = (held - full < REPLICAS * (k + 1)) | (place < ALWAYS) | admitted & (place < NEAR)
                # A query whose last candidates still count may want more.
                if all_ or not (admitted[:, -1].any() or (held[:, -1] < REPLICAS * (k + 1)).any()):
                    break
                beam *= 2
            at = np.nonzero((admitted | close) & (full > 0))
            rows.append(i + at[0])
            lists.append(ids[at])
            near.append(close[at])
        return np.concatenate(rows), np.concatenate(lists), np.concatenate(near)

    def calibrate(self, sample: np.ndarray, k: int) -> None:
        """Set the smallest ratio at which AIM of all sampled queries' k nearest in the sample are found, and
        EACH_AIM of the k nearest of 95 % of these queries."""
        step = max(1, len(sample) // 256)
        own = np.arange(0, len(sample), step)[:256]
        q = sample[own].astype(np.float64)
        score = q @ sample.T.astype(np.float64)
        score[np.arange(len(own)), own] = -np.inf  # itself, but not its copies
        k = min(k, len(sample) - 1)
        if k < 1:
            return
        truth = np.argpartition(-score, k - 1, axis=1)[:, :k]
        row, where = self.assign(sample)
        order = np.argsort(row, kind="stable")
        row, where = row[order], where[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        lists = np.full((len(sample), REPLICAS), -1)
        lists[row, place] = where
        ids, ratios, _ = self.near(q, self.size)
        rel = np.empty(ratios.shape)
        np.put_along_axis(rel, ids, ratios, 1)
        # A neighbour is found once the ratio admits the nearest to the query of the lists it is in.
        found = lists[truth]
        needed = np.where(found >= 0, rel[np.arange(len(own))[:, None, None], np.maximum(found, 0)], np.inf).min(axis=2)
        self.ratio = float(max(np.quantile(needed, AIM), np.quantile(np.quantile(needed, EACH_AIM, axis=1), 0.95))) + 1e-6
        self.left = int((ratios <= self.ratio).sum(axis=1).mean())


def lifted(x: np.ndarray, reach: float | None) -> np.ndarray:
    more = np.zeros(len(x)) if reach is None else np.sqrt(np.maximum(reach * reach - (x.astype(np.float64) ** 2).sum(1), 0))
    return np.concatenate((x, more[:, None]), axis=1).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: not null, not zero, of finite components, as long as most are.

    Of rows that share a vec_id the one with the least embedding counts. A null vec_id takes no part.
    """
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(e.isNotNull() & F.col("vec_id").isNotNull() & ~odd & F.exists(e, lambda x: x != 0))
    common = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    good = good.where(F.size("embedding") == (common.n if common else 0))
    if not good.groupBy("vec_id").count().where("count > 1").isEmpty():
        good = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return good


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and their length at the end."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(keys[0])])) if len(keys[0]) else np.zeros(1, np.int64)


def _places(starts: np.ndarray) -> np.ndarray:
    """The place in its run of each row."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def best_in_cell(lists: np.ndarray, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, least: np.ndarray, row: np.ndarray, read: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of at least `least` by (score, smaller id), itself apart: query ids, vector ids, scores.

    Query `row[i]` reads list `read[i]`. Matrix products, list by list, find candidates with some slack: what is among the k best of the
    list and reaches the k best of lists before. Then scores are summed in the order of components, so that equal vectors have equal
    scores wherever they lie. Of a list's equal vectors only the k + 1 smallest ids can be among the k best, so no more are compared.
    """
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same, lists))
    order = order[_places(_runs(lists[order], same[order])) <= k]
    lists, ids, x, q = lists[order], ids[order], x[order].astype(np.float64), q.astype(np.float64)
    order = np.argsort(read, kind="stable")
    row, read = row[order], read[order]
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)).max() * x.shape[1]
    floor, rows, cols = least - slack, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = _runs(lists)
    for start, end in zip(starts[:-1], starts[1:]):
        part = x[start:end].T
        asked = row[np.searchsorted(read, lists[start]) : np.searchsorted(read, lists[start], "right")]
        step = max(1, SCORES // (end - start))
        for own in (asked[i : i + step] for i in range(0, len(asked), step)):
            score = q[own] @ part
            r, c = np.nonzero(score >= floor[own, None])
            many = np.flatnonzero(np.bincount(r, minlength=len(own)) > k + 1)
            if len(many):
                # The query itself may be one of the k + 1.
                reached = -np.partition(-score[many], k, axis=1)[:, k] - 2 * slack[own[many]]
                floor[own[many]] = np.maximum(floor[own[many]], reached)
                keep = score[r, c] >= floor[own[r]]
                r, c = r[keep], c[keep]
            rows.append(own[r])
            cols.append(start + c)
    row, col = np.concatenate(rows), np.concatenate(cols)
    keep = qids[row] != ids[col]
    row, col = row[keep], col[keep]
    exact = np.zeros(len(row))
    for c in range(x.shape[1]):
        exact += q[row, c] * x[col, c]
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    # A vector may lie in several of the lists.
    once = _runs(row, ids[col])[:-1]
    row, col, exact = row[once], col[once], exact[once]
    keep = (_places(_runs(row)) < k) & np.isfinite(exact)
    return qids[row[keep]], ids[col[keep]], exact[keep]


def _by_block(n: int, row: np.ndarray, lists: np.ndarray, block: np.ndarray) -> pa.Array:
    """For each of n queries the blocks that it reads, with the lists in them, from pairs (row, list). Blocks ascend with lists."""
    order = np.lexsort((lists, row))
    row, lists = row[order], lists[order]
    starts = _runs(row, block[lists])
    inner = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(lists.astype(np.int32)))
    first = starts[:-1]
    each = pa.StructArray.from_arrays([pa.array(block[lists[first]].astype(np.int32)), inner], ["block", "lists"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32)), each)


def fit(vectors: DataFrame, k: int = K) -> tuple[Index, np.ndarray, np.ndarray] | None:
    """The index, fitted on a bounded sample; the sample and its vec_ids. None if there are no vectors."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, reach, dims = vectors.agg(F.count(F.lit(1)), F.sqrt(F.max(norm)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    lists = int(max(1, min(MOST_LISTS, INDEX_BYTES // (4 * dims + 4), n // LIST_SIZE)))
    rows = int(min(n, MOST_SAMPLE, max(SAMPLE_BYTES // (4 * dims), lists), max(LEAST_SAMPLE, SAMPLE_EACH * lists)))
    share = min(1.0, 1.3 * rows / n + 1e-6)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toArrow()
    x = _matrix(sample["embedding"].combine_chunks())
    index = Index.fit(x, lists, float(reach))
    index.calibrate(x, k)
    return index, x[:LEAST_SAMPLE], sample["vec_id"].to_numpy()[:LEAST_SAMPLE]


def nearest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for vectors (vec_id, embedding) whose vec_id is divisible by `every`, k nearest of all others.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. Every vector is
    in the index; a query reads the lists that Index.route leaves it, which hold k candidates at least if
    the table does. A query whose k-th find is below what a sample alone holds for it has missed some: it
    reads once more, all lists of the bands that reach that far. What takes no part: see usable; other
    columns don't count. Fewer than k candidates are all returned; with none, or an empty table, no rows.
    """
    spark = vectors.sparkSession
    usable_ = usable(vectors)
    kind = "query_id long, rank int, vec_id long, score double"
    fitted = fit(usable_, k)
    if fitted is None:
        return spark.createDataFrame([], kind)
    shared = spark.sparkContext.broadcast(fitted)
    element = usable_.schema["embedding"].dataType.simpleString()

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, own = shared.value[0].assign(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["list", "id", "embedding"])

    postings = written(spread(usable_).mapInArrow(posted, f"list int, id long, embedding {element}"), "postings")
    # A number for each list, of which there are MOST_LISTS at most.
    counted = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes = np.zeros(fitted[0].size, np.int64)
    sizes[counted["list"].to_numpy()] = counted["n"].to_numpy()
    most = max(1, min(BLOCK, BLOCK_BYTES // (4 * fitted[1].shape[1])))
    block = (np.cumsum(sizes) - sizes) // most
    full = spark.sparkContext.broadcast((sizes, block))
    placed = postings.join(F.broadcast(spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(block)), pa.int32()), "block": pa.array(block, pa.int32())}))), "list")
    reads = "array<struct<block:int,lists:array<int>>>"

    def routes(asked: DataFrame, ratio: float | None = None) -> DataFrame:
        """A row for each query: the blocks, and their lists, that are near and that it reads besides."""

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (index, sample, ids), (sizes, block) = shared.value, full.value
            # So many queries at a time that all lists of all of them fit.
            for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
                q, own = _matrix(b.column(1)), b.column(0).to_numpy()
                # The k-th best in the sample is a bound that the k best of all reach.
                least = np.full(len(q), -np.inf)
                s = q.astype(np.float64) @ sample.T.astype(np.float64)
                s[own[:, None] == ids[None, :]] = -np.inf
                if s.shape[1] > k:
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                row, lists, near = index.route(q, sizes, k, least, ratio)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least), *[_by_block(len(q), row[at], lists[at], block) for at in (near, ~near)]], ["id", "embedding", "least", "near", "others"])

        return written(asked.mapInArrow(routed, f"id long, embedding {element}, least double, near {reads}, others {reads}"), "routes")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def compared(vs: pa.Table, qs: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if vs.num_rows and qs.num_rows:
            read = qs["lists"].combine_chunks()
            row = np.repeat(np.arange(len(read)), read.value_lengths().to_numpy())
            (ids, x), (qids, q) = ((t["id"].to_numpy(), _matrix(t["embedding"].combine_chunks())) for t in (vs, qs))
            out = best_in_cell(vs["list"].to_numpy(), ids, x, qids, q, qs["least"].to_numpy(), row, read.flatten().to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    def found(queries: DataFrame, which: str) -> DataFrame:
        """Of each query and cell, the k best vectors that reach `least`. A query goes once to each block that it reads, with the lists' numbers."""
        own = queries.select("id", "embedding", "least", F.explode(which).alias("r")).select("r.block", "r.lists", "id", "embedding", "least")
        # How many cells each block is cut into: at most MOST_LISTS rows. Only blocks that are read go on.
        held = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.when(F.col("n") > 2 * most, F.ceil(F.col("n") / most)).otherwise(1).cast("int").alias("vs"))
        cells = held.join(queries.select(F.explode(f"{which}.block").alias("block")).groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("qs")), "block")
        cells = F.broadcast(written(cells, "cells"))
        at = ["block", "v", "q"]
        left = placed.join(cells, "block").withColumn("v", F.pmod(F.xxhash64("id"), F.col("vs")).cast("int")).withColumn("q", each("qs")).select(*at, "list", "id", "embedding")
        right = own.join(cells, "block").withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.col("qs")).cast("int")).withColumn("v", each("vs")).select(*at, "lists", "id", "embedding", "least")
        return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(compared, "query_id long, vec_id long, score double")

    def ranked(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def searched(queries: DataFrame) -> DataFrame:
        """The k best in the lists of each query. The near ones give each query a bound, so that of the others, however many
        they are, little is found that isn't among the k best."""
        near = written(ranked(found(queries.withColumn("least", F.lit(float("-inf"))), "near")), "near")
        bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        others = queries.join(bound, "id", "left").withColumn("least", F.greatest("least", F.coalesce("bound", "least")))
        return written(ranked(near.drop("rank").unionByName(found(others, "others"))), "nearest")

    queries = routes(spread(usable_.where(F.pmod("vec_id", F.lit(every)) == 0)))
    best = searched(queries)
    last = best.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("last"))
    missed = written(queries.join(last, "id").where(F.col("last") < F.col("least") - 1e-9 * F.abs("least")).select("id", "embedding"), "missed")
    if missed.isEmpty():
        return best
    again = searched(routes(missed, float("inf")))
    return best.join(missed.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
