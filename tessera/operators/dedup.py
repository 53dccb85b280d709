"""Greedy removal of near duplicates by embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.scratch import written

#: Added to the product of norms.
EPSILON = 1e-9
#: Rows of a block; rows that a cell has on average, while there are not too many cells.
BLOCK, CELL = 4096, 2048
#: Cells at most: that bounds what is collected and broadcast, a vector each.
MOST_CELLS = 8192
#: What rounding may move an angle or a product by.
SLACK = 1e-6


def _usable(vectors: DataFrame) -> DataFrame:
    """ord, embedding, size (its square norm) of the rows that can be near another."""
    own = vectors.select(F.col("ord").cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"))
    sized = own.withColumn("size", dot(F.col("embedding"), F.col("embedding")))
    return sized.where((F.col("size") > 0) & (F.col("size") < float("inf")))


def classes(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one: (ord, embedding) of the first row of each, and a, b, similarity of every other row b with its first row a.

    Vectors so short that they don't reach the threshold with themselves stay apart.
    """
    own = _usable(vectors)
    itself = F.col("size") / (F.col("size") + EPSILON)
    alone = F.when(itself < threshold, F.col("ord"))
    first = own.groupBy("embedding", alone.alias("alone")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    first = written(first, "vector-classes")
    copied = first.where("n > 1").select(F.col("ord").alias("a"), "embedding", itself.alias("similarity"))
    # Copies lie with their first row where that side is small, and else by vector: AQE splits a vector's many rows.
    others = own.join(copied, "embedding").where("ord <> a").select("a", F.col("ord").alias("b"), "similarity")
    return first.select("ord", "embedding"), others


def near_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """a, b, similarity: pairs of rows (ord, embedding), a before b, whose cosine reaches the threshold; of equal vectors only those with the first of them.

    Exact for every threshold and size: what equals a first row is its copy and near what that one is near. Distinct vectors are
    joined by distinct_pairs(). Rows without an embedding, with one of zeros, or with components that are null or not finite are near none;
    all embeddings have the same length.
    """
    firsts, copies = classes(vectors, threshold)
    return distinct_pairs(firsts, threshold, block, cell).unionByName(copies)


def distinct_pairs(rows: DataFrame, threshold: float, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """a, b, similarity of all pairs of rows (ord, embedding) that reach the threshold: a join in the metric of angles.

    Some rows, chosen by hash, are pivots. A row's home is the cell of the pivot nearest to it; it visits each cell before its own
    that can hold a row within the threshold's angle r. That is ruled out by the half-space between the two pivots, from which it would be
    more than r away, or by the cell's nearest and farthest row. So every pair meets in one cell: that of the first of their homes. Cells
    are dealt into blocks of about `block` rows, and two blocks are compared in one task by a matrix product; no task holds
    more than two blocks, and nothing but pairs found leaves it. Where vectors have no structure, or r is wide, no cell can be ruled
    out, and all is compared with all, as it has to be.
    """
    spark = rows.sparkSession
    n = rows.count()
    wanted = min(MOST_CELLS, max(1, -(-n // cell)))
    chosen = rows.orderBy(F.xxhash64("ord"), "ord").limit(wanted).select("embedding").toArrow()  # MOST_CELLS vectors at most
    if not len(chosen):
        return spark.createDataFrame([], "a long, b long, similarity double")
    pivots = spark.sparkContext.broadcast(_unit(_matrix(chosen["embedding"].combine_chunks())))
    # Below 0, the small number added to norms lets vectors beyond the angle reach the threshold.
    radius = float(np.arccos(threshold)) if 0 < threshold <= 1 else np.pi

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _unit(_matrix(b.column(1))) @ pivots.value.T
            home = near.argmax(axis=1) if len(near) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(near)), home], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(angle)], ["ord", "embedding", "cell", "angle"])

    homes = written(rows.select("ord", "embedding").mapInArrow(settle, "ord long, embedding array<double>, cell int, angle double"), "cells")
    reach = homes.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).toArrow()  # a row for each cell
    low, high = np.full(len(chosen), np.inf), np.full(len(chosen), -np.inf)
    low[reach["cell"].to_numpy()], high[reach["cell"].to_numpy()] = reach["low"].to_numpy(), reach["high"].to_numpy()
    bounds = spark.sparkContext.broadcast((low, high))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (low, high), p = bounds.value, pivots.value
        for b in batches:
            x, home = _unit(_matrix(b.column(1))), b.column(2).to_numpy()
            for i in range(0, len(x), 256):
                own, at = x[i : i + 256], home[i : i + 256]
                near = own @ p.T
                angle = np.arccos(np.clip(near, -1, 1))
                goes = (np.arange(len(p)) < at[:, None]) & (angle <= high + radius + SLACK) & (angle >= low - radius - SLACK)
                if radius < np.pi / 2:
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (p[at] @ p.T)))
                    goes &= near[np.arange(len(own)), at][:, None] - near <= np.sin(radius) * apart + SLACK
                row, cell = np.nonzero(goes)
                row = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(cell.astype(np.int32))], ["ord", "embedding", "cell"])

    visitors = homes.select("ord", "embedding", "cell").mapInArrow(visit, "ord long, embedding array<double>, cell int")
    own = homes.select("ord", "embedding", "cell", F.lit(True).alias("home")).unionByName(visitors.withColumn("home", F.lit(False)))
    own = written(own, "cell-rows")
    sizes = own.groupBy("cell").agg(*[F.ceil(F.count_if(c) / block).cast("int").alias(name) for name, c in (("homes", F.col("home")), ("visits", ~F.col("home")))], F.count(F.lit(1)).alias("rows"))
    placed = own.join(F.broadcast(sizes.where("rows > 1").drop("rows")), "cell")  # MOST_CELLS rows at most
    at = F.pmod(F.xxhash64("ord"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int")
    # Blocks of visitors are numbered after those of homes. A home's row meets all blocks, a visitor's those of homes.
    meets = F.transform(F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("visits")).otherwise(F.col("homes")) - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    dealt = placed.withColumn("block", at + F.when(F.col("home"), 0).otherwise(F.col("homes"))).withColumn("pair", F.explode(meets)).select("cell", "pair.lo", "pair.hi", "block", "ord", "embedding")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        _, lo, hi = (k.as_py() for k in key)
        block, ids = rows["block"].to_numpy(), rows["ord"].to_numpy()
        x = _matrix(rows["embedding"].combine_chunks())
        size = np.sqrt((x * x).sum(axis=1))
        sides = [np.flatnonzero(block == k) for k in (lo, hi)]
        a, b, found = [], [], []
        for i in range(0, len(sides[0]), 512):
            left = sides[0][i : i + 512]
            cosine = x[left] @ x[sides[1]].T / (size[left, None] * size[None, sides[1]] + EPSILON)
            r, c = np.nonzero(cosine >= threshold)
            u, v = ids[left[r]], ids[sides[1][c]]
            keep = (u < v) if lo == hi else np.ones(len(u), bool)
            a.append(np.minimum(u, v)[keep])
            b.append(np.maximum(u, v)[keep])
            found.append(cosine[r, c][keep])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none), "similarity": np.concatenate(found or [np.zeros(0)])})

    return dealt.groupBy("cell", "lo", "hi").applyInArrow(compare, "a long, b long, similarity double")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def drop_near_duplicates(rows: DataFrame, threshold: float = 0.95, pairs: DataFrame | None = None) -> DataFrame:
    """Rows (ord, embedding, ...) without those near an earlier kept row. `pairs` may give all near pairs (a, b), a before b.

    Of equal vectors all but the first go: either that one is kept, or what it is near to is, and they are near the same.
    The same as going through the rows in order and keeping each that is near no kept one: a row is
    kept once all its earlier neighbours are known to be dropped, and dropped once one is known to be kept.
    Each round settles at least the first unsettled row of every chain; rounds are as many as chains are long.
    """
    copies = None
    if pairs is None:
        firsts, copies = classes(rows, threshold)
        pairs = distinct_pairs(firsts, threshold)
    links = written(pairs.select("a", "b"), "near-pairs")
    open_ = links.select(F.col("b").alias("ord")).distinct()
    # Rows without an earlier neighbour are kept from the start.
    kept = links.select(F.col("a").alias("ord")).distinct().join(open_, "ord", "left_anti")
    dropped = links.select("b").limit(0).withColumnRenamed("b", "ord")
    while True:
        # Every round is written, so that plans don't grow with the rounds.
        gone = links.join(kept.withColumnRenamed("ord", "a"), "a", "left_semi").select(F.col("b").alias("ord")).distinct()
        dropped = written(dropped.unionByName(gone).distinct(), "dropped")
        open_ = written(open_.join(dropped, "ord", "left_anti"), "open")
        if open_.isEmpty():
            break
        live = links.join(dropped.withColumnRenamed("ord", "a"), "a", "left_anti").join(kept.withColumnRenamed("ord", "a"), "a", "left_anti")
        kept = written(kept.unionByName(open_.join(live.select(F.col("b").alias("ord")), "ord", "left_anti")).distinct(), "kept")
        open_ = open_.join(kept, "ord", "left_anti")
    dropped = dropped if copies is None else dropped.unionByName(copies.select(F.col("b").alias("ord")))
    return rows.join(dropped, "ord", "left_anti")
