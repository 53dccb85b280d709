"""Importance resampling towards a target distribution: hashed n-gram counts by DuckDB in each task, merged and scored by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, spread, written

#: Runs of so many words at most are features, each in one of so many buckets.
N_GRAMS, BUCKETS = 1, 10_000
#: Documents of fewer words are never drawn; of the others so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Code points of a piece of a long text, and bytes of texts that one statement takes.
PIECE, STEP = 2_000_000, 8_000_000
#: What DuckDB may hold in a task.
MEMORY = "512MB"

#: The words of a lower-cased text, as an RE2 pattern; in a text as it is, what words are parted by, and words.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP, WORD = (re.compile(f"[{'' if gap else '^'}\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]{'' if gap else '+'}") for gap in (True, False))
UPPER = "".join(map(chr, range(65, 91)))


def _statement(n_grams: int, buckets: int) -> str:
    """row, bucket, n of the table `given` (row, piece, ahead, text). The last `ahead` words of a piece only end the runs of words before them."""
    window = "PARTITION BY row, piece ORDER BY pos ROWS BETWEEN CURRENT ROW AND {} FOLLOWING"
    longer = [f"SELECT row, string_agg(word, ' ') OVER ({window.format(g - 1)}) AS gram, pos + {g} <= size AND pos < size - ahead AS own FROM words" for g in range(2, n_grams + 1)]
    return f"""
        WITH split AS (SELECT row, piece, ahead, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w FROM given),
        words AS (SELECT row, piece, ahead, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split),
        grams AS ({" UNION ALL ".join(["SELECT row, word AS gram, pos < size - ahead AS own FROM words", *longer])}),
        counted AS (SELECT row, gram, count(*) AS n FROM grams WHERE own GROUP BY row, gram),
        marked AS (SELECT gram, zlib_crc32(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM counted))
        SELECT row, bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM counted JOIN marked USING (gram) GROUP BY row, bucket"""


def pieces(text: str, n_grams: int, longest: int = PIECE) -> list[tuple[str, int]]:
    """A text cut between words into pieces of about so many code points; each goes on for n_grams - 1 more words, whose number is its second part."""
    out, start = [], 0
    while len(text) - start > longest:
        gap = GAP.search(text, start + longest)
        if not gap:
            break
        stop, ahead = gap.start(), 0
        for m in WORD.finditer(text, gap.start()):
            if ahead == n_grams - 1:
                break
            stop, ahead = m.end(), ahead + 1
        out.append((text[start:stop], ahead))
        start = gap.start()
    return [*out, (text[start:], 0)]


def _steps(texts: pa.Array, n_grams: int, piece: int, step: int) -> Iterator[pa.Table]:
    """The texts' pieces, so many bytes at a time: row, piece, ahead, text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    own, held = [], 0
    for row in np.flatnonzero(sizes):
        for number, (part, ahead) in enumerate(pieces(texts[row].as_py(), n_grams, piece)):
            own.append((int(row), number, ahead, part))
            held += min(int(sizes[row]), 4 * len(part))
            if held >= step:
                yield pa.table(dict(zip(("row", "piece", "ahead", "text"), map(list, zip(*own)))))
                own, held = [], 0
    if own:
        yield pa.table(dict(zip(("row", "piece", "ahead", "text"), map(list, zip(*own)))))


def _crc(words: pa.Array) -> pa.Array:
    return pa.array(np.fromiter(map(crc32, words.cast(pa.binary()).to_pylist()), np.uint32, len(words)))


def bucket_counts(docs: DataFrame, n_grams: int = N_GRAMS, buckets: int = BUCKETS, piece: int = PIECE, step: int = STEP) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts of every row of docs (doc_id, text): how many features fall into which buckets.

    A task has one DuckDB, of one thread, bounded memory and no files; long texts are counted piece by piece.
    """
    statement = _statement(n_grams, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            con.create_function("zlib_crc32", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
            for b in batches:
                found = []
                for given in _steps(b.column(1), n_grams, piece, step):
                    con.register("given", given)
                    found.append(con.sql(statement).to_arrow_table())
                    con.unregister("given")
                row, bucket, n = (np.concatenate([t[c].to_numpy() for t in found] or [np.zeros(0, np.int64)]).astype(np.int64) for c in ("row", "bucket", "n"))
                # Pieces of one text come one after the other; what they say of a bucket is added up.
                at, place = np.unique(row * buckets + bucket, return_inverse=True)
                n = np.bincount(place, n, len(at)).astype(np.int64)
                row, bucket = at // buckets, (at % buckets).astype(np.int32)
                ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
                features = np.bincount(row, n, b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(features), pa.ListArray.from_arrays(ends, bucket), pa.ListArray.from_arrays(ends, n)], ["doc_id", "n_features", "buckets", "counts"])

    own = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return own.mapInArrow(count, "doc_id long, n_features long, buckets array<int>, counts array<long>")


def n_words(n_features: Column, n_grams: int) -> Column:
    """How many words have so many runs of up to n_grams words: of w words, w + (w - 1) + ..., none below 0."""
    full = n_grams * (n_grams - 1) // 2  # what is missing to n_grams runs a word, where there are as many words
    short = F.lit(0).cast("long")
    for w in range(1, n_grams):
        short = short + (n_features >= w * (w + 1) // 2).cast("long")
    return F.when(n_features >= n_grams * (n_grams + 1) // 2, ((n_features + full) / n_grams).cast("long")).otherwise(short)


def _totals(counts: DataFrame, name: str) -> DataFrame:
    """bucket, <name>: summed in each task before anything is shuffled; at most as many rows as there are buckets."""
    pairs = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: what a feature of each bucket is worth, as an array by bucket.

    floor(1000 * ln of the target's share over the source's), both counted one higher in each bucket.
    """
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_totals(source, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    gain = F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    worth = written(both, "bucket-totals")
    worth = worth.crossJoin(F.broadcast(written(sums, "bucket-sums"))).select("bucket", gain.alias("gain"))
    # As many entries as there are buckets.
    return worth.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the id alone: 32 bits of its SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def with_rank(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place, from 1, in an order of all of them.

    They are dealt out by ranges of the order and sorted where they are; a table of the ranges' sizes, a row each, does
    the rest, so that no task sees more than its range. `order` has to tell all rows apart.
    """
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # A row for each range.
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "range").withColumn(name, F.col("before") + F.col("at") + 1).drop("range", "at", "before")


def resample(docs: DataFrame, target: DataFrame, n_grams: int = N_GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text), drawn towards the texts of `target`.

    Features are runs of up to n_grams words. A document's weight is the sum of its features' gains; its score adds Gumbel noise, so that
    the highest scores are a sample without replacement by weight. Of the documents of at least least_words words so many of a
    hundred are drawn, the highest scores, ties to the smaller doc_id; their ranks are 1, 2, 3 and so on, all others have none.

    Nulls: a null text has no words and weight 0; a null doc_id draws the noise of an empty one and comes last in ties. Rows that repeat a
    doc_id are scored each; among equal ones any order counts. Without target texts all features of a bucket are worth what smoothing
    leaves. An empty table gives an empty result. Very long texts are counted in pieces; other columns play no part.
    """
    spark = docs.sparkSession
    own = written(bucket_counts(docs, n_grams, buckets), "bucket-counts")
    wanted = written(bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n_grams, buckets), "target-counts")
    weight = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get("gains", b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    weighed = own.crossJoin(F.broadcast(gains(own, wanted, buckets))).select("doc_id", "n_features", weight.alias("weight"))  # one row
    scored = weighed.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), n_words(F.col("n_features"), n_grams).alias("words"), F.monotonically_increasing_id().alias("place"))
    scored = written(scored, "scored")
    long_enough = scored.where(F.col("words") >= least_words)
    drawn = percent * long_enough.count() // 100
    ranked = with_rank(long_enough, "rank", F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: CRC-32 bit by bit; distinct words only.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w FROM benchmark),
counted AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM counted UNION SELECT word FROM wanted)),
crcs AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
         lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % {BUCKETS} AS bucket FROM spelled),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM counted JOIN crcs USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM wanted JOIN crcs USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT sum(s) FROM s) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + {BUCKETS}) / ((coalesce(s, 0) + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM counted JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= (SELECT {PERCENT} * count(*) // 100 FROM ranked) THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
