"""What the operators of this subpackage share: tables, scratch space and skew-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import clean_scratch, scratch, shared_dir, written  # noqa: F401

#: The white space of all contracts here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: A run of anything else, as a Java, RE2 or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with more than one row in HOT_SHARE are hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """A few files of one row group give a few tasks, however many splits they have; deal the rows of such out evenly."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * least or len(df.inputFiles()) >= least else df.repartition(least)


def without_spaces(text: Column) -> Column:
    """The text without white space; null counts as empty. Plain replacements are the fastest way that Spark has."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def n_words_of(text: Column) -> Column:
    """How many `[^\x20\x09-\x0D]+` a text has, as a long: the parts between white space, but for empty ones at the ends."""
    whole = F.coalesce(text, F.lit(""))
    ends = sum((F.substring(whole, at, 1).isin(*SPACES).cast("int") for at in (1, -1)), F.lit(0))
    return F.when(whole == "", F.lit(0)).otherwise(F.size(F.split(whole, r"[\x20\x09-\x0D]+")) - ends).cast("long")


def free_names(df: DataFrame, n: int) -> list[str]:
    """So many names of columns that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"own_{i}" for i in range(n + len(taken))) if x not in taken][:n]


def hot_join(rows: DataFrame, unique: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of many rows with a table of one row per key that knows each key's number of rows.

    A key with over total / HOT_SHARE rows would land in one task. At most HOT_SHARE keys can be
    so frequent: their side is broadcast (that count is its proven bound) and their rows stay where
    they are. All other rows are shuffled, with few rows to a key. `unique` gives each key's number
    of rows in the column `size`; `total` is the number of rows.
    """
    keys = list(keys)
    most = max(1000, total // HOT_SHARE)
    hot = F.broadcast(unique.where(F.col(size) > most))
    is_hot = hot.select(*keys)
    return rows.join(hot, keys).unionByName(rows.join(is_hot, keys, "left_anti").join(unique.where(F.col(size) <= most), keys))
