"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Of zero vectors: null, or 0 with an epsilon."""
    product = norm(a) * norm(b) + F.lit(epsilon)
    return F.when(product > 0, dot(a, b) / product)


def bucket(term: Column, dimensions: int = DIMENSIONS) -> Column:
    """The component that a term adds to in the offline embedding: eight hexadecimal digits of its MD5, modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int")


def hashed_embedding(terms: Column, dimensions: int = DIMENSIONS) -> Column:
    """The offline embedding: counts of terms by bucket, as an array of floats. For few or short texts; see operators.vector."""
    buckets = F.transform(terms, lambda t: bucket(t, dimensions))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(buckets, lambda b: b == d)).cast("float"))
