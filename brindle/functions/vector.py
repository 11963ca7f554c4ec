"""Vector scalars over arrays; mismatched, empty and zero vectors follow the stated defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero for vectors of different sizes, empty ones and ones without length."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (lengths == 0), F.lit(0.0)).otherwise(dot(a, b) / lengths)


def euclidean(a: Column, b: Column) -> Column:
    """The largest double for vectors of different sizes."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) != F.size(b), F.lit(1.7976931348623157e308)).otherwise(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit integers."""
    return F.bit_count(a.bitwiseXOR(b))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
