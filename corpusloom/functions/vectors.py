"""Vectors as arrays: double precision, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error where its length isn't dim."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} components, found "), F.size(v).cast("string"))))
