"""Vectors as array columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x / n))


def literal(a: Column) -> Column:
    """JSON text with six decimals."""
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(a, lambda x: F.format_string("%.6f", x.cast("double")))), F.lit("]"))


def centroid(rows: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """Element-wise mean per group, as an array in place order."""
    flat = rows.select(*keys, F.posexplode(vector).alias("k", "x"))
    means = flat.groupBy(*keys, "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("centroid"))
