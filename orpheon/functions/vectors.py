"""Vector expressions on ARRAY<DOUBLE> columns. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v / max(|v|, eps)."""
    size = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / size)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, k: Column | float) -> Column:
    return F.transform(v, lambda x: x * k)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(v, lambda x: F.exp(x - top) / total)


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def sigmoid(v: Column) -> Column:
    return F.transform(v, lambda x: 1 / (1 + F.exp(-x)))


def argmax(v: Column) -> Column:
    """Position of the largest element from 0, the lowest on ties."""
    return F.array_position(v, F.array_max(v)) - 1


def margin(v: Column) -> Column:
    """Largest minus second largest element."""
    ordered = F.sort_array(v, asc=False)
    return ordered[0] - ordered[1]


def pad_or_truncate(v: Column, size: int) -> Column:
    """Zeros to the right, or cut."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def mean_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Element-wise mean of vec for each key: partial sums before the shuffle, one row per key and element."""
    each = df.select(*keys, F.posexplode(vec).alias("_i", "_x"))
    return (
        each.groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
        .select(*keys, F.transform("_v", lambda p: p["_x"]).alias(out))
    )


def max_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Element-wise maximum of vec for each key."""
    each = df.select(*keys, F.posexplode(vec).alias("_i", "_x"))
    return (
        each.groupBy(*keys, "_i").agg(F.max("_x").alias("_x"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
        .select(*keys, F.transform("_v", lambda p: p["_x"]).alias(out))
    )
