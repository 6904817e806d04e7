"""Pooling over stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def weighted_pool(df: DataFrame, key, vec: str, weight: str) -> DataFrame:
    """Sum of weight * vector per key, dimension by dimension (partial sums, no group is collected)."""
    keys = [key] if isinstance(key, str) else list(key)
    dims = df.select(*keys, F.posexplode(F.transform(vec, lambda x: x * F.col(weight))).alias("dim", "x"))
    return dims.groupBy(*keys, "dim").agg(F.sum("x").alias("value"))


def pool(df: DataFrame, key, vec: str, how="max") -> DataFrame:
    """Element-wise max or mean per key as (key, dim, value)."""
    keys = [key] if isinstance(key, str) else list(key)
    agg = {"max": F.max, "mean": F.avg}[how]
    return df.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(agg("x").alias("value"))
