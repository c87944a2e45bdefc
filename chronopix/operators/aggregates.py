"""Aggregates per pixel; all have map-side partial results except the exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopix.operators.prep import PIXEL


def rmse(y: Column, fitted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - fitted, F.lit(2.0))))


def mad(df: DataFrame, value: str, constant: float = 0.6745, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Per group: the exact median of distances from the median, over ``constant``.

    Two shuffles of one double and the keys; the medians are joined, not windowed,
    so a large group is never sorted as a window partition.
    """
    centre = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    return df.join(centre, list(keys)).groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("_m"))) / F.lit(constant)).alias("mad"))


def gram(df: DataFrame, features: list[Column], y: Column, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Per group: n, the upper Gram matrix as g_i_j, x'y as c_i, and y'y as yy.

    Sums merge, so this is one aggregation however many rows a group has.
    """
    cols = [F.count("*").alias("n")]
    for i, a in enumerate(features):
        cols += [F.sum(a * b).alias(f"g_{i}_{j}") for j, b in enumerate(features) if j >= i]
        cols.append(F.sum(a * y).alias(f"c_{i}"))
    return df.groupBy(*keys).agg(*cols, F.sum(y * y).alias("yy"))


def solve_gram(grams: DataFrame, p: int, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Coefficients b_0.. and rss from a Gram table, by Cholesky in column expressions (p is small)."""
    g = lambda i, j: F.col(f"g_{min(i, j)}_{max(i, j)}")
    df = grams
    for j in range(p):
        d = g(j, j)
        for k in range(j):
            d = d - F.col(f"_l_{j}_{k}") * F.col(f"_l_{j}_{k}")
        df = df.withColumn(f"_l_{j}_{j}", F.sqrt(d))
        for i in range(j + 1, p):
            s = g(i, j)
            for k in range(j):
                s = s - F.col(f"_l_{i}_{k}") * F.col(f"_l_{j}_{k}")
            df = df.withColumn(f"_l_{i}_{j}", s / F.col(f"_l_{j}_{j}"))
    for i in range(p):
        s = F.col(f"c_{i}")
        for k in range(i):
            s = s - F.col(f"_l_{i}_{k}") * F.col(f"_z_{k}")
        df = df.withColumn(f"_z_{i}", s / F.col(f"_l_{i}_{i}"))
    for i in range(p - 1, -1, -1):
        s = F.col(f"_z_{i}")
        for k in range(i + 1, p):
            s = s - F.col(f"_l_{k}_{i}") * F.col(f"b_{k}")
        df = df.withColumn(f"b_{i}", s / F.col(f"_l_{i}_{i}"))
    fitted = sum((F.col(f"_z_{i}") * F.col(f"_z_{i}") for i in range(p)), F.lit(0.0))
    return df.withColumn("rss", F.greatest(F.lit(0.0), F.col("yy") - fitted)).select(*keys, "n", *(f"b_{i}" for i in range(p)), "rss")
