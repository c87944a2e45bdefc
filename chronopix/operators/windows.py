"""Sequence operators over a pixel's date-ordered observations, as SQL windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopix.operators.prep import PIXEL


def group_years(df: DataFrame, interval: int = 3, year: str = "year", keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Adds ``period``: years dealt into about equal runs of ``interval`` years, the first runs the longer ones."""
    w = Window.partitionBy(*keys)
    low, high = F.min(year).over(w), F.max(year).over(w)
    df = df.withColumns({"_i": F.col(year) - low, "_n": high - low + 1, "_g": F.ceil((high - low) / F.lit(interval)).cast("int")})
    q, r = F.expr("_n div _g"), F.expr("_n % _g")
    early = F.col("_i") < r * (q + 1)
    run = F.when(early, F.expr("_i div (_n div _g + 1)")).otherwise(r + F.expr("(_i - (_n % _g) * (_n div _g + 1)) div (_n div _g)"))
    return df.withColumn("period", F.when(F.col("_g") <= 1, F.lit(0)).otherwise(run).cast("int")).drop("_i", "_n", "_g")


def scale_by_period(df: DataFrame, value: str, low: float = 0.1, high: float = 0.9, keys: tuple[str, ...] = (*PIXEL, "period")) -> DataFrame:
    """Adds ``scaled``: the value between two percentiles of its period; null where they are equal."""
    w = Window.partitionBy(*keys)
    a, b = F.percentile(value, F.lit(low)).over(w), F.percentile(value, F.lit(high)).over(w)
    return df.withColumns({"_a": a, "_b": b}).withColumn("scaled", F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def nearest_in_season(df: DataFrame, day: int, k: int, circular: bool = False, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """The k observations of each pixel nearest in the season after a day (or on either side, if circular)."""
    off = F.pmod((F.col("ordinal") - F.lit(day)).cast("double"), F.lit(365.25))
    if circular:
        off = F.least(off, F.lit(365.25) - off)
    w = Window.partitionBy(*keys).orderBy("_off", "ordinal")
    return df.withColumn("_off", off).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("_off", "distance")


def recursive_residuals(df: DataFrame, value: str, x: str = "x", keys: tuple[str, ...] = PIXEL, order: str = "ordinal") -> DataFrame:
    """Adds ``recresid``: standardised forecast errors of a straight line through all earlier observations.

    Null for the first two.  One window with a growing frame; no Python.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, mean, sxx = F.count(value).over(before), F.avg(x).over(before), F.regr_sxx(F.col(value), F.col(x)).over(before)
    slope, intercept = F.regr_slope(F.col(value), F.col(x)).over(before), F.regr_intercept(F.col(value), F.col(x)).over(before)
    df = df.withColumns({"_n": n, "_m": mean, "_s": sxx, "_b": slope, "_a": intercept})
    err = (F.col(value) - F.col("_a") - F.col("_b") * F.col(x)) / F.sqrt(1 + 1 / F.col("_n") + F.pow(F.col(x) - F.col("_m"), F.lit(2.0)) / F.col("_s"))
    return df.withColumn("recresid", F.when((F.col("_n") >= 2) & (F.col("_s") > 0), err)).drop("_n", "_m", "_s", "_b", "_a")


def kolmogorov_tail(s: Column, terms: int = 12) -> Column:
    """P(sup |Brownian bridge| > s), by its alternating series."""
    total = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * s * s) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when(s < 0.3, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def cusum_test(df: DataFrame, resid: str, keys: tuple[str, ...] = PIXEL, order: str = "ordinal", ddof: int = 2) -> DataFrame:
    """Per group: n, statistic and p-value of the CUSUM test on OLS residuals.

    The running sum is the only window; the rest is one aggregation over it.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumn("_c", F.sum(resid).over(w)).groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.abs("_c")).alias("_m"), F.sum(F.col(resid) * F.col(resid)).alias("_q"))
    stat = F.col("_m") / F.sqrt(F.col("_q") * F.col("n") / (F.col("n") - ddof))
    return sums.where((F.col("n") > ddof) & (F.col("_q") > 0)).withColumn("statistic", stat).withColumn("p_value", kolmogorov_tail(F.col("statistic"))).drop("_m", "_q")


def line_residuals(df: DataFrame, value: str, x: str = "x", keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Adds ``resid``: the value less its group's OLS line in x."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_b": F.regr_slope(F.col(value), F.col(x)).over(w), "_a": F.regr_intercept(F.col(value), F.col(x)).over(w)})
    return df.withColumn("resid", F.col(value) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def look_ahead_change(df: DataFrame, score: str, consecutive: int, threshold: float, keys: tuple[str, ...] = PIXEL, order: str = "ordinal") -> DataFrame:
    """Adds ``change``: this and the next ``consecutive`` - 1 scores all exceed the threshold (for a fixed model)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, consecutive - 1)
    return df.withColumn("change", (F.count(score).over(w) == consecutive) & (F.min(score).over(w) > threshold))


def job_rows(df: DataFrame, job: int, jobs: int, row: str = "py", total: int | None = None) -> DataFrame:
    """The raster rows of one of several jobs: interlaced, or with the ``total`` of rows in runs, the first ones taking the remainder."""
    if not 0 <= job < jobs:
        raise ValueError(f"no job {job} of {jobs}")
    if total is None:
        return df.where(F.pmod(F.col(row), F.lit(jobs)) == job)
    size, more = divmod(total, jobs)
    first = job * size + min(job, more)
    return df.where(F.col(row).between(first, first + size + (job < more) - 1))
