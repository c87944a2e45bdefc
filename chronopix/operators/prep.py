"""Native preparation of observations: filters, composites, designs, series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopix.functions.formula import Design, category_levels

PIXEL = ("py", "px")
#: A partition of ``by_pixel`` holds the observations of about as many bytes of files.
PARTITION_BYTES = 4 << 20
#: Spark's plans have sizes about as large for tables of no known size.
UNKNOWN_BYTES = 1 << 60


def in_range(bands: list[str], low: float | list[float] | None, high: float | list[float] | None) -> Column:
    """All bands within their bounds; true if either bound is missing."""
    if low is None or high is None:
        return F.lit(True)
    lows = low if isinstance(low, (list, tuple)) else [low] * len(bands)
    highs = high if isinstance(high, (list, tuple)) else [high] * len(bands)
    if not len(bands) == len(lows) == len(highs):
        raise ValueError("one bound per band is needed")
    return reduce(lambda a, b: a & b, (F.col(b).between(x, y) for b, x, y in zip(bands, lows, highs, strict=True)))


def not_masked(mask: str | None, values: list[int] | None) -> Column:
    """The mask band has none of the masked codes; true without a mask band."""
    return F.lit(True) if mask is None or not values else ~F.col(mask).isin(*values)


def clear_observations(obs: DataFrame, bands: list[str], low=None, high=None, mask: str | None = None, mask_values: list[int] | None = None) -> DataFrame:
    """Observations in range and not masked, without the mask band.  Both predicates reach the Parquet scan."""
    kept = obs.where(in_range(bands, low, high) & not_masked(mask, mask_values))
    return kept.drop(mask) if mask else kept


def daily_composite(obs: DataFrame, bands: list[str], keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """The mean of each band over a pixel's observations of one day."""
    return obs.groupBy(*keys, "ordinal").agg(*(F.avg(b).alias(b) for b in bands))


def with_catalog(obs: DataFrame, catalog: DataFrame, key: str = "image_id") -> DataFrame:
    """Observations with their acquisition's columns.

    The catalogue has a row per image, so Spark broadcasts it by its size where it
    is under the session's broadcast threshold, and shuffles both sides otherwise.
    """
    return obs.join(catalog, key)


def with_design(df: DataFrame, formula: str, name: str = "design", levels: dict[str, list[str]] | None = None) -> DataFrame:
    """A column with the array of a formula's features."""
    return df.withColumn(name, Design(formula, levels if levels is not None else category_levels(df, formula)).array())


def by_pixel(obs: DataFrame, partitions: int | None = None, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Observations with each pixel's in one partition: composites and series of them need no further shuffle.

    The work on series is heavy on CPU and light on bytes, so the number of
    partitions is fixed; merging small ones would cost parallelism.  It grows
    with the files read, so that a task's sorts and windows do not.
    """
    spark = obs.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return obs.repartition(partitions or max(least, -(-source_bytes(obs) // PARTITION_BYTES)), *keys)


def source_bytes(df: DataFrame) -> int:
    """The size of the files that a table is read from, as its plan knows it; what has no known size counts as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def pixel_series(obs: DataFrame, bands: list[str], extra: list[str] | None = None, reverse: bool = False, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """One row per pixel: its observations as an array of structs in date order (or reversed).

    One shuffle; a pixel's series is as long as its archive has images, so the
    array is bounded by the catalogue, not by the table.
    """
    items = F.sort_array(F.collect_list(F.struct("ordinal", *(extra or []), *bands)), asc=not reverse)
    return obs.groupBy(*keys).agg(items.alias("series"))


def window_index(keys: tuple[str, ...] = PIXEL):
    return Window.partitionBy(*keys).orderBy("ordinal")


def dates_up_to(obs: DataFrame, day: int, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Per pixel, the number of observations on or before a day (where a sorted insert to the right would go)."""
    return obs.groupBy(*keys).agg(F.count_if(F.col("ordinal") <= day).alias("index"))
