"""Range queries over segments: when, how often and how strongly pixels changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopix.functions.columns import format_ordinal
from chronopix.operators.maps import on_grid
from chronopix.operators.prep import PIXEL


def changed_between(start: int, end: int) -> Column:
    return F.col("break").between(start, end)


def magnitude_bands(segments: DataFrame, n_bands: int, test_indices: list[int] | None = None) -> list[int]:
    """The tested bands, or those with a magnitude other than 0 anywhere: one row of flags comes back."""
    if "magnitude" not in segments.columns:
        raise KeyError("the segments have no magnitude")
    if test_indices is not None:
        return list(test_indices)
    row = segments.agg(*(F.bool_or(F.element_at("magnitude", b + 1) != 0).alias(f"m{b}") for b in range(n_bands))).first()
    return [b for b in range(n_bands) if row[f"m{b}"]]


def change_date_map(segments: DataFrame, grid: DataFrame, start: int, end: int, first: bool = False, out_format: str = "%Y%j", ndv: int = -9999, magnitude: list[int] | None = None) -> DataFrame:
    """The first or last change date of each pixel within [start, end], with the magnitudes of bands if wanted."""
    pick = F.min_by if first else F.max_by
    rows = segments.where(changed_between(start, end))
    wanted = F.struct("break", *(["magnitude"] if magnitude else []))
    best = rows.groupBy(*PIXEL).agg(pick(wanted, F.col("seg_id")).alias("best"))
    out = [format_ordinal(F.col("best")["break"], out_format).alias("change")]
    out += [F.element_at(F.col("best")["magnitude"], b + 1).cast("double").alias(f"MagnitudeIndex{b}") for b in magnitude or []]
    return on_grid(best.select(*PIXEL, *out), grid, ndv)


def change_count_map(segments: DataFrame, grid: DataFrame, start: int, end: int, ndv: int = -9999) -> DataFrame:
    """The number of changes of each pixel within [start, end]; ``ndv`` where there is none."""
    n = segments.where(changed_between(start, end)).groupBy(*PIXEL).agg(F.count("*").cast("int").alias("n_changes"))
    return on_grid(n, grid, ndv)
