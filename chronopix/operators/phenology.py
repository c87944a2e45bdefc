"""Long-term-mean phenology of segments.

The index, its filter, the grouping of years and the scaling by percentiles are
native; only the smoothing spline of each segment runs in NumPy, on one
array-valued row per segment; its metrics are array expressions again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopix.functions.columns import argmax, evi, halfmax, year_and_doy
from chronopix.operators.prep import by_pixel
from chronopix.operators.segmentation import observations_of_segments
from chronopix.operators.windows import group_years, scale_by_period
from chronopix.shipping import ship_package

SEGMENT = ("py", "px", "seg_id")


@dataclass(frozen=True)
class Phenology:
    """Bands by name; ``evi_band`` (with its factor ``evi_scale``) instead of the three if the index is given."""

    red: str | None = "b2"
    nir: str | None = "b3"
    blue: str | None = "b0"
    scale: float = 0.0001
    evi_band: str | None = None
    evi_scale: float | None = None
    year_interval: int = 3
    q_min: float = 10
    q_max: float = 90
    spar: float = 0.55

    def __post_init__(self):
        if self.evi_band is not None and not isinstance(self.evi_scale, float):
            raise ValueError("a float evi_scale is needed with evi_band")

    def index(self) -> Column:
        if self.evi_band is not None:
            return F.col(self.evi_band) * F.lit(self.evi_scale)
        return evi(*(F.col(b) * F.lit(self.scale) for b in (self.red, self.nir, self.blue)))


def scaled_index(obs: DataFrame, segments: DataFrame, p: Phenology, dealt: bool = False) -> DataFrame:
    """Observations in segments with evi in [0, 1], year, doy, period and the scaled index."""
    year, doy = year_and_doy(F.col("ordinal"))
    rows = observations_of_segments(obs if dealt else by_pixel(obs), segments).withColumn("evi", p.index()).where(F.col("evi").between(0, 1)).withColumns({"year": year, "doy": doy})
    grouped = group_years(rows, p.year_interval, keys=SEGMENT)
    return scale_by_period(grouped, "evi", p.q_min / 100, p.q_max / 100, keys=(*SEGMENT, "period")).where(F.col("scaled").isNotNull() & ~F.isnan("scaled"))


def long_term_mean(obs: DataFrame, segments: DataFrame, p: Phenology | None = None, dealt: bool = False) -> DataFrame:
    """The segments with spring_doy, autumn_doy, pheno_cor, peak_evi, peak_doy, spline_evi and pheno_nobs.

    A segment without usable observations gets zeros and a null spline.  peak_doy
    counts from 0, the other two days from 1.  The observations are spread by
    pixel, unless ``dealt`` says that ``by_pixel`` has done so.
    """
    p = p or Phenology()
    ship_package(obs.sparkSession)
    rows = scaled_index(obs, segments, p, dealt).groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(F.struct("doy", "scaled"))).alias("s"), F.count("*").cast("int").alias("pheno_nobs"))
    rows = rows.select(*SEGMENT, "pheno_nobs", F.col("s.doy").alias("doy"), F.col("s.scaled").alias("scaled"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from chronopix.functions.kernels import smoothing_spline

        for batch in batches:
            curves, cors = [], []
            for doy, value in zip(batch["doy"], batch["scaled"], strict=True):
                doy, value = np.asarray(doy, float), np.asarray(value, float)
                pad = np.concatenate([np.arange(1, doy.min()), np.arange(doy.max(), 366)])
                x, y = np.concatenate([doy, pad]), np.concatenate([value, np.zeros(len(pad))])
                curve = smoothing_spline(x, y, np.arange(1, 367), p.spar)
                at = curve[doy.astype(int) - 1]
                curves.append(curve)
                cors.append(float(np.corrcoef(at, value)[0, 1]) if len(value) > 1 and np.ptp(value) > 0 and np.ptp(at) > 0 else 0.0)
            yield pd.DataFrame({"py": batch["py"], "px": batch["px"], "seg_id": batch["seg_id"], "pheno_nobs": batch["pheno_nobs"], "spline_evi": curves, "pheno_cor": cors})

    fitted = rows.mapInPandas(run, "py int, px int, seg_id int, pheno_nobs int, spline_evi array<double>, pheno_cor double")
    return segments.join(metrics(fitted), list(SEGMENT), "left").fillna(0, ["pheno_nobs", "pheno_cor", "peak_evi", "peak_doy", "spring_doy", "autumn_doy"])


def metrics(fitted: DataFrame) -> DataFrame:
    """Peak, spring and autumn of the column ``spline_evi``."""
    peak = argmax(F.col("spline_evi")).cast("int")
    df = fitted.withColumns({"peak_doy": peak, "peak_evi": F.array_max("spline_evi").cast("float")})
    rise, fall = F.slice("spline_evi", F.lit(1), F.col("peak_doy") + 1), F.expr("slice(spline_evi, peak_doy + 2, 366)")
    return df.withColumns({"spring_doy": F.coalesce(halfmax(rise) + 1, F.lit(0)).cast("int"), "autumn_doy": F.coalesce(halfmax(fall) + F.col("peak_doy") + 2, F.lit(0)).cast("int"), "pheno_cor": F.col("pheno_cor").cast("float")})
