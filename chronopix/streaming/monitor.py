"""Watching a stream of observations: daily composites and a stateful change monitor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.shipping import ship_package


def composites(obs: DataFrame, bands: list[str], time: str = "ts", late: str = "3 days", every: str = "1 day") -> DataFrame:
    """Means per pixel and window of event time; observations later than ``late`` are left out."""
    return obs.withWatermark(time, late).groupBy("py", "px", F.window(time, every)).agg(*(F.avg(b).alias(b) for b in bands), F.count("*").alias("n")).select("py", "px", F.col("window.start").alias(time), *bands, "n")


def monitor(obs: DataFrame, band: str, threshold: float = 3.0, consecutive: int = 3, training: int = 16, min_rmse: float = 1e-6, order: str = "ordinal") -> DataFrame:
    """A row for each change: py, px, start, end, change, magnitude.

    State per pixel: the training values while they are gathered, then a line's
    coefficients and error and the far scores in a row.  It is a few hundred bytes
    and does not grow.  Observations of a pixel are taken in the order of ``order``
    within each batch; those that arrive in a later batch but are older than the
    last one seen are passed over.
    """
    ship_package(obs.sparkSession)
    state = "start int, last int, xs array<double>, ys array<double>, a double, b double, rmse double, far array<double>, far_at int"
    schema = "py int, px int, start int, end int, change int, magnitude double"

    def step(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        start, last, xs, ys, a, b, err, far, far_at = held.get if held.exists else (0, 0, [], [], 0.0, 0.0, -1.0, [], 0)
        xs, ys, far = list(xs), list(ys), list(far)
        rows = pd.concat(list(batches)).sort_values([order, band])
        out = []
        for at, y in zip(rows[order].tolist(), rows[band].tolist(), strict=True):
            if at <= last and last:
                continue
            if err < 0:
                start = start or at
                xs.append(float(at - start))
                ys.append(float(y))
                if len(xs) == training:
                    x, v = np.array(xs), np.array(ys)
                    b = float(((x - x.mean()) * (v - v.mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-12))
                    a = float(v.mean() - b * x.mean())
                    err = max(min_rmse, float(np.sqrt(((v - a - b * x) ** 2).mean())))
                    xs, ys, far = [], [], []
                last = at
                continue
            score = (y - a - b * (at - start)) / err
            if abs(score) > threshold:
                far_at = far_at if far else at
                far.append(float(score))
            else:
                far = []
            if len(far) == consecutive:
                out.append((key[0], key[1], start, last, far_at, float(np.mean(far))))
                start, xs, ys, err, far = 0, [], [], -1.0, []
            last = at
        held.update((start, last, xs, ys, a, b, err, far, far_at))
        yield pd.DataFrame(out, columns=["py", "px", "start", "end", "change", "magnitude"])

    return obs.groupBy("py", "px").applyInPandasWithState(step, schema, state, "append", "NoTimeout")
