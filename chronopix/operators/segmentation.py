"""Segmentation of all pixels: a table-valued, per-key stateful operator.

Observations are filtered and composited natively, gathered into one array-valued
row per pixel by a single shuffle, and cross to Python as Arrow batches of many
pixels, so a batch costs one call.  The output schema is known before the job.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.errors import SeriesTooShort, UnknownAlgorithm
from chronopix.functions.ccdc import Ccdc, Segment
from chronopix.functions.formula import Design, category_levels
from chronopix.functions.kernels import estimator
from chronopix.operators.prep import by_pixel, pixel_series
from chronopix.shipping import ship_package

BASE_SCHEMA = "py int, px int, seg_id int, start int, end int, break int, coef array<array<float>>, rmse array<float>, magnitude array<float>"

#: Change algorithms by name: function(**parameters) -> object with fit(x, y, dates) giving segments.
ALGORITHMS: dict[str, Callable] = {"ccdc": Ccdc}


def algorithm(name: str, **parameters):
    """A change algorithm, from the registry or from installed entry points of group ``chronopix.algorithms``."""
    key = name.lower()
    if key not in ALGORITHMS:
        from importlib.metadata import entry_points

        for point in entry_points(group="chronopix.algorithms"):
            if point.name.lower() == key:
                ALGORITHMS[key] = point.load()
        if key not in ALGORITHMS:
            raise UnknownAlgorithm(f"no change algorithm {name!r}")
    return ALGORITHMS[key](**parameters)


def refit(x: np.ndarray, y: np.ndarray, dates: np.ndarray, segments: list[Segment], model, keep_regularized: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coef, rmse) of each segment refitted on its own observations.

    ``keep_regularized`` uses only the features with a coefficient other than 0;
    where there are none, the error stays and the coefficients are 0.
    """
    from chronopix.functions.kernels import fold_intercept, rmse

    out = []
    for s in segments:
        rows = (dates >= min(s.start, s.end)) & (dates <= max(s.start, s.end))
        coef, err = np.zeros_like(s.coef), np.array(s.rmse, float)
        for b in range(len(y)):
            use = np.flatnonzero(s.coef[b]) if keep_regularized else np.arange(x.shape[1])
            if not len(use) or not rows.any():
                continue
            m = model.fresh().fit(x[rows][:, use], y[b, rows])
            coef[b, use] = fold_intercept(m)
            err[b] = rmse(y[b, rows], m.predict(x[rows][:, use]))
        out.append((coef, err))
    return out


def commission(x: np.ndarray, y: np.ndarray, dates: np.ndarray, segments: list[Segment], test: list[int] | None, model, alpha: float = 0.10) -> list[Segment]:
    """Neighbouring segments that a Chow test cannot tell apart become one; chains of them too."""
    from chronopix.functions.kernels import f_tail, fold_intercept, least_squares, rmse

    if len(segments) < 2:
        return list(segments)
    bands = list(test) if test else list(range(len(y)))
    k = x.shape[1]
    rss = lambda rows: float(np.mean([((y[b, rows] - x[rows] @ least_squares(x[rows], y[b, rows])) ** 2).sum() for b in bands]))
    out = [segments[0]]
    for s in segments[1:]:
        last = out[-1]
        first, second = (dates > last.start) & (dates <= last.end), (dates > s.start) & (dates <= s.end)
        both = (dates > last.start) & (dates <= s.end)
        n = int(both.sum())
        if first.sum() <= k or second.sum() <= k or n <= 2 * k:
            out.append(s)
            continue
        a, b, c = rss(both), rss(first), rss(second)
        f = ((a - (b + c)) / k) / ((b + c) / (n - 2 * k)) if b + c > 0 else np.inf
        if f_tail(f, k, n - 2 * k) < alpha:
            out.append(s)
            continue
        merged = Segment(last.start, s.end, s.change, np.zeros_like(s.coef), np.zeros(len(y)), s.magnitude)
        for j in range(len(y)):
            m = model.fresh().fit(x[both], y[j, both])
            merged.coef[j], merged.rmse[j] = fold_intercept(m), rmse(y[j, both], m.predict(x[both]))
        out[-1] = merged
    return out


def omission(x: np.ndarray, y: np.ndarray, dates: np.ndarray, segments: list[Segment], crit: float = 0.05, behavior: str = "ANY", indices: list[int] | None = None, test: list[int] | None = None) -> list[bool]:
    """Whether each segment's OLS residuals drift (CUSUM test), in any or all of its bands."""
    from chronopix.functions.kernels import cusum_ols, least_squares

    if behavior.upper() not in ("ANY", "ALL"):
        raise ValueError(f"behavior must be ANY or ALL, not {behavior!r}")
    bands = list(range(len(y))) if indices is None else list(indices)
    if test is not None and not set(bands) <= set(test):
        raise ValueError("the bands are not among those tested")
    out = []
    for s in segments:
        rows = (dates >= min(s.start, s.end)) & (dates <= max(s.start, s.end))
        if not s.start or not s.end or rows.sum() <= x.shape[1]:
            out.append(False)
            continue
        hits = [cusum_ols(y[b, rows] - x[rows] @ least_squares(x[rows], y[b, rows]), x.shape[1])[1] < crit for b in bands]
        out.append(any(hits) if behavior.upper() == "ANY" else all(hits))
    return out


def segment_pixels(
    obs: DataFrame, bands: list[str], formula: str, parameters: dict | None = None, name: str = "ccdc", reverse: bool = False, commission_alpha: float | None = None,
    refits: list[dict] | None = None, centre: int = 0, partitions: int | None = None, levels: dict[str, list[str]] | None = None, dealt: bool = False, omission_crit: float | None = None,
) -> DataFrame:
    """Segments of every pixel of ``obs`` (py, px, ordinal, bands, and the formula's variables but x).

    ``refits``: dicts with prefix, model (a name) and keep_regularized.  Pixels with
    too short a series give no rows.  ``centre`` is taken from the ordinals before
    the design is computed, which keeps the numbers tame.  ``partitions`` spreads
    the pixels over that many tasks, unless ``dealt`` says that ``by_pixel`` has done so.
    ``omission_crit`` adds ``omission``: whether a segment's residuals drift in any
    test band, so that a change may have been overlooked.
    """
    spark = obs.sparkSession
    ship_package(spark)
    parameters = dict(parameters or {})
    if isinstance(parameters.get("estimator"), str):
        parameters["estimator"] = estimator(parameters["estimator"])
    levels = category_levels(obs, formula) if levels is None else levels
    extra = sorted(levels)
    model = algorithm(name, **parameters)
    refits = [dict(r) for r in refits or []]
    for r in refits:
        r["model"] = estimator(r["model"]) if isinstance(r.get("model", "ols"), str) else r["model"]
    schema = BASE_SCHEMA + "".join(f", {r['prefix']}_coef array<array<float>>, {r['prefix']}_rmse array<float>" for r in refits)
    if omission_crit is not None:
        schema += ", omission boolean"
    obs = obs.select("py", "px", "ordinal", *extra, *bands)
    rows = pixel_series(obs if dealt else by_pixel(obs, partitions), bands, extra).select("py", "px", *(F.col("series")[c].alias(c) for c in ("ordinal", *extra, *bands)))
    columns = [f.strip().split(" ")[0] for f in schema.replace("array<array<float>>", "a").replace("array<float>", "a").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        design = Design(formula, levels, columns=False)
        for batch in batches:
            out = []
            for p in batch.to_dict("records"):
                dates = np.asarray(p["ordinal"])
                step = -1 if reverse else 1
                variables = {"x": (dates - centre)[::step], **{e: np.asarray(p[e])[::step] for e in extra}}
                dates = dates[::step]
                x = design.matrix(variables)
                y = np.array([np.asarray(p[b], float)[::step] for b in bands])
                try:
                    found = copy.copy(model).fit(x, y, dates)
                except SeriesTooShort:
                    continue
                if commission_alpha:
                    found = commission(x, y, dates, found, getattr(model, "test_indices", None), model.estimator, commission_alpha)
                more = [refit(x, y, dates, found, r["model"], r.get("keep_regularized", True)) for r in refits]
                drifts = omission(x, y, dates, found, omission_crit, "ANY", getattr(model, "test_indices", None)) if omission_crit is not None else None
                for k, s in enumerate(found):
                    row = [p["py"], p["px"], k, s.start, s.end, s.change, s.coef.T.astype("f4").tolist(), s.rmse.astype("f4").tolist(), s.magnitude.astype("f4").tolist()]
                    for r in more:
                        row += [r[k][0].T.astype("f4").tolist(), r[k][1].astype("f4").tolist()]
                    out.append(row if drifts is None else [*row, bool(drifts[k])])
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, schema)


def observations_of_segments(obs: DataFrame, segments: DataFrame) -> DataFrame:
    """Observations with the segment they fall in (its dates in either order).

    An equi-join on the pixel with the interval as a residual condition: a pixel has
    few segments, so a sort-merge join touches little more than it returns.
    """
    low, high = F.least("start", "end"), F.greatest("start", "end")
    bounds = segments.select("py", "px", "seg_id", low.alias("_low"), high.alias("_high"))
    return obs.join(bounds, ["py", "px"]).where(F.col("ordinal").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def drifting_segments(obs: DataFrame, segments: DataFrame, bands: list[str], crit: float = 0.05, behavior: str = "ANY", x: str = "x") -> DataFrame:
    """py, px, seg_id, omission: whether the residuals of a line in x drift (CUSUM test) in any or all bands; native.

    Bands become rows, so all of them share one pass over the observations.
    """
    from chronopix.operators.windows import cusum_test, line_residuals

    if behavior.upper() not in ("ANY", "ALL"):
        raise ValueError(f"behavior must be ANY or ALL, not {behavior!r}")
    keys = ("py", "px", "seg_id", "band")
    cells = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands)))
    own = observations_of_segments(obs, segments).select("py", "px", "seg_id", "ordinal", F.col(x).alias("x"), cells.alias("c")).select("py", "px", "seg_id", "ordinal", "x", "c.band", "c.value")
    tested = cusum_test(line_residuals(own, "value", "x", keys), "resid", keys).select(*keys, (F.col("p_value") < crit).alias("hit"))
    how = F.bool_or if behavior.upper() == "ANY" else F.bool_and
    return tested.groupBy("py", "px", "seg_id").agg(how("hit").alias("omission"))


def chow_pairs(obs: DataFrame, segments: DataFrame, value: str, x: str = "x") -> DataFrame:
    """Chow F of each segment and the one before it, for a line in x; native and not chained.

    Regression sums merge, so one aggregation over the joined slices gives all residual sums.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("py", "px").orderBy("seg_id")
    pairs = segments.select("py", "px", "seg_id", F.lag("start").over(w).alias("s1"), F.lag("end").over(w).alias("e1"), F.col("start").alias("s2"), F.col("end").alias("e2")).where("s1 is not null")
    o = obs.select("py", "px", "ordinal", F.col(value).alias("_y"), F.col(x).alias("_x"))
    j = o.join(pairs, ["py", "px"]).where((F.col("ordinal") > F.col("s1")) & (F.col("ordinal") <= F.col("e2")))
    part = lambda cond: (F.when(cond, F.col("_y")), F.when(cond, F.col("_x")))
    rss = lambda y, xx: F.greatest(F.lit(0.0), F.regr_syy(y, xx) - F.pow(F.regr_sxy(y, xx), F.lit(2.0)) / F.regr_sxx(y, xx))
    one, two = part(F.col("ordinal") <= F.col("e1")), part(F.col("ordinal") > F.col("s2"))
    g = j.groupBy("py", "px", "seg_id").agg(F.count("*").alias("n"), F.count(one[0]).alias("n1"), F.count(two[0]).alias("n2"), rss(F.col("_y"), F.col("_x")).alias("rss"), rss(*one).alias("rss1"), rss(*two).alias("rss2"))
    f = ((F.col("rss") - F.col("rss1") - F.col("rss2")) / 2) / ((F.col("rss1") + F.col("rss2")) / (F.col("n") - 4))
    return g.where((F.col("n1") > 2) & (F.col("n2") > 2)).withColumn("f", f)
