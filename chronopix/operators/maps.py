"""Point-in-time queries over segments: which segment holds at a date, and maps from it.

All native: one filter that reaches the scan, one aggregation per pixel with
map-side combining, one left join with the output grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopix.functions.columns import amplitude_name, dot
from chronopix.functions.formula import Design, select_bands, select_features, without_categories
from chronopix.operators.prep import PIXEL

BEFORE, AFTER, INTERSECT = 1, 2, 3


def candidates(segments: DataFrame, day: int, after: bool = False, before: bool = False) -> DataFrame:
    """Segments that may stand for a date, with ``qa``: 3 holds it, 2 begins after it, 1 ended before it without a change."""
    qa = F.when((F.col("start") <= day) & (F.col("end") >= day), INTERSECT)
    wanted = (F.col("start") <= day) & (F.col("end") >= day)
    if after:
        qa, wanted = qa.when(F.col("start") >= day, AFTER), wanted | (F.col("start") >= day)
    if before:
        ended = (F.col("end") <= day) & (F.col("break") == 0)
        qa, wanted = qa.when(ended, BEFORE), wanted | ended
    return segments.where(wanted).withColumn("qa", qa)


def at_date(segments: DataFrame, day: int, after: bool = False, before: bool = False) -> DataFrame:
    """One segment per pixel for a date.

    The best qa wins; of several, the last segment, but the first of those after the date.
    """
    found = candidates(segments, day, after, before)
    place = F.struct("qa", F.when(F.col("qa") == AFTER, -F.col("seg_id")).otherwise(F.col("seg_id")).alias("place"))
    rest = [c for c in found.columns if c not in PIXEL]
    best = found.groupBy(*PIXEL).agg(F.max_by(F.struct(*rest), place).alias("best"))
    return best.select(*PIXEL, *(F.col("best")[c].alias(c) for c in rest))


def on_grid(values: DataFrame, grid: DataFrame, ndv: float | int, **other) -> DataFrame:
    """Values for every pixel of the grid; ``ndv``, or that of the column among ``other``, where there are none (or null)."""
    joined = grid.select(*PIXEL).join(values, list(PIXEL), "left")
    kinds = dict(values.dtypes)
    fill = lambda c: F.coalesce(F.col(c), F.lit(other.get(c, ndv)).cast(kinds[c])).alias(c)
    return joined.select(*PIXEL, *(fill(c) for c in values.columns if c not in PIXEL))


def recentred(coef: Column, slope: int | None) -> Column:
    """The coefficient matrix with its intercepts moved to the middle of the segment."""
    if slope is None:
        return coef
    middle = (F.col("start") + F.col("end")) / F.lit(2.0)
    first = F.zip_with(F.element_at(coef, 1), F.element_at(coef, slope + 1), lambda a, b: a + b * middle)
    return F.concat(F.array(first), F.slice(coef, F.lit(2), F.size(coef)))


def coefficient_map(segments: DataFrame, grid: DataFrame, day: int, names: list[str], n_bands: int, bands="all", coefs: tuple[str, ...] = ("all",), prefix: str = "", amplitude: bool = False, with_rmse: bool = True, qa: bool = True, after: bool = False, before: bool = False, ndv: float = -9999.0, centre: int = 0) -> DataFrame:
    """Coefficients at a date as columns B<band>_<name>, then B<band>_RMSE, then SegmentQAQC.

    ``amplitude`` replaces each harmonic's cosine by its amplitude and leaves the sine out.
    ``centre`` is what was taken from the ordinals when the segments were fitted.
    """
    picked = at_date(segments, day, after, before)
    index = {n: i for i, n in enumerate(names)}
    chosen = sorted({i for c in coefs for i in select_features(names, c)})
    chosen_bands = select_bands(bands, n_bands)
    slope = index.get("x")
    middle = picked.withColumns({"start": F.col("start") - centre, "end": F.col("end") - centre}) if centre else picked
    matrix = middle.withColumn("_c", recentred(F.col(f"{prefix}coef"), slope))
    value = lambda i, b: F.element_at(F.element_at(F.col("_c"), i + 1), b + 1)
    out = []
    for i in chosen:
        name = names[i]
        if amplitude and name.startswith("harm") and name.endswith("[1]"):
            continue
        for b in chosen_bands:
            if amplitude and (label := amplitude_name(name)):
                sine = index[name.replace("[0]", "[1]")]
                out.append(F.sqrt(value(i, b) * value(i, b) + value(sine, b) * value(sine, b)).alias(f"B{b + 1}_{label.replace(' ', '')}"))
            else:
                out.append(value(i, b).alias(f"B{b + 1}_{name.replace(' ', '')}"))
    if with_rmse:
        out += [F.element_at(F.col(f"{prefix}rmse"), b + 1).alias(f"B{b + 1}_RMSE") for b in chosen_bands]
    if qa:
        out.append(F.col("qa").alias("SegmentQAQC"))
    return on_grid(matrix.select(*PIXEL, *out), grid, ndv, SegmentQAQC=0)


def prediction_map(segments: DataFrame, grid: DataFrame, day: int, formula: str, n_bands: int, bands="all", prefix: str = "", qa: bool = False, after: bool = False, before: bool = False, ndv: int = -9999, centre: int = 0) -> DataFrame:
    """The models' values at a date, as 16-bit integers (beyond them ``ndv``); categorical terms are left out."""
    picked = at_date(segments, day, after, before)
    vector = Design(without_categories(formula), columns=False).vector(day - centre)
    names = Design(without_categories(formula), columns=False).names
    x = F.array(*map(F.lit, vector))
    rows = F.slice(F.col(f"{prefix}coef"), 1, len(names))
    value = lambda b: dot(F.transform(rows, lambda r: F.element_at(r, b + 1)), x).try_cast("int").try_cast("smallint")
    out = [value(b).alias(f"Band_{b}") for b in select_bands(bands, n_bands)]
    if qa:
        out.append(F.col("qa").cast("smallint").alias("SegmentQAQC"))
    return on_grid(picked.select(*PIXEL, *out), grid, ndv)


def class_map(segments: DataFrame, grid: DataFrame, day: int, proba: bool = False, qa: bool = False, after: bool = False, before: bool = False, ndv: int = 0) -> DataFrame:
    """The class at a date, optionally its probability times 10000."""
    if "class" not in segments.columns or (proba and "class_proba" not in segments.columns):
        raise ValueError("the segments are not classified, or without probabilities")
    out = [F.col("class").cast("int").alias("Classification")]
    if proba:
        out.append((F.array_max("class_proba") * 10000).cast("int").alias("PredProba_x10000"))
    if qa:
        out.append(F.col("qa").cast("int").alias("SegmentQAQC"))
    return on_grid(at_date(segments, day, after, before).select(*PIXEL, *out), grid, ndv)


def phenology_map(segments: DataFrame, grid: DataFrame, day: int, qa: bool = False, after: bool = False, before: bool = False, ndv: int = -9999) -> DataFrame:
    """Seven phenology bands at a date."""
    needed = ("spring_doy", "autumn_doy", "pheno_cor", "peak_evi", "peak_doy", "pheno_nobs")
    if any(c not in segments.columns for c in needed):
        raise ValueError("the segments have no phenology")
    out = [
        F.col("spring_doy").cast("int").alias("SpringDOY"), F.col("autumn_doy").cast("int").alias("AutumnDOY"), (F.col("autumn_doy") - F.col("spring_doy")).cast("int").alias("GrowingDOY"), F.col("peak_doy").cast("int").alias("PeakDOY"),
        (F.col("peak_evi") * 10000).cast("int").alias("PeakEVI"), (F.col("pheno_cor") * 10000).cast("int").alias("SplineR"), F.col("pheno_nobs").cast("int").alias("NObs"),
    ]
    if qa:
        out.append(F.col("qa").cast("int").alias("SegmentQAQC"))
    return on_grid(at_date(segments, day, after, before).select(*PIXEL, *out), grid, ndv)


def class_features(segments: DataFrame, slope: int | None = 1, centre: int = 0) -> DataFrame:
    """Adds ``features``: the re-centred coefficients, feature by feature, then the RMSE."""
    shifted = segments.withColumns({"_s": F.col("start"), "_e": F.col("end"), "start": F.col("start") - centre, "end": F.col("end") - centre})
    out = shifted.withColumn("features", F.concat(F.flatten(recentred(F.col("coef"), slope)), F.col("rmse")))
    return out.withColumns({"start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e")
