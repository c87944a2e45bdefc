"""The jobs: ingest, segment a stack, look at a pixel, train, classify, map, change map."""

from __future__ import annotations

import logging
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopix.config import Config
from chronopix.functions import columns as C
from chronopix.functions.formula import Design, category_levels, without_categories
from chronopix.operators import changes, classify, incremental, maps, segmentation
from chronopix.operators.phenology import Phenology, long_term_mean
from chronopix.operators.prep import clear_observations, daily_composite
from chronopix.operators.windows import job_rows
from chronopix.sources import files, results

log = logging.getLogger("chronopix")


def ordinal(text: str, fmt: str = "%Y-%m-%d") -> int:
    return datetime.strptime(text, fmt).date().toordinal()


def bands_of(config: Config) -> tuple[list[str], str | None]:
    """(data bands, mask band) by name, from b1 on."""
    n, mask = config.dataset.n_bands, config.dataset.mask_band
    return [f"b{k}" for k in range(1, n + 1) if k != mask], f"b{mask}" if mask else None


def prepare(obs: DataFrame, config: Config) -> DataFrame:
    """Clear observations of a stack: every band in range, the mask band's codes left out."""
    d = config.dataset
    every = [f"b{k}" for k in range(1, d.n_bands + 1)]
    _, mask = bands_of(config)
    return clear_observations(obs, every, d.min_values, d.max_values, mask, d.mask_values)


def segment(obs: DataFrame, config: Config, partitions: int | None = None, composite: bool = False) -> DataFrame:
    """Segments of every pixel, with refits and phenology as configured."""
    bands, _ = bands_of(config)
    rows = prepare(obs, config)
    if composite:
        rows = daily_composite(rows, bands)
    parameters = config.parameters | {"estimator": config.estimator}
    refits = [{"prefix": r.prefix, "model": r.prediction, "keep_regularized": r.stay_regularized} for r in config.refits]
    out = segmentation.segment_pixels(rows, bands, config.design_matrix, parameters, _algorithm(config.algorithm), config.reverse, config.commission_alpha, refits, 0, partitions)
    if config.phenology.get("enable"):
        init = dict(config.phenology.get("init") or {})
        names = {k.replace("_index", ""): bands[v] for k, v in init.items() if k in ("red_index", "nir_index", "blue_index") and v is not None}
        more = {k: v for k, v in init.items() if k in ("scale", "evi_scale", "year_interval", "q_min", "q_max")}
        if init.get("evi_index") is not None:
            more["evi_band"] = bands[init["evi_index"]]
        out = long_term_mean(rows, out, Phenology(**names, **more))
    return out


def _algorithm(name: str) -> str:
    return "ccdc" if name.lower().startswith("ccdc") else name


def line(spark: SparkSession, obs: DataFrame, config: Config, path: str, job: int = 0, jobs: int = 1, resume: bool = False) -> None:
    """Segments of one job's raster rows, written under ``path``; rows that are done are left out if resuming."""
    readable, writable = files.access(spark, path)
    if not (readable and writable):
        raise PermissionError(f"{path} cannot be {'written' if readable else 'read'}")
    log.info("segments of job %d of %d go to %s", job + 1, jobs, path)
    mine = job_rows(obs, job, jobs) if jobs > 1 else obs
    done = results.finished_rows(spark, path) if resume else None
    if done is not None:
        mine = incremental.unfinished(mine, done, "py")
    levels = category_levels(obs, config.design_matrix)
    names = Design(config.design_matrix, levels, columns=False).names
    bands, _ = bands_of(config)
    note = {"design": {n: i for i, n in enumerate(names)}, "design_matrix": config.design_matrix, "n_bands": len(bands), "test_indices": config.parameters.get("test_indices"), "prefixes": [r.prefix for r in config.refits]}
    results.write_segments(segment(mine, config), path, note, mode="append" if resume or jobs > 1 else "errorifexists")


def pixel(obs: DataFrame, config: Config, py: int, px: int) -> tuple[DataFrame, DataFrame]:
    """(segments, fitted curves by day and band) of one pixel."""
    own = obs.where((F.col("py") == py) & (F.col("px") == px))
    found = segment(own, config, partitions=1)
    return found, fitted_curves(found, config.design_matrix)


def fitted_curves(segments: DataFrame, formula: str, centre: int = 0) -> DataFrame:
    """py, px, seg_id, ordinal, fitted (array by band) for every day of each segment but its last."""
    design = Design(without_categories(formula))
    n = len(design.names)
    days = segments.where("end > start").withColumn("ordinal", F.explode(F.sequence("start", F.col("end") - 1))).withColumn("x", F.col("ordinal") - centre)
    x = design.array()
    bands = F.sequence(F.lit(1), F.size(F.element_at("coef", 1)))
    value = lambda b: F.aggregate(F.zip_with(F.slice("coef", 1, n), F.col("_x"), lambda r, v: F.element_at(r, b).cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    return days.withColumn("_x", x).select("py", "px", "seg_id", "ordinal", F.transform(bands, value).alias("fitted"))


def seasonal(obs: DataFrame, config: Config, py: int, px: int) -> DataFrame:
    """ordinal, year, doy, season and data bands of one pixel's clear observations, to be drawn by date or by day of year."""
    own = prepare(obs.where((F.col("py") == py) & (F.col("px") == px)), config)
    year, doy = C.year_and_doy(F.col("ordinal"))
    return own.select("ordinal", year.alias("year"), doy.alias("doy"), C.season(F.col("ordinal")).alias("season"), *bands_of(config)[0])


def training_rows(labels: DataFrame, segments: DataFrame, config: Config, slope: int | None = 1, cache: str | None = None, newest: int | None = None) -> DataFrame:
    """The training table of labelled pixels; with ``cache`` kept there, and read again unless something is ``newest`` (milliseconds) after it was written."""
    spark = labels.sparkSession
    if cache:
        files.recover(spark, cache)
        written = files.modified(spark, cache)
        if written is not None and (newest is None or newest <= written):
            log.info("training rows of %s", cache)
            return spark.read.parquet(cache)
    c = config.classification
    fmt = c.get("training_date_format", "%Y-%m-%d")
    table = classify.training_table(labels, segments, ordinal(c["training_start"], fmt), ordinal(c["training_end"], fmt), c.get("roi_mask_values"), slope)
    if not cache:
        return table
    table.write.mode("overwrite").parquet(f"{cache}-new")
    files.replace(spark, cache)
    return spark.read.parquet(cache)


def train(labels: DataFrame, segments: DataFrame, config: Config, forest: dict, slope: int | None = 1, path: str | None = None, overwrite: bool = False, cache: str | None = None, newest: int | None = None):
    """The classifier of labelled pixels; saved under ``path`` (an existing one only with ``overwrite``)."""
    table = training_rows(labels, segments, config, slope, cache, newest)
    model = classify.train(table, forest)
    if path:
        writer = model.write()
        (writer.overwrite() if overwrite else writer).save(path)
        log.info("classifier saved to %s", path)
    return model


def classify_result(spark: SparkSession, path: str, model, resume: bool = False) -> None:
    """Adds class and class_proba to a result; with ``resume`` only to segments that have none.

    A file that cannot be read ends the job: the old files go once the new ones are written, so what was passed over would be lost.
    """
    found = results.read_segments(spark, path, skip_corrupt=False, merge=resume)
    slope = results.read_metadata(spark, path)["design"].get("x")
    done = found.where("class is not null") if resume and "class" in found.columns else None
    if done is not None:
        found = found.where("class is null")
        if found.isEmpty():
            log.info("all segments of %s have a class", path)
            return
    classed = classify.classify(found, model, slope)
    results.replace_segments(classed if done is None else done.unionByName(classed), path)
    log.info("classes added to %s", path)


def map_at(spark: SparkSession, kind: str, day: date | str | int, path: str, grid: DataFrame, **options) -> DataFrame:
    """A map of a result at a date; kind: coef, predict, class or pheno."""
    day = ordinal(day) if isinstance(day, str) else day.toordinal() if isinstance(day, date) else int(day)
    found = results.read_segments(spark, path)
    if kind == "class":
        return maps.class_map(found, grid, day, **options)
    if kind == "pheno":
        return maps.phenology_map(found, grid, day, **options)
    note = results.read_metadata(spark, path, ("design", "design_matrix", "n_bands"))
    prefix = options.pop("prefix", "")
    prefix = f"{prefix}_" if prefix and not prefix.endswith("_") else prefix
    if kind == "coef":
        return maps.coefficient_map(found, grid, day, sorted(note["design"], key=note["design"].get), note["n_bands"], prefix=prefix, **options)
    if kind == "predict":
        return maps.prediction_map(found, grid, day, note["design_matrix"], note["n_bands"], prefix=prefix, **options)
    raise ValueError(f"unknown map {kind!r}")


def change_map(spark: SparkSession, kind: str, start: str | int, end: str | int, path: str, grid: DataFrame, magnitude: bool = False, **options) -> DataFrame:
    """A change map of a result; kind: first, last or num."""
    start, end = (ordinal(d) if isinstance(d, str) else d for d in (start, end))
    found = results.read_segments(spark, path)
    if kind == "num":
        return changes.change_count_map(found, grid, start, end, **options)
    if kind not in ("first", "last"):
        raise ValueError(f"unknown change map {kind!r}")
    note = results.read_metadata(spark, path, ())
    bands = changes.magnitude_bands(found, note.get("n_bands", 0), note.get("test_indices")) if magnitude else None
    return changes.change_date_map(found, grid, start, end, kind == "first", magnitude=bands, **options)
