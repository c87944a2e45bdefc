"""The jobs from a shell: ``python -m chronopix COMMAND ...`` (or through ``spark-submit``).

Paths may be of any file system that Spark reads; only the configuration and raw
rasters are opened by Python, as local files or URIs.  Days are written as
``--date-format`` says, job numbers count from 1.

Other packages add commands by an entry point of the group ``chronopix.commands``:
a function that is given the sub-parsers, adds its own and sets ``run``, a function
of the session and the arguments, as a default there.
"""

from __future__ import annotations

import argparse
import logging
from datetime import datetime
from importlib.metadata import entry_points

import yaml
from pyspark.sql import DataFrame, SparkSession

from chronopix import __version__
from chronopix.config import Config, load, override, parse
from chronopix.operators import classify, incremental
from chronopix.plans import jobs
from chronopix.sources import catalog as catalogs
from chronopix.sources import files, raster, results

log = logging.getLogger("chronopix")


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError(f"{text} is not over 0")
    return value


def setting(text: str) -> tuple[str, object]:
    """``key=value``; the value is read as YAML, so numbers and lists come out as such."""
    key, mark, value = text.partition("=")
    if not mark or not key:
        raise argparse.ArgumentTypeError(f"{text!r} is not key=value")
    return key, yaml.safe_load(value)


def band_list(text: str) -> str | list[int]:
    return "all" if text == "all" else [positive(b) for b in text.split(",")]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronopix", description="Analysis of pixel time series on Spark")
    top.add_argument("--version", action="version", version=__version__)
    told = top.add_mutually_exclusive_group()
    told.add_argument("-v", "--verbose", action="store_true", help="tell every step")
    told.add_argument("-q", "--quiet", action="store_true", help="tell errors only")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=about, description=about)

    c = command("catalog", "List the images below a folder as a CSV of date, sensor and file")
    c.add_argument("root")
    c.add_argument("output")
    c.add_argument("--folders", default="L*")
    c.add_argument("--images", default="L*stack")
    c.add_argument("--date-offset", type=int, default=9)
    c.add_argument("--sensor-offset", type=int, default=0)

    c = command("cache", "Write raw rasters as an archive in time-series order, or a new archive from an old one")
    c.add_argument("config")
    c.add_argument("archive")
    for name in ("--nrow", "--ncol"):
        c.add_argument(name, type=positive, help="by default what the images' headers say")
    c.add_argument("--dtype", default="int16", help="of images without a header")
    kept = c.add_mutually_exclusive_group()
    kept.add_argument("--update", metavar="OLD", help="take the images that this archive has from there")
    kept.add_argument("--keep", action="store_true", help="bring an archive that is there up to date, or leave it if it holds just these images")

    c = command("line", "Segment the pixels of an archive, all or one job's rows")
    c.add_argument("config")
    c.add_argument("archive")
    c.add_argument("result")
    c.add_argument("--job", type=positive, default=1)
    c.add_argument("--jobs", type=positive, default=1)
    c.add_argument("--resume", action="store_true")

    c = command("pixel", "Segments of one pixel, printed; fitted curves to a folder")
    c.add_argument("config")
    c.add_argument("archive")
    c.add_argument("py", type=int)
    c.add_argument("px", type=int)
    c.add_argument("--set", type=setting, action="append", default=[], metavar="KEY=VALUE", help="change a key of the configuration, at any depth")
    c.add_argument("--curves", metavar="FOLDER")
    c.add_argument("--observations", metavar="FOLDER", help="clear observations with year, day of year and season")

    c = command("train", "Fit a classifier on labelled pixels and save it")
    c.add_argument("config")
    c.add_argument("forest", help="YAML of the classifier")
    c.add_argument("labels", help="Parquet of py, px, label")
    c.add_argument("result")
    c.add_argument("model")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--cache", metavar="FOLDER", help="keep the training rows there, and use them again while labels and result are older")
    c.add_argument("--diagnose", metavar="FOLDER", help="write accuracies over folds and feature importances there")
    c.add_argument("--folds", type=positive, default=3)

    c = command("classify", "Add classes to a result")
    c.add_argument("model")
    c.add_argument("result")
    c.add_argument("--resume", action="store_true")

    c = command("map", "A map of a result at a day")
    c.add_argument("kind", choices=("coef", "predict", "class", "pheno"))
    c.add_argument("day")
    c.add_argument("--bands", type=band_list)
    c.add_argument("--coefs", type=lambda t: tuple(t.split(",")))
    c.add_argument("--prefix")
    for name in ("--after", "--before", "--qa", "--amplitude", "--proba"):
        c.add_argument(name, action="store_true")

    d = command("changemap", "A map of the changes between two days")
    d.add_argument("kind", choices=("first", "last", "num"))
    d.add_argument("start")
    d.add_argument("end")
    d.add_argument("--magnitude", action="store_true")
    d.add_argument("--out-format", help="strftime of the change dates, or ordinal")
    for x in (c, d):
        x.add_argument("result")
        x.add_argument("grid", help="Parquet with py and px, an archive for one")
        x.add_argument("output")
        x.add_argument("--date-format", default="%Y-%m-%d")
        x.add_argument("--ndv", type=float)
        x.add_argument("--format", choices=("parquet", "csv", "envi"), default="parquet")
        x.add_argument("--like", metavar="RASTER", help="envi: the raster whose size and georeference the map gets")
    for plugin in entry_points(group="chronopix.commands"):
        try:
            plugin.load()(commands)
        except Exception as e:  # another package's fault must not take the commands away
            log.warning("command %s is left out: %s", plugin.name, e)
    return top


def _grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("py", "px").distinct()


def _given(**options) -> dict:
    """What was given on the command line; the rest keeps the operator's default."""
    return {k: v for k, v in options.items() if v is not None and v is not False}


def _number(value: float | None) -> float | int | None:
    return int(value) if value is not None and value == int(value) else value


def cache(spark: SparkSession, config: Config, archive: str, nrow: int | None, ncol: int | None, dtype: str, old: str | None = None, keep: bool = False) -> None:
    """The archive of the catalogue's images; with ``old`` or ``keep``, only images that the old or present one lacks are read from their files."""
    if not config.dataset.input_file:
        raise KeyError("dataset.input_file is needed")
    images = catalogs.read_catalog(spark, config.dataset.input_file, config.dataset.date_format)

    def source(wanted: DataFrame) -> DataFrame:
        paths = [r["filename"] for r in wanted.select("filename").distinct().toLocalIterator()]  # one name an image, as the catalogue
        log.info("%d images are read", len(paths))
        if nrow and ncol:
            fresh = raster.read_bip(spark, paths, nrow, ncol, config.dataset.n_bands, dtype)
        else:
            fresh = raster.read_envi(spark, paths)
        return fresh.join(wanted, "filename")

    if keep:
        raster.read_through(spark, images, source, archive)
        return
    if not old:
        raster.layout(source(images), archive)
        return
    had = spark.read.parquet(old).drop("py_bucket")
    wanted = incremental.missing(images, had)
    kept = incremental.retained(had, images)
    raster.layout(kept if wanted.isEmpty() else kept.unionByName(source(wanted)), archive)


def write_map(values: DataFrame, a: argparse.Namespace) -> None:
    if a.format != "envi":
        results.write_map(values, a.output, fmt=a.format)
        return
    if not a.like:
        raise ValueError("--format envi needs --like")
    h = raster.read_header(a.like)
    bands = [c for c in values.columns if c not in ("py", "px")]
    raster.write_raster(values, a.output, bands, h["nrow"], h["ncol"], -9999 if a.ndv is None else a.ndv, georeference=h["georeference"])


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if getattr(a, "run", None):  # a command of another package
        a.run(spark, a)
    elif a.command == "catalog":
        found = catalogs.find_images(spark, a.root, a.folders, a.images, a.date_offset, a.date_offset + 7)
        catalogs.write_catalog(found, a.output, a.sensor_offset)
    elif a.command == "cache":
        cache(spark, load(a.config), a.archive, a.nrow, a.ncol, a.dtype, a.update, a.keep)
    elif a.command == "line":
        if a.job > a.jobs:
            raise ValueError(f"no job {a.job} of {a.jobs}")
        jobs.line(spark, spark.read.parquet(a.archive), load(a.config), a.result, a.job - 1, a.jobs, a.resume)
    elif a.command == "pixel":
        with open(a.config) as f:
            config = parse(override(yaml.safe_load(f), dict(a.set)))
        obs = spark.read.parquet(a.archive)
        found, curves = jobs.pixel(obs, config, a.py, a.px)
        found.orderBy("seg_id").show(truncate=False)
        if a.curves:
            results.write_map(curves, a.curves)
        if a.observations:
            results.write_map(jobs.seasonal(obs, config, a.py, a.px), a.observations)
    elif a.command == "train":
        with open(a.forest) as f:
            forest = yaml.safe_load(f)
        note, config = results.read_metadata(spark, a.result), load(a.config)
        slope, labels, found = note["design"].get("x"), spark.read.parquet(a.labels), results.read_segments(spark, a.result)
        newest = max(filter(None, (files.modified(spark, p) for p in (a.labels, f"{a.result}/segments"))), default=None)
        model = jobs.train(labels, found, config, forest, slope, a.model, a.overwrite, a.cache, newest)
        if a.diagnose:
            table = jobs.training_rows(labels, found, config, slope, a.cache, newest)
            results.write_map(classify.diagnostics(table, forest, a.folds), f"{a.diagnose}/scores")
            names = sorted(note["design"], key=note["design"].get)
            results.write_map(classify.importances(model, classify.feature_names(names, note["n_bands"])), f"{a.diagnose}/importances")
    elif a.command == "classify":
        from pyspark.ml.classification import RandomForestClassificationModel

        jobs.classify_result(spark, a.result, RandomForestClassificationModel.load(a.model), a.resume)
    elif a.command == "map":
        options = _given(bands=a.bands, coefs=a.coefs, prefix=a.prefix, after=a.after, before=a.before, qa=a.qa, amplitude=a.amplitude, proba=a.proba, ndv=_number(a.ndv))
        day = datetime.strptime(a.day, a.date_format).date()
        write_map(jobs.map_at(spark, a.kind, day, a.result, _grid(spark, a.grid), **options), a)
    elif a.command == "changemap":
        start, end = (jobs.ordinal(d, a.date_format) for d in (a.start, a.end))
        options = _given(magnitude=a.magnitude, out_format=a.out_format, ndv=_number(a.ndv))
        write_map(jobs.change_map(spark, a.kind, start, end, a.result, _grid(spark, a.grid), **options), a)


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    log.setLevel(logging.DEBUG if given.verbose else logging.ERROR if given.quiet else logging.INFO)
    spark = SparkSession.builder.appName("chronopix").getOrCreate()
    run(spark, given)


if __name__ == "__main__":
    main()
