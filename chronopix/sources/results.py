"""Segment results on disk: Parquet by row bucket with a sidecar of metadata, and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from chronopix import __version__
from chronopix.sources import files, raster


def write_segments(segments: DataFrame, path: str, metadata: dict, rows_per_bucket: int = 64, mode: str = "errorifexists") -> None:
    """Segments under ``path``/segments, partitioned by ``py_bucket``; metadata (design, bands, ...) under ``path``/metadata."""
    raster.by_bucket(segments, rows_per_bucket).sortWithinPartitions("py_bucket", "py", "px", "seg_id").write.partitionBy("py_bucket").mode(mode).parquet(f"{path}/segments")
    note = [(json.dumps(metadata | {"version": __version__, "rows_per_bucket": rows_per_bucket}),)]
    segments.sparkSession.createDataFrame(note, "json string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_segments(spark: SparkSession, path: str, skip_corrupt: bool = False, merge: bool = False) -> DataFrame:
    """Segments of a result; only if wanted, unreadable files are passed over (the reader warns of each).

    With ``merge`` the columns are those of all files (a job that was resumed adds files without classes).
    """
    files.recover(spark, f"{path}/segments")
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("mergeSchema", str(merge).lower())
    return reader.parquet(f"{path}/segments")


def read_metadata(spark: SparkSession, path: str, needed: tuple[str, ...] = ("design",)) -> dict:
    out = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
    for key in needed:
        if key not in out:
            raise KeyError(f"the result's metadata has no {key!r}")
    return out


def replace_segments(segments: DataFrame, path: str, rows_per_bucket: int = 64) -> None:
    """New columns for a result: written beside it, then moved into its place (never over what is being read)."""
    spark = segments.sparkSession
    raster.by_bucket(segments.drop("py_bucket"), rows_per_bucket).sortWithinPartitions("py_bucket", "py", "px", "seg_id").write.partitionBy("py_bucket").mode("overwrite").parquet(f"{path}/segments-new")
    files.replace(spark, f"{path}/segments")


def write_map(values: DataFrame, path: str, georeference: dict | None = None, fmt: str = "parquet") -> None:
    """A map, with its projection and transform as a sidecar."""
    writer = values.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    if georeference:
        values.sparkSession.createDataFrame([(json.dumps(georeference),)], "json string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}.georeference")


def finished_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The raster rows that a result already has, or None if there is none."""
    files.recover(spark, f"{path}/segments")
    if not files.exists(spark, f"{path}/segments"):
        return None
    return read_segments(spark, path).select("py").distinct()
