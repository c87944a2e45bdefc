"""Image catalogues: from CSV files, from folders of images, and back to CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopix.functions.columns import format_ordinal, parent_folder, parse_ordinal


def read_catalog(spark: SparkSession, path: str, date_format: str = "%Y%j", warn=None) -> DataFrame:
    """A CSV of acquisitions with ``ordinal``, ``date``, ``image_id`` and ``x`` added; other columns stay.

    The first column with "date" in its name holds the dates (KeyError without one;
    ``warn`` is called if there are several).  Rows keep the file's order only as far as Spark does.
    """
    df = spark.read.csv(path, header=True)
    dates = [c for c in df.columns if "date" in c.lower()]
    if not dates:
        raise KeyError(f"no date column among {df.columns}")
    if len(dates) > 1 and warn:
        warn(f"several date columns, using {dates[0]!r}")
    df = df.withColumn("ordinal", parse_ordinal(F.col(dates[0]).cast("string"), date_format))
    if "filename" in df.columns:
        df = df.withColumn("image_id", parent_folder(F.col("filename")))
    return df.withColumns({"x": F.col("ordinal"), "date": F.date_from_unix_date((F.col("ordinal") - 719163).cast("int"))})


def find_images(spark: SparkSession, root: str, folder_pattern: str = "L*", image_pattern: str = "L*stack", date_start: int = 9, date_end: int = 16, date_format: str = "%Y%j", ignore: tuple[str, ...] = ()) -> DataFrame:
    """ordinal, image_id, filename of images in the folders below ``root``, by date and name.

    Files are listed by Spark's reader without their contents, so any Hadoop path
    will do.  Raises ValueError if there are none, or not one per folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", image_pattern).load(f"{root.rstrip('/')}/{folder_pattern}").select(F.col("path").alias("filename"))
    for name in ignore:
        files = files.where(~F.col("filename").contains(f"/{name}/"))
    found = files.withColumn("image_id", parent_folder(F.col("filename"))).withColumn("ordinal", parse_ordinal(F.substring("image_id", date_start + 1, date_end - date_start), date_format))
    n, folders = found.agg(F.count("*"), F.countDistinct("image_id")).first()
    if not n:
        raise ValueError(f"no images below {root}")
    if n != folders:
        raise ValueError(f"{n} images in {folders} folders")
    return found.select("ordinal", "image_id", "filename").orderBy("ordinal", "filename")


def write_catalog(catalog: DataFrame, path: str, sensor_offset: int = 0) -> None:
    """date (year and day), sensor (three letters of the image id), filename, sorted, as one CSV with a header."""
    rows = catalog.select(format_ordinal(F.col("ordinal")).alias("date"), F.substring("image_id", sensor_offset + 1, 3).alias("sensor"), "filename")
    rows.orderBy("date", "sensor", "filename").coalesce(1).write.mode("overwrite").csv(path, header=True)
