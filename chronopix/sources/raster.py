"""Raw rasters as a Python data source, ENVI headers, raster output, and the archive's Parquet layout.

Format ``bip``: raw files of rows, columns and bands, whatever their interleave.
One partition per file and run of rows; a reader seeks to its rows and never
holds more than a run of them.  Paths are local or URIs that Arrow's file systems
know; on a cluster every executor must be able to open them.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronopix.sources import files

_KINDS = {"int16": "smallint", "uint16": "int", "int32": "int", "uint8": "smallint", "float32": "float", "float64": "double"}
#: Codes of the data types in ENVI headers.
_ENVI_TYPES = {1: "uint8", 2: "int16", 3: "int32", 4: "float32", 5: "float64", 12: "uint16"}
#: Values that a reader holds at most, but for one row of pixels.
_HELD = 1 << 20


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class BipSource(DataSource):
    """Options: paths (one a line), ncol, nrow, nband, dtype (int16), interleave (bip, bil or bsq), offset (bytes before the data), order (< or >), headers (true: each file's header must say the same), rows_per_partition (64), rows (first:last)."""

    @classmethod
    def name(cls) -> str:
        return "bip"

    def schema(self) -> str:
        kind = _KINDS[self.options.get("dtype", "int16")]
        return "filename string, py int, px int, " + ", ".join(f"b{k + 1} {kind}" for k in range(int(self.options["nband"])))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.o, self.names = dict(options), schema.names

    def partitions(self):
        step = int(self.o.get("rows_per_partition", 64))
        first, _, last = self.o.get("rows", f"0:{self.o['nrow']}").partition(":")
        out = []
        for path in filter(None, (p.strip() for p in self.o["paths"].split("\n"))):
            out += [_Rows(path, at, min(at + step, int(last))) for at in range(int(first), int(last), step)]
        return out

    def read(self, part):
        ncol, nband = int(self.o["ncol"]), int(self.o["nband"])
        if self.o.get("headers") == "true":
            own, told = read_header(part.path), (int(self.o["nrow"]), ncol, nband)
            if (own["nrow"], own["ncol"], own["nband"]) != told:
                raise OSError(f"{part.path} is not of {told[0]} rows, {told[1]} columns and {told[2]} bands")
        run = max(1, _HELD // (ncol * nband))
        with files.open_input(part.path) as f:
            for first in range(part.first, part.last, run):
                data = self._values(f, first, min(run, part.last - first), ncol, nband)
                if len(data):
                    yield self._batch(part.path, first, data)

    def _values(self, f, first: int, n: int, ncol: int, nband: int) -> np.ndarray:
        """rows x columns x bands from the row ``first`` on; fewer rows if the file ends before."""
        kind = np.dtype(self.o.get("dtype", "int16")).newbyteorder(self.o.get("order", "<"))
        offset, interleave = int(self.o.get("offset", 0)), self.o.get("interleave", "bip")

        def values(at: int, count: int) -> np.ndarray:
            f.seek(offset + kind.itemsize * at)
            return np.frombuffer(f.read(kind.itemsize * count), kind)

        if interleave == "bsq":
            nrow = int(self.o["nrow"])
            return np.stack([values((b * nrow + first) * ncol, n * ncol).reshape(-1, ncol) for b in range(nband)], axis=2)
        got = values(first * ncol * nband, n * ncol * nband)
        return got.reshape(-1, ncol, nband) if interleave == "bip" else got.reshape(-1, nband, ncol).transpose(0, 2, 1)

    def _batch(self, path: str, first: int, data: np.ndarray):
        import pyarrow as pa

        n, ncol, nband = data.shape
        name = data.dtype.name
        wide = {"uint16": "int32", "uint8": "int16"}.get(name, name)
        rows = np.repeat(np.arange(first, first + n, dtype="int32"), ncol)
        columns = [pa.array([path] * len(rows)), pa.array(rows), pa.array(np.tile(np.arange(ncol, dtype="int32"), n))]
        columns += [pa.array(data[:, :, k].ravel().astype(wide)) for k in range(nband)]
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def read_bip(spark: SparkSession, paths: list[str], nrow: int, ncol: int, nband: int, dtype: str = "int16", bands: list[int] | None = None, rows: tuple[int, int] | None = None, **layout) -> DataFrame:
    """filename, py, px and bands (from 1) of raw rasters; ``rows`` reads part of them only, ``layout`` are the source's other options."""
    if bands and any(not 1 <= b <= nband for b in bands):
        raise OSError(f"bands {bands} are not all within 1 to {nband}")
    from chronopix.shipping import ship_package

    ship_package(spark)
    spark.dataSource.register(BipSource)
    reader = spark.read.format("bip").options(paths="\n".join(paths), nrow=nrow, ncol=ncol, nband=nband, dtype=dtype, **layout)
    if rows:
        reader = reader.option("rows", f"{rows[0]}:{rows[1]}")
    df = reader.load()
    return df.select("filename", "py", "px", *(f"b{b}" for b in bands)) if bands else df


def read_header(path: str) -> dict:
    """What a raster's ENVI header (the file's name with .hdr behind it, or in the extension's place) says.

    nrow, ncol, nband, dtype, interleave, offset, order; names, ndv and georeference where given.
    """
    folder, slash, name = path.rpartition("/")
    for beside in (f"{path}.hdr", f"{folder}{slash}{name.rpartition('.')[0] or name}.hdr"):
        try:
            with files.open_input(beside) as f:
                text = f.read().decode("utf-8", "replace")
            break
        except FileNotFoundError:
            continue
    else:
        raise OSError(f"{path} has no header")
    if not text.startswith("ENVI"):
        raise OSError(f"the header of {path} is none of ENVI's")
    told = {k.strip().lower(): v.strip().strip("{}").strip() for k, v in re.findall(r"^([^=\n]+)=\s*(\{[^}]*\}|[^\n]*)", text, re.M)}
    try:
        out = {"nrow": int(told["lines"]), "ncol": int(told["samples"]), "nband": int(told["bands"]), "dtype": _ENVI_TYPES[int(told["data type"])], "interleave": told["interleave"].lower()}
    except (KeyError, ValueError) as e:
        raise OSError(f"the header of {path} lacks or has an unknown {e}") from None
    out |= {"offset": int(told.get("header offset", 0)), "order": ">" if told.get("byte order") == "1" else "<"}
    if "band names" in told:
        out["names"] = [n.strip() for n in told["band names"].split(",")]
    if "data ignore value" in told:
        out["ndv"] = float(told["data ignore value"])
    out["georeference"] = {k: told[k] for k in ("map info", "coordinate system string") if k in told}
    return out


def read_envi(spark: SparkSession, paths: list[str], bands: list[int] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """filename, py, px and bands of rasters with ENVI headers, all of the first one's shape.

    A file of another shape ends the job with an OSError, raised where the file is read.
    """
    if not paths:
        raise OSError("no raster to read")
    h = read_header(paths[0])
    return read_bip(spark, paths, h["nrow"], h["ncol"], h["nband"], h["dtype"], bands, rows, interleave=h["interleave"], offset=h["offset"], order=h["order"], headers="true")


def write_raster(values: DataFrame, path: str, bands: list[str], nrow: int, ncol: int, ndv: float, dtype: str = "float32", names: list[str] | None = None, georeference: dict | None = None) -> None:
    """Columns of a map (py, px, ...) as one raster of bands by pixel, with an ENVI header beside it.

    The header holds band names, the no-data value and the georeference.  Pixels that the
    map lacks, nulls and NaN are no data; pixels outside the raster are left out.  Each
    row of pixels is put together on an executor, and the driver writes one after the
    other, so that it never holds more than a few.  ValueError if names and bands differ in number.
    """
    names = list(names or bands)
    if len(names) != len(bands):
        raise ValueError(f"{len(names)} names for {len(bands)} bands")
    if "," in "".join(names):  # the header's list is separated by commas
        names = [n.replace(",", ";") for n in names]
    kind = np.dtype(dtype).newbyteorder("<")
    codes = {v: k for k, v in _ENVI_TYPES.items()}
    inside = values.where(F.col("py").between(0, nrow - 1) & F.col("px").between(0, ncol - 1))
    cells = F.sort_array(F.collect_list(F.struct("px", *(F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands)))))
    rows = inside.groupBy("py").agg(cells.alias("c")).orderBy("py")
    parts = rows.select("py", F.col("c.px").alias("px"), *(F.col(f"c.v{k}").alias(f"v{k}") for k in range(len(bands))))
    empty = np.full((ncol, len(bands)), ndv, kind).tobytes()
    at = 0
    with files.open_output(path) as f:
        for r in parts.toLocalIterator():
            for _ in range(at, r["py"]):
                f.write(empty)
            line = np.full((ncol, len(bands)), float(ndv))
            for k in range(len(bands)):
                line[r["px"], k] = np.array(r[f"v{k}"], float)  # None becomes NaN
            f.write(np.where(np.isnan(line), ndv, line).astype(kind).tobytes())
            at = r["py"] + 1
        for _ in range(at, nrow):
            f.write(empty)
    header = ["ENVI", f"samples = {ncol}", f"lines = {nrow}", f"bands = {len(bands)}", "header offset = 0", "file type = ENVI Standard", f"data type = {codes[kind.name]}", "interleave = bip", "byte order = 0"]
    header += [f"data ignore value = {ndv}", "band names = {" + ", ".join(names) + "}", *(f"{k} = {{{v}}}" for k, v in (georeference or {}).items())]
    with files.open_output(f"{path}.hdr") as f:
        f.write(("\n".join(header) + "\n").encode())


def by_bucket(rows: DataFrame, rows_per_bucket: int = 64, columns_per_task: int = 1024) -> DataFrame:
    """Rows with ``py_bucket``, dealt to tasks by it and by runs of columns, so that a wide raster's bucket is no single task."""
    rows = rows.withColumn("py_bucket", F.expr(f"py div {rows_per_bucket}"))
    return rows.repartition("py_bucket", F.expr(f"px div {columns_per_task}"))


def layout(rows: DataFrame, path: str, rows_per_bucket: int = 64) -> None:
    """Writes observations in time-series order: Parquet by ``py_bucket``, sorted by pixel and date.

    A row of pixels, a pixel or a date range then reads few files and row groups.
    """
    by_bucket(rows, rows_per_bucket).sortWithinPartitions("py_bucket", "py", "px", "ordinal").write.partitionBy("py_bucket").mode("overwrite").parquet(path)


def ingest(images: DataFrame, catalog: DataFrame, path: str, rows_per_bucket: int = 64, key: str = "filename") -> None:
    """Writes the archive of images and their catalogue."""
    layout(images.join(catalog, key), path, rows_per_bucket)


def read_through(spark: SparkSession, images: DataFrame, source, path: str, rows_per_bucket: int = 64, key: str = "image_id") -> DataFrame:
    """The archive at ``path``, which holds exactly the observations of ``images`` afterwards.

    An archive of just these images is read as it is; one of others keeps what is still
    wanted and gets the rest; without one all is written.  ``source(images)`` gives the
    observations (with ``key``) of the images that are missing.  The new archive is written
    beside the old one and then put in its place.
    """
    from chronopix.operators import incremental

    files.recover(spark, path)
    if images.isEmpty():
        raise ValueError("no image is wanted")
    had = spark.read.parquet(path).drop("py_bucket") if files.exists(spark, path) else None
    if had is not None and incremental.same_images(had, images, key):
        return spark.read.parquet(path)
    wanted = incremental.missing(images, had, key) if had is not None else images
    rows = None if wanted.isEmpty() else source(wanted)
    if had is not None:
        kept = incremental.retained(had, images, key)
        rows = kept if rows is None else kept.unionByName(rows)
    layout(rows, f"{path}-new", rows_per_bucket)
    files.replace(spark, path)
    return spark.read.parquet(path)


def read_line(spark: SparkSession, path: str, line: int, rows_per_bucket: int = 64) -> DataFrame:
    """Observations of one raster row: the bucket's partition and the row groups with this row."""
    return spark.read.parquet(path).where((F.col("py_bucket") == line // rows_per_bucket) & (F.col("py") == line))


def read_pixel(spark: SparkSession, path: str, px: int, py: int, rows_per_bucket: int = 64) -> DataFrame:
    return read_line(spark, path, py, rows_per_bucket).where(F.col("px") == px)


def attributes(df: DataFrame) -> tuple[int, int, list[tuple[str, str]]]:
    """(rows, columns, [(band, type)]) of an observation table."""
    rows, cols = df.agg(F.max("py") + 1, F.max("px") + 1).first()
    return rows, cols, [(c, t) for c, t in df.dtypes if c[0] == "b" and c[1:].isdigit()]


def to_array(values: DataFrame, column: str, nrow: int, ncol: int, ndv: float) -> np.ndarray:
    """A map's column as a dense raster on the driver (a raster's size bounds it)."""
    out = np.full((nrow, ncol), ndv)
    for r in values.select("py", "px", column).toLocalIterator():
        if 0 <= r["py"] < nrow and 0 <= r["px"] < ncol and r[column] is not None:
            out[r["py"], r["px"]] = r[column]
    return out
