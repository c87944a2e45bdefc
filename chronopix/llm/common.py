"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopix.scratch import Scratch, shared_folder  # noqa: F401
from chronopix.shipping import ship_package


def fold(id_column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids fall into fold of the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def map_batches(df: DataFrame, make: Callable[[], Callable[..., list]], columns: list[str], schema: str, slice_rows: int = 512) -> DataFrame:
    """``df.select(columns)`` through a Python function of column lists, over Arrow.

    ``make()`` runs once per task and gives ``fn(*lists) -> list of output lists``.
    Rows go through in slices of ``slice_rows``, so the worker never holds more
    than one Arrow batch plus one slice of results.
    """
    ship_package(df.sparkSession)
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                lists = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(lists, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out_schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str, slice_rows: int = 512) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose ``column`` the function keeps; no shuffle."""
    ship_package(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                yield part.filter(pa.array(fn(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Keys (an id and a hash each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _by_key(documents: DataFrame, keys: DataFrame, id_column: str, text_column: str, how: str) -> DataFrame:
    own = keys.select("id", "th").distinct()
    if own.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        own = F.broadcast(own)
    match = F.col(f"_d.{id_column}").eqNullSafe(F.col("_k.id")) & (F.xxhash64(F.col(f"_d.{text_column}")) == F.col("_k.th"))
    return documents.alias("_d").join(own.alias("_k"), match, how)


def without(documents: DataFrame, keys: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The documents, all columns, whose id and text's hash (``xxhash64``) are not among ``keys`` (id, th).

    Keys are counted first: up to ``BROADCAST_KEYS`` go to the executors, and the
    texts stay where they are; beyond, both sides are shuffled.
    """
    return _by_key(documents, keys, id_column, text_column, "left_anti")


def only(documents: DataFrame, keys: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The documents, all columns, whose id and text's hash are among ``keys``, as in ``without``."""
    return _by_key(documents, keys, id_column, text_column, "left_semi")


def bounded_rows(df: DataFrame, columns: list[str], most: int, counted: DataFrame | None = None) -> DataFrame:
    """About ``most`` rows of ``df`` chosen by a hash of ``columns`` (all, if there are fewer), each different row once.

    Only for fitting classifiers: a count, a filter, and a distinct over what is
    left, so rows that repeat do not add up.  No sort and no skew.  The choice
    depends on the values alone, so a rerun fits the same model.  ``counted`` has
    as many rows or some more, and can be counted without reading texts.
    """
    n = (df if counted is None else counted).count()
    if n > most:
        df = df.where(F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return df.distinct()


def labelled_texts(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most: int) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most about ``most`` labelled rows, brought to the driver for fitting.

    The chosen labels (ids and bits, at most ``most`` rows) are broadcast, so the
    documents are scanned and not shuffled.  An id may stand for many rows; so the
    rows, too, are chosen down to about ``most``.
    """
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_y"))
    chosen = bounded_rows(usable, ["_id"], most)
    found = documents.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = bounded_rows(found, ["_id", "_text"], 2 * most).select("_id", "_text", "_y").collect()
    rows.sort(key=lambda r: (r["_id"], r["_y"], r["_text"]))
    return [r["_text"] for r in rows], [r["_y"] for r in rows]
