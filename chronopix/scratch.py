"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only in local mode, where driver and executors are one process, a temporary
    folder stands in; a cluster without a setting is an error, as every executor
    would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_on_context = spark._jsc.sc().getCheckpointDir()
        found = set_on_context.get() if set_on_context.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronopix-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; a leftover folder harms nothing
        pass


class Scratch:
    """Intermediate tables of one query, as Parquet in the shared folder.

    Written tables cut the lineage and survive the loss of any executor.  All of
    them are deleted when the interpreter ends; ``drop`` deletes one sooner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/chronopix-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)
