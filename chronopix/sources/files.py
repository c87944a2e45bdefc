"""Files and folders of any file system: existence, access, replacement, and streams of bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """(file system of ``path``, the class of its paths)."""
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at(path))


def modified(spark: SparkSession, path: str) -> int | None:
    """When the newest file at or below ``path`` was written (milliseconds), or None without one."""
    fs, at = hadoop(spark, path)
    if not fs.exists(at(path)):
        return None
    found, times = fs.listFiles(at(path), True), []
    while found.hasNext():
        times.append(found.next().getModificationTime())
    return max(times, default=None)


def access(spark: SparkSession, folder: str) -> tuple[bool, bool]:
    """(readable, writable): whether a folder's files can be listed, and whether one can be made there.

    A folder that is not there yet is readable if it can be made.
    """
    fs, at = hadoop(spark, folder)
    probe = at(f"{folder.rstrip('/')}/.probe-{uuid.uuid4().hex}")
    try:
        fs.mkdirs(at(folder))
        fs.create(probe, False).close()
        writable = True
    except Exception:  # whatever the file system raises, it says no
        writable = False
    try:
        if writable:
            fs.delete(probe, False)
        fs.listStatus(at(folder))
        return True, writable
    except Exception:
        return False, writable


def recover(spark: SparkSession, path: str) -> None:
    """Ends a replacement that was broken off between taking the old folder away and putting the new one there."""
    fs, at = hadoop(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(f"{path}-old")):
        fs.rename(at(f"{path}-old"), at(path))


def replace(spark: SparkSession, path: str) -> None:
    """Puts ``path``-new in the place of ``path``; the old folder stays beside it until that is done."""
    fs, at = hadoop(spark, path)
    fs.delete(at(f"{path}-old"), True)
    steps = [(f"{path}-new", path)]
    if fs.exists(at(path)):
        steps.insert(0, (path, f"{path}-old"))
    for a, b in steps:
        if not fs.rename(at(a), at(b)):
            raise OSError(f"could not move {a} to {b}")
    fs.delete(at(f"{path}-old"), True)


def _located(path: str):
    """(file system, path there) of Arrow for a URI; None for a plain local path."""
    if path.startswith("file:") and not path.startswith("file://"):  # as Spark writes local files
        return None, path[len("file:") :]
    if "://" not in path:
        return None, path
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def open_input(path: str):
    """A file to seek and read in, on an executor too."""
    fs, at = _located(path)
    return fs.open_input_file(at) if fs else open(at, "rb")


def open_output(path: str):
    fs, at = _located(path)
    return fs.open_output_stream(at) if fs else open(at, "wb")
