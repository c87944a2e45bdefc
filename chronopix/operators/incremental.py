"""Keeping derived tables up to date: retained, new and finished keys as semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retained(cache: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Cached rows whose image is still wanted."""
    return cache.join(images.select(key), key, "left_semi")


def missing(images: DataFrame, cache: DataFrame, key: str = "image_id") -> DataFrame:
    """Wanted images that the cache lacks."""
    return images.join(cache.select(key).distinct(), key, "left_anti")


def update(cache: DataFrame, images: DataFrame, source: DataFrame, key: str = "image_id") -> DataFrame:
    """The cache for a new list of images: what is retained, and the source's rows of the new ones.

    Raises ValueError for an empty list, as nothing could be retained or added.
    """
    if images.isEmpty():  # the list is looked at, not the archive
        raise ValueError("neither a cached nor a new image is left")
    new = source.join(missing(images, cache, key).select(key), key, "left_semi")
    return retained(cache, images, key).unionByName(new)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str] | str = "py") -> DataFrame:
    """Work whose key has no result yet (to resume a job)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def same_images(cache: DataFrame, images: DataFrame, key: str = "image_id") -> bool:
    """Whether the cache holds exactly these images: one comparison of both differences."""
    a, b = cache.select(key).distinct(), images.select(key).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def array_subset(inner, outer):
    """Whether every element of one array column is in another."""
    return F.size(F.array_except(inner, outer)) == 0
