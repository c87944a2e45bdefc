"""Connected components over an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopix.scratch import Scratch

#: Into so many parts a key's rows are dealt, so that no task meets all rows of a frequent one.
PARTS = 64


def _part(spread: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), spread), F.lit(PARTS))


def join_spread(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key``, where a key may hold any share of ``rows``.

    The rows of a key are dealt by a hash of ``spread``; the table's row is first
    joined with the (key, part) pairs that occur, at most ``PARTS`` of a key, and
    then with the rows on both, so neither join brings a whole key to one task.
    """
    dealt = rows.withColumn("_part", _part(F.col(spread)))
    return dealt.join(dealt.select(key, "_part").distinct().join(table, key), [key, "_part"]).drop("_part")


def _least(rows: DataFrame) -> DataFrame:
    """Rows (a, b) with m, the least b of each a; a's rows are dealt as in ``join_spread``."""
    dealt = rows.select("a", "b", _part(F.col("b")).alias("_part"))
    parts = dealt.groupBy("a", "_part").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("a", "_part").join(least, "a"), ["a", "_part"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    found = _least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    # a node's least neighbour takes its others and the node itself
    return found.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars around their smallest node: every a has one edge, and no b is an a."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that has an edge; root is the smallest node reachable.

    ``edges`` has columns a and b of one orderable type; loops and repeats do no
    harm.  Alternates large-star and small-star steps.  Every aggregation combines
    before its shuffle, and a node's edges are dealt into parts, so a node with a
    third of all edges does not meet in one task.  Each round's table goes to the
    shared folder, which cuts the lineage.  An empty table gives none.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        new = scratch.keep(_small_star(_large_star(now)).where("a <> b").distinct(), "star")
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
