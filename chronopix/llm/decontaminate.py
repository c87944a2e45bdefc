"""Benchmark decontamination by greedy string tiling.

Documents and test items are split into lower-case words.  Seeds are the runs of
``least`` words, known by their Karp-Rabin hashes over 64-bit word hashes.  A
Bloom filter of all items' seeds (of bounded size, built by an aggregation) goes
to the executors, and one scan of the documents writes the seeds that pass it,
with their places; no text is shuffled.  These are joined with the items' seeds
as tables.  An item can only be contained if at least ``coverage / least`` of its
seeds' places occur in the document, so that many places less one, those of the
seeds that most documents have, need not be looked up; a common phrase thus
brings few pairs.  For each pair greedy string tiling follows: again and again
the longest common run in which no word is marked yet, found by running
Karp-Rabin hashes of growing and shrinking length, becomes a tile and its words
are marked in both texts.  An item is in a document if the tiles cover at least
``coverage`` of its words; as tiles may stand in any order, reordered passages
count.  Work and memory for a pair are linear in the seeds that they share, times
the tiles.

Defined results: null and empty texts contain nothing and are in nothing; an item
with fewer than ``least`` words is matched whole; of equally long runs the one
first in the item, then first in the document becomes the tile; very long texts
are tiled whole; repeated rows and items each count by themselves; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.llm.common import Scratch, map_batches, without
from chronopix.llm.components import join_spread

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the seeds' filter: sixteen a seed, at most these (8 MB).
MOST_BITS = 1 << 26


def split(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words, repeat(5)), np.uint64, len(words))


def running_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of ``size`` numbers; by doubling, in log(size) steps."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, length, power = None, 0, ids.astype(np.uint64) + np.uint64(1), 1, np.array([_BASE])  # an array, as it wraps around
    while True:
        # part: hashes of all runs of ``length``, power: base ** length
        if size & length:
            at = part[done : done + n]
            out = at.copy() if out is None else out * power + at
            done += length
        if done == size:
            return out
        part = part[:-length] * power + part[length:]
        length *= 2
        power = power * power


def seeds(ids: np.ndarray, size: int) -> np.ndarray:
    """Mixed hashes of the runs of ``size`` words, as signed longs; different sizes never meet."""
    h = running_hashes(ids, size) + np.uint64(size)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _without_marked(codes: np.ndarray, blocked: np.ndarray, sign: int) -> np.ndarray:
    """Codes with every blocked one made unlike all others."""
    out = codes.copy()
    out[blocked] = sign * (np.arange(len(codes))[blocked] + (1 << 40))
    return out


def _longest_run(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int]:
    """(length, place in a, place in b) of the longest common run; (0, 0, 0) if there is none."""
    low, high = 0, most
    size = 1
    # a run of some length holds runs of all lesser lengths: double while there is one, then halve the interval
    while low < high:
        if np.isin(running_hashes(a, size), running_hashes(b, size)).any():
            low = size
        else:
            high = size - 1
        size = min(2 * size, high) if high == most and low == size else (low + high + 1) // 2
    if not low:
        return 0, 0, 0
    x, y = running_hashes(a, low), running_hashes(b, low)
    i = int(np.isin(x, y).argmax())
    return low, i, int((y == x[i]).argmax())


def tile(item: np.ndarray, doc: np.ndarray, places: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: (words, place in the item, place in the document), longest first.

    ``item``: the seeds at all places of the item; ``doc`` and ``places``: seeds of
    the document and where they begin, in order, not necessarily all.
    """
    here = np.isin(doc, item)
    doc, places = doc[here], places[here]
    kinds, codes = np.unique(np.concatenate([item, doc]), return_inverse=True)
    a, b = codes[: len(item)].astype(np.int64), codes[len(item) :].astype(np.int64)
    # seeds that do not follow each other in the document are parted
    gaps = np.flatnonzero(np.diff(places) != 1) + 1
    b = np.insert(b, gaps, -np.arange(1, len(gaps) + 1) - (1 << 50))
    at = np.insert(places.astype(np.int64), gaps, -(1 << 40))
    off_a, off_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    own, out = np.arange(len(a)), []
    while True:
        run, i, j = _longest_run(_without_marked(a, off_a, 1), _without_marked(b, off_b, -1), len(a) if not out else out[-1][0] - size + 1)
        if not run:
            return out
        words, p = run + size - 1, int(at[j])
        out.append((words, i, p))
        off_a |= (own > i - size) & (own < i + words)
        off_b |= (at > p - size) & (at < p + words)


def _filter(hashes: DataFrame) -> np.ndarray:
    """The Bloom filter, as 64-bit words, of a column ``h``; two bits a value, set by an aggregation."""
    n = hashes.count()
    bits = min(MOST_BITS, 1 << max(12, (16 * max(n, 1) - 1).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("p"))
    set_bits = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits"))
    got = set_bits.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    u, mask = h.view(np.uint64), np.uint64(len(bits) * 64 - 1)
    one = lambda p: (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)
    return (one(u & mask) & one((u >> np.uint64(32)) & mask)).astype(bool)


def _items(benchmark: DataFrame, item_column: str, text_column: str, least: int, scratch: Scratch) -> DataFrame:
    """no, item, n (words), size (of its seeds), seeds (at all its places); items without words are left out."""

    def make():
        def fn(no, keys, texts):
            rows = []
            for row, key, text in zip(no, keys, texts, strict=True):
                if words := split(text):
                    size = min(least, len(words))
                    rows.append((row, key, len(words), size, seeds(word_hashes(words), size).tolist()))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]

        return fn

    rows = benchmark.select(F.monotonically_increasing_id().alias("no"), F.col(item_column).alias("item"), F.col(text_column).alias("text"))
    return scratch.keep(map_batches(rows, make, ["no", "item", "text"], f"no long, item {dict(benchmark.dtypes)[item_column]}, n int, size int, seeds array<long>"), "items")


def _hits(documents: DataFrame, id_column: str, text_column: str, sizes: list[int], bits: np.ndarray, scratch: Scratch) -> DataFrame:
    """row, id, th, places, hashes: of each document with a seed that passes the filter, these seeds."""
    sent = documents.sparkSession.sparkContext.broadcast(bits)

    def make():
        def fn(ids, hashes, texts):
            rows = []
            for key, th, text in zip(ids, hashes, texts, strict=True):
                words = word_hashes(split(text))
                at, found = [], []
                for size in sizes:
                    h = seeds(words, size)
                    places = np.flatnonzero(_passes(sent.value, h))
                    at.append(places)
                    found.append(h[places])
                if any(map(len, at)):
                    rows.append((key, th, np.concatenate(at), np.concatenate(found)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(4)]

        return fn

    kind = dict(documents.dtypes)[id_column]
    rows = documents.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).alias("text"))
    found = map_batches(rows, make, ["id", "th", "text"], f"id {kind}, th long, places array<int>, hashes array<long>")
    # written at once, so that the numbers are the same for all readers
    return scratch.keep(found.withColumn("row", F.monotonically_increasing_id()), "hits")


def _pairs(items: DataFrame, hits: DataFrame, least: int, coverage: float) -> DataFrame:
    """(row, no): documents and the items that they may contain."""
    from pyspark.sql import Window

    in_docs = hits.select("row", F.explode(F.array_distinct("hashes")).alias("h"))
    common = in_docs.groupBy("h").agg(F.count("*").alias("docs"))
    each = items.select("no", "n", "size", F.explode("seeds").alias("h")).groupBy("no", "n", "size", "h").agg(F.count("*").alias("times"))
    # an item's seeds, the most common first: so many places may be passed over that a document with enough of the others is still met
    needed = F.greatest(F.lit(1), F.ceil(F.lit(coverage) * F.col("n") / F.lit(least) - F.lit(1e-9)))
    before = F.sum("times").over(Window.partitionBy("no").orderBy(F.desc("docs"), "h"))
    index = each.join(common, "h").withColumn("upto", before).where((F.col("upto") >= needed) | (F.col("size") < least)).select("h", "no")
    return join_spread(in_docs, index, "h", "row").select("row", "no").distinct()


def matches(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", least: int = 5, coverage: float = 0.5) -> DataFrame:
    """(id, th, item, coverage, tiles, longest): one row per document and item it contains; th is Spark's hash of the document's text."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontamination")
    items = _items(benchmark, item_column, item_text_column, least, scratch)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # least numbers at most
    hits = _hits(documents, id_column, text_column, sizes, _filter(items.select(F.explode("seeds").alias("h"))), scratch)
    pairs = scratch.keep(_pairs(items, hits, least, coverage), "pairs")
    both = join_spread(pairs, items, "no", "row").join(hits, "row")

    def make():
        def fn(ids, hashes, keys, n, size, own, places, found):
            rows = []
            for key, th, item, words, length, a, p, b in zip(ids, hashes, keys, n, size, own, places, found, strict=True):
                got = tile(np.array(a, np.int64), np.array(b, np.int64), np.array(p, np.int64), length)
                share = sum(t[0] for t in got) / words
                if got and share >= coverage:
                    rows.append((key, th, item, share, len(got), got[0][0]))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(6)]

        return fn

    schema = f"id {dict(documents.dtypes)[id_column]}, th long, item {dict(benchmark.dtypes)[item_column]}, coverage double, tiles int, longest int"
    return scratch.keep(map_batches(both, make, ["id", "th", "item", "n", "size", "seeds", "places", "hashes"], schema, 64), "found")


def keep_clean(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", least: int = 5, coverage: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, that contain no test item; only ids and hashes of the others are moved."""
    found = matches(documents, benchmark, id_column, text_column, item_column, item_text_column, least, coverage)
    return without(documents, found, id_column, text_column)
