"""Best-fit packing of tokenised documents into sequences of bounded length.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver.  There the configuration linear program (fewest sequences, each a
multiset of lengths that fits, so that every length is covered as often as it
occurs) is solved by multiplicative weights: a length's weight is its price, a
knapsack dynamic program finds the configuration of the highest price, this one
is taken until one of its lengths is covered, the prices of its lengths fall
exponentially in the share of them that it covered, and covered lengths drop
out.  Every pricing also gives a dual bound.  Passes repeat, with the weights of
lengths in badly filled configurations raised, until the value is within ``eps``
of the best bound.  The solution is rounded to whole copies, fullest first, and
what rounding leaves over goes best-fit-decreasing into the gaps of those copies
and into further sequences.  Pieces then find their place from their rank within
their length: ranks come from counts per (bucket, length), so no task ranks a
whole length.

Defined results: a null text is an empty one and gives the end token alone;
repeated rows are packed each by itself; pieces of one length are interchangeable,
so ties go by id and piece; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopix.llm.common import Scratch, map_batches


def byte_pair_encoding(tokenizer) -> tiktoken.Encoding:
    """tiktoken's coder over the vocabulary of a byte-level ``tokenizers.Tokenizer`` whose ids follow its merges' order.

    Gives the same ids some seven times as fast; the tests hold the two against each other.
    """
    # fixed values: the printable stand-ins of bytes in byte-level vocabularies, and their split pattern
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in tokenizer.get_vocab().items() if token not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts, as little-endian uint32 bytes; texts that hold a special token's string go to the tokeniser itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.coder = byte_pair_encoding(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole pieces at the end, the rest first."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def pieces(documents: DataFrame, tokenizer_path: str | Callable[[], str], id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(id, piece, start, length, crc) of every piece of every document."""

    def make():
        encode, tail = Encoder(tokenizer_path() if callable(tokenizer_path) else tokenizer_path), np.array([end_id], "<u4").tobytes()

        def fn(ids, texts):
            out = [[], [], [], [], []]
            for key, text in zip(ids, texts, strict=True):
                data = encode(text or "") + tail
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    for column, v in zip(out, (key, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])), strict=True):
                        column.append(v)
            return out

        return fn

    kind = dict(documents.dtypes)[id_column]
    return map_batches(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), make, ["id", "text"], f"id {kind}, piece int, start long, length int, crc long")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The highest price of a multiset of lengths of total at most capacity, and its lengths, longest first.

    Length k + 1 has prices[k]; lengths of no positive price are left out.  Of equal
    choices the longest piece wins.
    """
    back = np.where(prices > 0, prices, -np.inf)[::-1].astype(float)
    best, pick = np.zeros(capacity + 1), [0] * (capacity + 1)
    for c in range(1, capacity + 1):
        worth = best[:c] + back[capacity - c :]  # at i: a piece of c - i on top of the best of i
        i = int(worth.argmax())
        if worth[i] > best[c - 1] + 1e-15:
            best[c], pick[c] = worth[i], c - i
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if pick[c]:
            out.append(pick[c])
            c -= pick[c]
        else:
            c -= 1
    return float(best[capacity]), sorted(out, reverse=True)


@dataclass
class Cover:
    """A solution of the configuration program: copies of each configuration, their sum, and the best dual bound."""

    copies: dict[tuple[int, ...], float]
    value: float
    bound: float


def cover(need: np.ndarray, capacity: int, eps: float = 0.01, rate: float = 0.3, passes: int = 4) -> Cover:
    """Covers every length exactly, by multiplicative weights; ``need[k]`` pieces of length k + 1.

    Ends with the first pass whose value is at most 1 + eps times the dual bound, or with the best of all passes.
    """
    share = np.arange(1, capacity + 1) / capacity
    weights, out = np.ones(capacity), None
    if not need.any():
        return Cover({}, 0.0, 0.0)
    fair = np.where(need > 0, share, 0)
    bound = float((need * fair).sum()) / knapsack(fair, capacity)[0]
    for _ in range(passes):
        # at first a price is nearly the length's share; a little more for long pieces, which are hardest to place
        prices, left, copies = share**1.1 * weights, need.astype(float), {}
        lost, seen = np.zeros(capacity), np.zeros(capacity)
        while left.any():
            live = np.where(left > 0, prices, 0)
            worth, config = knapsack(live, capacity)
            bound = max(bound, float((need * live).sum()) / worth)
            kinds, times = np.unique(config, return_counts=True)
            kinds -= 1
            step = float((left[kinds] / times).min())
            copies[tuple(config)] = copies.get(tuple(config), 0.0) + step
            left[kinds] -= times * step
            left[left < 1e-6] = 0
            prices[kinds] *= np.exp(-rate * times * step / need[kinds])
            lost[kinds] += times * step * (1 - sum(config) / capacity)
            seen[kinds] += times * step
        value = sum(copies.values())
        if out is None or value < out.value:
            out = Cover(copies, value, bound)
        if out.value <= (1 + eps) * bound:
            break
        badly = lost / np.maximum(seen, 1e-9)
        weights *= np.exp(rate * badly / max(badly.max(), 1e-9))
    out.bound = bound
    return out


def rounded(copies: dict[tuple[int, ...], float], need: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Whole copies of a solution's configurations, fullest first, first rounded down and then up while the pieces last; and the pieces left over."""
    left, plan = need.astype(np.int64), {}
    order = sorted(copies.items(), key=lambda kv: (-sum(kv[0]), -kv[1], kv[0]))
    for whole in (math.floor, math.ceil):
        for config, x in order:
            kinds, times = np.unique(config, return_counts=True)
            n = min(whole(x) - plan.get(config, 0), int((left[kinds - 1] // times).min()))
            if n > 0:
                plan[config] = plan.get(config, 0) + n
                left[kinds - 1] -= times * n
    return plan, left


def best_fit(need: np.ndarray, capacity: int, started: dict[tuple[int, ...], int] | None = None) -> dict[tuple[int, ...], int]:
    """Best-fit-decreasing on a histogram, into the gaps of ``started`` and new sequences: {lengths of a sequence: copies}; equal sequences go together."""
    by_gap: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []  # those in use, in order

    def put(config: tuple[int, ...], copies: int, gap: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = {}
            insort(gaps, gap)
        by_gap[gap][config] = by_gap[gap].get(config, 0) + copies

    for config, copies in (started or {}).items():
        put(config, copies, capacity - sum(config))
    for length in np.flatnonzero(need)[::-1].tolist():
        length += 1
        n = int(need[length - 1])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each, capacity - each * length)
                if n % each:
                    put((length,) * (n % each), 1, capacity - (n % each) * length)
                break
            gap = gaps[at]
            config, copies = next(iter(by_gap[gap].items()))
            use = min(n, copies)
            if use == copies:
                del by_gap[gap][config]
                if not by_gap[gap]:
                    del by_gap[gap], gaps[at]
            else:
                by_gap[gap][config] -= use
            put((*config, length), use, gap - length)
            n -= use
    out: dict[tuple[int, ...], int] = {}
    for own in by_gap.values():
        for config, copies in own.items():
            out[config] = out.get(config, 0) + copies
    return out


def solve(counts: dict[int, int], capacity: int, eps: float = 0.01) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, longest first; copies)]: a packing of exactly ``counts``, near the fewest sequences."""
    need = np.zeros(capacity, np.int64)
    for length, n in counts.items():
        need[length - 1] = n
    full, need[capacity - 1] = int(need[capacity - 1]), 0
    plan, left = rounded(cover(need, capacity, eps).copies, need, capacity)
    out: dict[tuple[int, ...], int] = {(capacity,): full} if full else {}
    for config, copies in best_fit(left, capacity, plan).items():
        key = tuple(sorted(config, reverse=True))
        out[key] = out.get(key, 0) + copies
    return sorted(out.items())


@dataclass
class Placement:
    """For each length, where the pieces of consecutive ranks go."""

    first: dict[int, np.ndarray]
    config: dict[int, np.ndarray]
    times: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    def at(self, length: int, rank: int) -> tuple[int, int]:
        """(sequence, offset) of the piece of this length with this rank, both from 0."""
        k = int(np.searchsorted(self.first[length], rank, side="right")) - 1
        copy, slot = divmod(rank - int(self.first[length][k]), int(self.times[length][k]))
        return int(self.base[length][k]) + copy, int(self.offset[length][k]) + slot * length


def placement(plan: list[tuple[tuple[int, ...], int]]) -> Placement:
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for k, (config, copies) in enumerate(plan):
        at = 0
        for length in sorted(set(config), reverse=True):
            times = config.count(length)
            rows.setdefault(length, []).append((used.get(length, 0), k, times, base, at))
            used[length] = used.get(length, 0) + copies * times
            at += times * length
        base += copies
    pick = lambda i: {n: np.array([r[i] for r in x], np.int64) for n, x in rows.items()}
    return Placement(pick(0), pick(1), pick(2), pick(3), pick(4))


def pack(documents: DataFrame, tokenizer_path: str | Callable[[], str], id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, end_id: int = 2, bucket_rows: int | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, crc, sequence, offset.

    ``tokenizer_path``: a path that every executor has, or a function that finds it there.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    cut_up = scratch.keep(pieces(documents, tokenizer_path, id_column, text_column, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = placement(solve(counts, capacity))
    total = sum(counts.values())
    # about the root of all pieces in a bucket: neither a bucket's ranking nor a length's prefix sum grows as the whole
    buckets = max(1, math.ceil(total / (bucket_rows or max(500, math.isqrt(total)))))
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n")).select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    own = Window.partitionBy("bucket", "length").orderBy("id", "piece", "crc", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("from"))

    def make():
        def fn(ids, piece, start, length, crc, rank):
            got = [where.at(n, r) for n, r in zip(length, rank, strict=True)]
            return [ids, piece, start, length, crc, [g[0] for g in got], [g[1] for g in got]]

        return fn

    kind = dict(cut_up.dtypes)["id"]
    return map_batches(ranked, make, ["id", "piece", "start", "length", "crc", "rank"], f"id {kind}, piece int, start long, length int, crc long, sequence long, offset long", 4096)
