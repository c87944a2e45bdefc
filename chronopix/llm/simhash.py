"""SimHash near-duplicates by multi-index hashing.

Every document gets a 64-bit SimHash of its word shingles.  Two fingerprints
that differ in at most two bits agree up to one bit in one of two 32-bit
segments.  So each fingerprint goes into a table under both of its segments and
looks up the Hamming ball of radius one around each segment; whatever meets
another fingerprint in a bucket is a candidate.

A bucket may hold any number of fingerprints (groups of near copies do that), so
complete distances are not verified pair by pair.  Each candidate lists the ball
of radius one around its whole fingerprint (65 values).  Two fingerprints are
within two bits exactly if these balls share a value; at most 65 share one, all
of them within two bits of each other, and each is linked to the smallest there,
which keeps every connection.  This is one way for buckets of every size, and its
work is linear in the number of fingerprints.

More tables find more near copies: each holds a fingerprint of its own of the same
shingles (the hashes are mixed anew), and texts link if they do in any.  A filter
of near copies takes three; the fingerprint that is reported is the first table's.

Defined results: null and wordless texts have fingerprint zero and link to each
other; repeated rows each keep a row; a null id keeps its row and counts for no
class's smallest id; ids may be of any type that has an order; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.llm.common import Scratch, map_batches, only, without
from chronopix.llm.components import connected_components, join_spread

_WEIGHTS = 1 << np.arange(63, -1, -1, dtype=np.uint64)


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    """The hashes for another table: 64-bit values mixed anew, by the finalizer of SplitMix64."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * table) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def table_fingerprints(text: str | None, words: int = 3, seed: int = 42, tables: int = 1) -> list[int]:
    """Unsigned 64-bit SimHashes, one a table: a bit is set if it is set in over half of the shingles' hashes.

    The first table's hashes are XXH64, the others' those mixed anew, so that each is a fingerprint of its own of the same shingles.
    """
    from itertools import repeat

    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return [0] * tables
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts = [0, *ends[:-1]]
    pieces = [whole[a : b - 1] for a, b in zip(starts, ends[words - 1 :], strict=False)] or [whole]
    h = np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))
    out = []
    for t in range(tables):
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 8192):
            own = _mixed(h[at : at + 8192], t) if t else h[at : at + 8192]
            part = np.ascontiguousarray(own.astype(">u8"))
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(_WEIGHTS[total * 2 > len(pieces)].sum(dtype=np.uint64)))
    return out


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64."""
    return table_fingerprints(text, words, seed)[0]


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42, tables: int = 1) -> DataFrame:
    """(id, th, fp, f1, ...): fp is the fingerprint's 64 bits as a signed long, f1 and on those of further tables, th Spark's own hash of the text."""

    def make():
        def fn(ids, hashes, texts):
            found = np.array([table_fingerprints(t, words, seed, tables) for t in texts], np.uint64).reshape(-1, tables).astype(np.int64)
            return [ids, hashes, *(found[:, t].tolist() for t in range(tables))]

        return fn

    kind = dict(documents.dtypes)[id_column]
    rows = documents.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).alias("text"))
    return map_batches(rows, make, ["id", "th", "text"], f"id {kind}, th long, " + ", ".join(f"{c} long" for c in _columns(tables)))


def _columns(tables: int) -> list[str]:
    return ["fp", *(f"f{t}" for t in range(1, tables))]


def _segments(prints: DataFrame):
    """The two 32-bit segments of fp, each with its number in the bits above, and the table's (column t, if there is one) above that."""
    low = F.lit((1 << 32) - 1)
    hi, lo = F.shiftrightunsigned(F.col("fp"), 32).bitwiseAND(low), F.col("fp").bitwiseAND(low).bitwiseOR(F.lit(1 << 32))
    if "t" not in prints.columns:
        return hi, lo
    table = F.shiftleft(F.col("t").cast("long"), 33)
    return hi.bitwiseOR(table), lo.bitwiseOR(table)


def _probes(value):
    """A segment and, of its neighbours at one bit, those with that bit set.

    Of two segments one bit apart, exactly one lacks the bit, so this one's look-up finds the other.
    """
    return F.concat(F.array(value), F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda v: v != value))


def candidates(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """The fingerprints that meet another one of their table within a bit in one of their segments; ``prints``: distinct (fp) or (t, fp).

    The look-up's join is by segment; a segment that very many share is a large
    partition, which the adaptive skew join splits.  Both sides are shuffled:
    Spark's estimate of exploded rows is that of the rows before, so it would
    broadcast the look-ups, over 30 a fingerprint, from the driver.
    """
    by = [c for c in ("t",) if c in prints.columns]
    hi, lo = _segments(prints)
    table = prints.select("fp", F.explode(F.array(hi, lo)).alias("key"))
    sizes = table.groupBy("key").agg(F.count("*").alias("n"))
    probes = prints.select("fp", F.explode(F.concat(_probes(hi), _probes(lo))).alias("key"))
    numbered = lambda df: df.withColumn("t", F.shiftright("key", 33).cast("int")) if by else df
    looked = numbered(probes.hint("merge").join(sizes, "key"))  # what the key tells is not shuffled: the table, and whether it is the fingerprint's own segment
    met = scratch.keep(looked.withColumn("own", F.col("key").isin(*_segments(looked))).where("n > 1 or not own").select(*by, "fp", "key", "own"), "met")
    # a neighbour's look-up finds the bucket; those in it are candidates too
    found = numbered(table.join(met.where("not own").select("key").distinct(), "key", "left_semi"))
    return met.select(*by, "fp").unionByName(found.select(*by, "fp")).distinct()


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b), or (t, a, b), whose components are those of all pairs of a table within two bits; ``prints``: distinct (fp) or (t, fp)."""
    by = [c for c in ("t",) if c in prints.columns]
    one = F.lit(1).cast("long")
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i))))
    stars = candidates(prints, scratch).select(*by, "fp", F.explode(ball).alias("at"))
    least = stars.groupBy(*by, "at").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b <> most").select(*by, "at", "b")
    linked = stars.hint("merge").join(least, [*by, "at"]).where("fp <> b").select(*by, F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b"))
    return linked.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def table_links(prints: DataFrame, scratch: Scratch, tables: int) -> DataFrame:
    """Links (a, b) of the first tables' fingerprints, whose components are those of all texts that are within two bits in any table.

    ``prints``: distinct (fp, f1, ...).  In every table but the first, a fingerprint stands
    for the smallest fp that has it; others that have it are linked to that one, and so
    are those of two fingerprints that link.
    """
    values = F.array(*(F.struct(F.lit(t).alias("t"), F.col(c).alias("v")) for t, c in enumerate(_columns(tables))))
    stacked = prints.select("fp", F.explode(values).alias("k"))
    owners = scratch.keep(stacked.groupBy("k").agg(F.min("fp").alias("rep"), F.max("fp").alias("most")), "owners")
    same = join_spread(stacked, owners.where("rep <> most").select("k", "rep"), "k", "fp").where("fp <> rep").select("fp", "rep")
    found = links(owners.select("k.t", F.col("k.v").alias("fp")), scratch)
    end = lambda c: F.struct("t", F.col(c).alias("v"))
    first = found.select("t", "b", end("a").alias("k")).join(owners.select("k", F.col("rep").alias("fp")), "k")
    both = join_spread(first.select("fp", end("b").alias("k")), owners.select("k", "rep"), "k", "fp").where("fp <> rep").select("fp", "rep")
    return same.unionByName(both).select(F.greatest("fp", "rep").alias("a"), F.least("fp", "rep").alias("b")).distinct()


def roots(prints: DataFrame, scratch: Scratch, linked: DataFrame | None = None) -> DataFrame:
    """``prints`` (distinct fp, other columns) with root, the smallest fingerprint of the class; ``linked``: links other than those of two bits."""
    edges = links(prints.select("fp"), scratch) if linked is None else linked
    found = connected_components(scratch.keep(edges, "links"), scratch)
    return prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: id, fp (signed long), component (smallest id reachable over links of at most two bits)."""
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = scratch.keep(fingerprints(documents, id_column, text_column, words, seed), "fingerprints")
    prints = scratch.keep(docs.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    rooted = roots(prints, scratch)
    # classes of one fingerprint, nearly all, need no second shuffle
    classes = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.keep(rooted.join(classes, "root").select("fp", "component"), "classes")
    return join_spread(docs.select("id", "th", "fp"), named, "fp", "id").select("id", "fp", "component")


def keep_one_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42, tables: int = 3) -> DataFrame:
    """The documents, all columns as they are, without near-duplicates: of each class one row.

    Texts link if their fingerprints are within two bits in any of ``tables`` tables; a near copy
    that is three or four bits away in one is often within two in another.

    That is the row with the smallest id (rows without one come last), of several
    texts under that id the one with the least hash, and of rows that repeat id and
    text the first by all their columns, written as JSON.  Rows that share an id with texts
    of different classes do not compete.  Only ids and hashes are shuffled; what
    goes is taken out of a second scan of the documents.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    found = fingerprints(documents, id_column, text_column, words, seed, tables)
    rows = scratch.keep(found.groupBy("id", "th", *_columns(tables)).agg(F.count("*").alias("n")), "fingerprints")
    prints = scratch.keep(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("least")), "distinct")
    linked = table_links(scratch.keep(rows.select(*_columns(tables)).distinct(), "tables"), scratch, tables) if tables > 1 else None
    keepers = roots(prints, scratch, linked).groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.th")
    k, r = keepers.alias("k"), rows.alias("r")
    kept = F.col("k.th").isNotNull()
    fate = scratch.keep(r.join(k, F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.th") == F.col("k.th")), "left").where(~kept | (F.col("r.n") > 1)).select("r.id", "r.th", kept.alias("kept")), "fate")
    left = without(documents, fate, id_column, text_column)
    again = fate.where("kept")
    if again.isEmpty():
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    first = only(documents, again, id_column, text_column).groupBy(F.col(id_column), F.xxhash64(text_column)).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return left.unionByName(first.select("_row.*"))
