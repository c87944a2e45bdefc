"""Quality rules whose cutoffs are certified to reject few good documents.

Five signals are computed from each text with built-in functions only.  Each rule
measures one of them in thousandths of a usual limit, and a document's score is
the largest of these; what scores over its stratum's cutoff is rejected.
Labelled good documents, split into strata by length, are the holdout.  With n of
them in a stratum, the exact binomial distribution gives the largest number k so
that k or fewer rejected ones have a probability of at most ``delta`` over the
number of strata (Bonferroni) if more than ``alpha`` of all good documents were
rejected; the holdout's own score that leaves at most k above it is then the
strictest cutoff certified.  k depends on n alone, so no data are looked at twice:
with probability 1 - ``delta`` or more, the whole verdict rejects at most
``alpha`` of the good documents that pass the base rule, in every stratum at once.
A more lenient cutoff keeps the bound; so of those that reject the same labelled
bad documents as the strictest, the most lenient holds.  A stratum too small for
any certificate rejects nothing.

Everything is DataFrame functions: no Python code sees a row.  Long arrays are
sorted within their row, so there is no shuffle of words.  Scores are whole
numbers with a ceiling, so the holdout's histogram is bounded whatever its size.

Defined results: null and blank texts have no words and fail the base rule; very
long texts are read whole; repeated rows each get their result, and equal texts
count once in the holdout; labels that are null or neither 0 nor 1 and ids
without a document do not count; without good labels only the base rule rejects;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopix.llm.common import Scratch

_BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: name: (numerator, denominator, factor of the numerator, of the denominator): a thousand is the usual limit, which is
#: ten symbols in a hundred words, three repeated lines in ten, one repeated word in five, ten characters a word, three characters a word.
RULES: dict[str, tuple[str, str, int, int]] = {
    "symbols": ("n_symbols", "n_words", 10_000, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 3),
    "repeats": ("n_repeat_words", "n_words", 5_000, 1),
    "long_words": ("word_chars", "n_words", 100, 1),
    "short_words": ("n_words", "word_chars", 3_000, 1),
}
#: Scores end here, a hundred times the usual limit.
CEILING = 100_000
#: Scores of so many values are counted together first, about the root of all.
BAND = 316
#: Strata by the number of words: below each bound, and the rest.
STRATA = (200, 800)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, i, by: F.coalesce(F.get(s, i + by)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

        def union(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        return _let(_let(placed, twice), union)

    # most texts repeat no window: a set tells that sooner than a sort
    found = lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(windows(words), found))


def signals(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, th), one row per document; th: the text's hash."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("id"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    removed = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    rows = rows.select(
        "id",
        F.xxhash64("text").alias("th"),
        (F.length("text") - removed(_BLANKS)).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("line"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("rep"))).alias("word"),
    )
    return rows.select("id", F.col("word.n").alias("n_words"), "word_chars", "n_symbols", F.col("line.n").alias("n_lines"), F.col("line.dup").alias("n_dup_lines"), F.col("word.rep").alias("n_repeat_words"), "th")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k in range(len(STRATA) - 1, -1, -1):
        out = F.when(F.col("n_words") < STRATA[k], F.lit(k)).otherwise(out)
    return out


def rule_score(rule: str) -> Column:
    above, below, times, by = RULES[rule]
    exact = F.call_function("div", F.col(above) * times, F.greatest(F.col(below), F.lit(1)) * by)
    return F.least(F.lit(CEILING).cast("long"), exact)


def score() -> Column:
    return F.greatest(*(rule_score(r) for r in RULES))


def most_rejected(n: Column, alpha: float, level: float) -> Column:
    """The largest k with P(X <= k) <= level for X ~ Binomial(n, alpha), exact; -1 if there is none.

    Terms and their sum are carried as logarithms, from 0 up to the mean (beyond it the sum is never small).
    """
    n = n.cast("double")
    first = n * F.lit(math.log1p(-alpha))
    start = F.struct(first.alias("term"), first.alias("sum"), F.when(first <= F.lit(math.log(level)), F.lit(0)).otherwise(F.lit(-1)).alias("k"))

    def up(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(math.log(alpha) - math.log1p(-alpha))
        total = F.greatest(a["sum"], term) + F.log1p(F.exp(-F.abs(a["sum"] - term)))
        return F.struct(term.alias("term"), total.alias("sum"), F.when(total <= F.lit(math.log(level)), i).otherwise(a["k"]).alias("k"))

    mean = F.floor(n * F.lit(alpha)).cast("int")
    steps = F.when(mean > 0, F.sequence(F.lit(1), mean)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, up, lambda a: a["k"])


def cutoffs(labelled: DataFrame, alpha: float = 0.05, delta: float = 0.05, scratch: Scratch | None = None) -> DataFrame:
    """(stratum, n, cutoff or null) from ``labelled``: stratum, score and good (1 or 0), a row for each text."""
    level = delta / (len(STRATA) + 1)
    hist = labelled.groupBy("stratum", "score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    hist = hist.withColumn("band", F.expr(f"score div {BAND}"))
    if scratch:  # bounded, and read several times
        hist = scratch.keep(hist, "histogram")
    # how many good ones lie above: first by bands of scores, then within each band
    down = lambda keys, by: Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    bands = hist.groupBy("stratum", "band").agg(F.sum("good").alias("n")).select("stratum", "band", F.coalesce(F.sum("n").over(down(["stratum"], "band")), F.lit(0)).alias("over"))
    counted = hist.withColumn("within", F.coalesce(F.sum("good").over(down(["stratum", "band"], "score")), F.lit(0))).join(bands, ["stratum", "band"])
    allowed = hist.groupBy("stratum").agg(F.sum("good").alias("n")).withColumn("most", most_rejected(F.col("n"), alpha, level))
    # tables of a row a stratum
    strictest = counted.join(F.broadcast(allowed), "stratum").where("over + within <= most").groupBy("stratum", "n").agg(F.min("score").alias("least"))
    caught = hist.where("bad > 0").join(F.broadcast(strictest), "stratum").where("score > least").groupBy("stratum").agg(F.min("score").alias("caught"))
    return strictest.join(F.broadcast(caught), "stratum", "left").select("stratum", "n", F.coalesce(F.col("caught") - 1, F.col("least")).alias("cutoff"))


def judge(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: id, the signals, base_failed, stratum, score, failed (array of rules), kept."""
    scratch = Scratch(documents.sparkSession, "rules")
    rows = scratch.keep(signals(documents, id_column, text_column).withColumns({"stratum": stratum(), "score": score()}), "signals")
    usable = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label_column).cast("long").alias("good")).where("id is not null").distinct()
    texts = rows.where(~base_failed()).select("id", "th", "stratum", "score").distinct()
    chosen = cutoffs(texts.join(usable, "id").select("th", "stratum", "score", "good").distinct(), alpha, delta, scratch)
    ruled = rows.join(F.broadcast(chosen.drop("n")), "stratum", "left")  # a row a stratum
    failed = F.filter(F.array(*(F.when(rule_score(r) > F.col("cutoff"), F.lit(r)) for r in RULES)), lambda r: r.isNotNull())
    return ruled.select("id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "stratum", "score", failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def oracle_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    """The same in DuckDB's SQL, for a table documents(doc_id, text) and labels(doc_id, quality)."""
    level = delta / (len(STRATA) + 1)
    failing = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    strata = "CASE " + " ".join(f"WHEN n_words < {b} THEN {k}" for k, b in enumerate(STRATA)) + f" ELSE {len(STRATA)} END"
    scored = ", ".join(f"least({CEILING}, {above} * {times} // (greatest({below}, 1) * {by}))" for above, below, times, by in RULES.values())
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r}))"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: {term}))"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT row, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: translate(x, {blanks}, '') <> '') AS lines FROM t),
win AS (SELECT row, i, [words[i], words[i + 1], words[i + 2]] AS win FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT row, count(DISTINCT p) AS n FROM (
          SELECT a.row, unnest([a.i, a.i + 1, a.i + 2]) AS p FROM win a
          JOIN (SELECT row, win FROM win GROUP BY row, win HAVING count(*) > 1) b ON a.row = b.row AND a.win = b.win) GROUP BY row),
s0 AS (SELECT t.doc_id, t.text, len(w.words) AS n_words, length(text) - (length(text) - length(translate(text, {blanks}, ''))) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM t JOIN w USING (row) LEFT JOIN rep USING (row)),
s AS (SELECT *, {strata} AS stratum, greatest({scored}) AS score FROM s0),
held AS (SELECT DISTINCT text, stratum, score, quality FROM s JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) USING (doc_id) WHERE NOT ({failing})),
strata AS (SELECT stratum, count(*) FILTER (quality = 1) AS n FROM held GROUP BY stratum),
allowed AS (SELECT stratum, n, (SELECT coalesce(max(k), -1) FROM (SELECT n, unnest(range(0, CAST(floor(n * {alpha!r}) AS BIGINT) + 1)) AS k) WHERE {tail} <= {level!r}) AS most FROM strata),
strict AS (SELECT h.stratum, min(h.score) AS least FROM (SELECT DISTINCT stratum, score FROM held) h JOIN allowed a USING (stratum)
           WHERE (SELECT count(*) FROM held g WHERE g.stratum = h.stratum AND g.quality = 1 AND g.score > h.score) <= a.most GROUP BY h.stratum),
chosen AS (SELECT stratum, coalesce((SELECT min(score) FROM held b WHERE b.stratum = c.stratum AND b.quality = 0 AND b.score > c.least) - 1, least) AS cutoff FROM strict c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, ({failing}) AS base_failed, NOT ({failing}) AND NOT coalesce(score > cutoff, FALSE) AS kept
FROM s LEFT JOIN chosen USING (stratum)"""
