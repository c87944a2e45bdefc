"""Column builders: dates, vegetation indices, harmonics, weights.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 0001-01-01 (day 1) to 1970-01-01.
EPOCH = 719163
#: Radians per day of a yearly cycle.
OMEGA = 2 * math.pi / 365.25

_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%j": "DDD", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%%": "%"}


def spark_pattern(strftime: str) -> str:
    """A strftime format as a Spark date pattern; other letters are quoted."""
    out, at = [], 0
    while at < len(strftime):
        two = strftime[at : at + 2]
        if strftime[at] == "%":
            if two not in _STRFTIME:
                raise ValueError(f"no Spark pattern for {two!r}")
            out.append(_STRFTIME[two])
            at += 2
        else:
            out.append(f"'{strftime[at]}'" if strftime[at].isalpha() else strftime[at])
            at += 1
    return "".join(out)


def to_ordinal(day: Column) -> Column:
    """Proleptic Gregorian ordinal of a date."""
    return F.unix_date(day) + F.lit(EPOCH)


def from_ordinal(ordinal: Column) -> Column:
    return F.date_from_unix_date((ordinal - F.lit(EPOCH)).cast("int"))


def parse_ordinal(text: Column, strftime: str = "%Y%j") -> Column:
    """Ordinal of a date written in a strftime format; null where it doesn't parse."""
    return to_ordinal(F.to_date(F.try_to_timestamp(text, F.lit(spark_pattern(strftime)))))


def format_ordinal(ordinal: Column, strftime: str = "%Y%j") -> Column:
    """Ordinal written in a strftime format, as an integer ('ordinal': as it is)."""
    if strftime == "ordinal":
        return ordinal.cast("int")
    return F.date_format(from_ordinal(ordinal), spark_pattern(strftime)).cast("int")


def year_and_doy(ordinal: Column) -> tuple[Column, Column]:
    day = from_ordinal(ordinal)
    return F.year(day), F.dayofyear(day)


def season(ordinal: Column) -> Column:
    """winter (November to March), spring (April, May), summer (June to August), fall (September, October)."""
    month = F.month(from_ordinal(ordinal))
    return F.when(month.isin(4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10), "fall").otherwise("winter")


def is_integer(text: Column) -> Column:
    """Whether a string reads as an integer."""
    return F.coalesce(text.try_cast("bigint").isNotNull() & F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def evi(red: Column, nir: Column, blue: Column) -> Column:
    """Enhanced vegetation index of reflectances in [0, 1]; null where its denominator is 0."""
    return F.try_divide(F.lit(2.5) * (nir - red), nir + 6 * red - F.lit(7.5) * blue + 1)


def harmonic(x: Column, frequency: float) -> tuple[Column, Column]:
    """Cosine and sine of ``frequency`` cycles a year."""
    w = F.lit(OMEGA * frequency)
    return F.cos(w * x), F.sin(w * x)


def bisquare(resid: Column, c: float = 4.685) -> Column:
    """Tukey's weight of a scaled residual."""
    return F.when(F.abs(resid) < c, F.pow(1 - F.pow(resid / c, F.lit(2.0)), F.lit(2.0))).otherwise(F.lit(0.0))


def halfmax(values: Column) -> Column:
    """0-based place of the value nearest to half way between smallest and largest; the first on ties.

    NaN entries are passed over; an empty or constant array gives null.
    """
    def place(v: Column, low: Column, high: Column) -> Column:
        off = F.transform(v, lambda e: F.when(e.isNull() | F.isnan(e), F.lit(None).cast("double")).otherwise(F.abs((e - low) / (high - low) - 0.5)))
        return F.when(high > low, once(off, lambda o: F.array_position(o, F.array_min(o)) - 1))

    real = lambda v: F.filter(v, lambda e: e.isNotNull() & ~F.isnan(e))
    ends = lambda r: F.struct(F.array_min(r).alias("low"), F.array_max(r).alias("high"))
    return once(values, lambda v: once(once(real(v), ends), lambda e: place(v, e["low"], e["high"])))


def once(value: Column, f) -> Column:
    """f(value), with the value computed once a row: an expression that a lambda names is computed again for each element."""
    return F.transform(F.array(value), f)[0]


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def pixel_id(py: Column, px: Column, ncol: int) -> Column:
    return py.cast("long") * F.lit(ncol) + px


def pixel_of(index: Column, ncol: int) -> tuple[Column, Column]:
    """(py, px) of a flat pixel index."""
    return F.floor(index / F.lit(ncol)).cast("int"), (index % F.lit(ncol)).cast("int")


def parent_folder(filename: Column) -> Column:
    """Name of the folder that a file is in (the image id); null without one."""
    parts = F.split(filename, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def amplitude_name(name: str) -> str | None:
    """The amplitude's name for the cosine term of a harmonic, or None for other terms."""
    m = re.fullmatch(r"harm\(x, ([0-9]+)\)\[0\]", name)
    return f"amplitude(x, {m[1]})" if m else None
