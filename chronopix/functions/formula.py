"""Design formulas: ``1 + x + harm(x, 1) + C(sensor)`` as Columns and as NumPy.

Terms are joined by ``+`` (or taken out by ``-``).  ``1`` is the intercept, a name
is a catalogue column, ``harm(name, k)`` a cosine and a sine of k cycles a year,
and ``C(name)`` a categorical column coded against a reference level, the first
in sorted order or the one given as ``C(name, Treatment(reference='LT5'))``.
More functions can be registered.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopix.functions.columns import OMEGA, harmonic

_CALL = re.compile(r"(\w+)\s*\((.*)\)$")


@dataclass(frozen=True)
class Feature:
    """One column of the design: its name, as a Column and for NumPy rows (a dict of arrays)."""

    name: str
    column: Column | None
    values: Callable[[dict[str, np.ndarray]], np.ndarray]
    categorical: bool = False


#: name -> function(variable, argument) giving [(suffix, Column builder, NumPy function)]
FUNCTIONS: dict[str, Callable[[str, str], list[tuple[str, Callable[[], Column], Callable[[np.ndarray], np.ndarray]]]]] = {}


def register(name: str):
    def add(f):
        FUNCTIONS[name] = f
        return f

    return add


@register("harm")
def _harm(variable: str, argument: str):
    k = float(argument)
    return [("[0]", lambda: harmonic(F.col(variable), k)[0], lambda x: np.cos(OMEGA * k * x)), ("[1]", lambda: harmonic(F.col(variable), k)[1], lambda x: np.sin(OMEGA * k * x))]


def split_terms(formula: str) -> list[tuple[bool, str]]:
    """(kept, term) of each term; parentheses hold their commas and signs together."""
    out, depth, now, keep = [], 0, "", True
    for ch in formula + "+":
        if depth == 0 and ch in "+-":
            if now.strip():
                out.append((keep, now.strip()))
            now, keep = "", ch == "+"
            continue
        depth += (ch == "(") - (ch == ")")
        now += ch
    if depth:
        raise ValueError(f"unbalanced parentheses in {formula!r}")
    return out


def without_categories(formula: str) -> str:
    """The formula without its C(...) terms."""
    kept = [(k, t) for k, t in split_terms(formula) if not t.startswith("C(")]
    return "".join((" + " if k else " - ") + t if i else t for i, (k, t) in enumerate(kept))


class Design:
    """A parsed formula."""

    def __init__(self, formula: str, levels: dict[str, list[str]] | None = None, columns: bool = True):
        """``levels``: the values of each categorical column.  ``columns=False`` builds no Columns (no session needed)."""
        self.formula = formula
        self.features: list[Feature] = []
        removed = {t for k, t in split_terms(formula) if not k}
        intercept = "1" not in removed and "0" not in {t for k, t in split_terms(formula) if k}
        if intercept:
            self.features.append(Feature("Intercept", F.lit(1.0) if columns else None, lambda rows: np.ones(len(next(iter(rows.values()))))))
        for kept, term in split_terms(formula):
            if not kept or term in ("0", "1") or term in removed:
                continue
            call = _CALL.match(term)
            if not call:
                self.features.append(Feature(term, F.col(term).cast("double") if columns else None, lambda rows, t=term: np.asarray(rows[t], float)))
            elif call[1] == "C":
                self._category(term, call[2], levels or {}, columns)
            elif call[1] in FUNCTIONS:
                variable, _, argument = call[2].partition(",")
                variable, argument = variable.strip(), argument.strip()
                for suffix, build, compute in FUNCTIONS[call[1]](variable, argument):
                    self.features.append(Feature(f"{call[1]}({variable}, {argument}){suffix}", build() if columns else None, lambda rows, v=variable, f=compute: f(np.asarray(rows[v], float))))
            else:
                raise ValueError(f"unknown function in term {term!r}")

    def _category(self, term: str, inside: str, levels: dict[str, list[str]], columns: bool) -> None:
        name = inside.split(",")[0].strip()
        if name not in levels:
            raise ValueError(f"the levels of {name!r} are needed")
        every = sorted(map(str, levels[name]))
        m = re.search(r"reference\s*=\s*['\"]([^'\"]+)['\"]", inside)
        reference = m[1] if m else every[0]
        if reference not in every:
            raise ValueError(f"{reference!r} is no level of {name!r}")
        for level in every:
            if level != reference:
                column = F.when(F.col(name).cast("string") == level, 1.0).otherwise(0.0) if columns else None
                self.features.append(Feature(f"{term}[T.{level}]", column, lambda rows, n=name, v=level: (np.asarray(rows[n]).astype(str) == v).astype(float), True))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def index(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.names)}

    def matrix(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """Rows of the design for arrays of variables."""
        return np.column_stack([f.values(rows) for f in self.features])

    def vector(self, x: float) -> list[float]:
        """The design at one ordinal; categorical terms are 0."""
        rows = {"x": np.array([float(x)])}
        return [0.0 if f.categorical else float(f.values(rows)[0]) for f in self.features]

    def columns(self) -> list[Column]:
        return [f.column.alias(f.name) for f in self.features]

    def array(self) -> Column:
        return F.array(*(f.column.cast("double") for f in self.features))


def category_levels(catalog: DataFrame, formula: str) -> dict[str, list[str]]:
    """The distinct values of a formula's categorical columns (a handful; the catalogue is small)."""
    names = [_CALL.match(t)[2].split(",")[0].strip() for k, t in split_terms(formula) if k and t.startswith("C(")]
    return {n: sorted(str(r[0]) for r in catalog.select(n).where(F.col(n).isNotNull()).distinct().collect()) for n in dict.fromkeys(names)}


def select_features(names: list[str], what: str) -> list[int]:
    """Indices of a class of coefficients: all, intercept, slope, seasonality or categorical."""
    lower = [n.lower() for n in names]
    if what == "all":
        return list(range(len(names)))
    if what == "intercept":
        return [i for i, n in enumerate(lower) if n == "intercept"]
    if what == "slope":
        return [i for i, n in enumerate(lower) if n == "x"]
    if what == "seasonality":
        return [i for i, n in enumerate(names) if n.startswith("harm")]
    if what == "categorical":
        return [i for i, n in enumerate(names) if n.startswith("C(")]
    raise KeyError(f"unknown class of coefficients {what!r}")


def select_bands(bands: str | list[int], n_bands: int) -> list[int]:
    """0-based indices of 'all' or of a list of 1-based bands."""
    chosen = list(range(n_bands)) if bands == "all" else [int(b) - 1 for b in bands]
    if any(not 0 <= b < n_bands for b in chosen):
        raise KeyError(f"bands {bands} are not all within 1 to {n_bands}")
    return chosen
