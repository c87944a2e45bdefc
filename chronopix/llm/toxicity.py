"""Toxicity by a weighted lexicon.

A text is folded (accents and the styled letters of mathematics, circles or full
width become the plain letter by Unicode's compatibility decomposition; lower
case; look-alike letters of other scripts and digits that stand for letters become
that letter; i, l and 1 are one class; zero-width characters go; whatever is no
letter becomes one space), then an Aho-Corasick automaton finds every lexicon term and exception phrase in one pass.  Terms are
whole words or word beginnings.  A match inside an exception phrase does not
count.  The weights that are left are summed; the sum, its share of the text's
length and the number of matches go through a logistic calibration.

The lexicon starts from a short fixed list.  Fitting adds the terms that best
set labelled toxic texts apart (greedy cover: each new term must cover toxic
texts that no earlier one covers; it counts if a mention of it, or a repeated
one, is rare in other texts), learns the weights as smoothed log odds of a
mention and fits the calibration; all on a bounded, documented sample of
labelled rows.  How rare and how frequent a term must be, and whether repeated
mentions count, is one of a few settings, chosen by cross-validation inside that
sample.

Defined results: null, empty and letterless texts have no match and get the
score of no match; very long texts are read whole; repeated rows and other
columns make no difference; without labelled rows the fixed list and a fixed
calibration hold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.llm.common import labelled_texts, map_batches

# Insults that count without training, and phrases in which such a word is harmless.
SEEDS = ("idiot", "moron", "scum", "loser", "worthless", "pathetic", "stupid", "disgusting", "imbecile", "dumbass", "bastard", "bitch", "asshole", "fuck", "shit", "cunt", "retard", "trash", "clown", "vermin", "degenerate")
EXCEPTIONS = (
    "trash can", "trash cans", "trash bag", "trash bags", "trash bin", "trash collection", "trash pickup", "take out the trash", "clown fish", "circus clown", "birthday clown", "class clown", "rodeo clown",
    "pond scum", "soap scum", "sore loser", "loser tree", "stupid question", "not stupid", "not an idiot", "not a moron", "not worthless", "not a loser", "not disgusting", "idiot light", "idiot proof", "the idiot by dostoevsky", "sympathetic",
)
# Letters of other scripts, full-width forms and ligatures that look like these letters.
LOOKALIKES = {"a": "аαａ", "b": "ЬвＢｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іιｉıӏ", "j": "јｊ", "k": "κкｋ", "l": "ｌⅼ", "m": "мｍ", "n": "ոｎ", "o": "оοօｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ", "u": "υսｕ", "v": "ѵνｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Lengths of the word beginnings that may become terms.
PREFIXES = (4, 5, 6)
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: (texts that a term must newly cover, log odds of a mention, whether repeated mentions may make a term)
SETTINGS = ((4, 2.5, True), (4, 2.5, False), (3, 2.0, True), (8, 3.0, False))
#: Rows that choose the setting at most, in so many parts.
CHOOSING_ROWS, CHOOSING_PARTS = 1500, 3

_TABLE = {ord(x): k for k, xs in LOOKALIKES.items() for x in xs.lower()} | {ord(k): v for k, v in DIGITS.items()} | dict.fromkeys([*map(ord, INVISIBLE), *range(0x300, 0x370)])
_TABLE = {k: "i" if v == "l" else v for k, v in _TABLE.items()} | {ord("l"): "i"}
_NO_LETTER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words, one space around each; '' if there is none."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    words = _NO_LETTER.sub(" ", text.lower().translate(_TABLE)).strip()
    return f" {words} " if words else ""


@dataclass
class ToxicityModel:
    terms: dict[str, float]  # folded, a space before; a space behind if it is a whole word
    exceptions: tuple[str, ...] = EXCEPTIONS
    calibration: tuple[float, float, float, float] = (-4.0, 1.5, 1.5, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {"_automaton": None}

    def _build(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            key = f" {fold(phrase).strip()} "
            out.add_word(key, (len(key), 0.0, True))
        for term, weight in self.terms.items():
            out.add_word(term, (len(term), weight, False))
        out.make_automaton()
        return out

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each counted match; of several that start at one word, the heaviest."""
        if self._automaton is None:
            self._automaton = self._build()
        spans, best = [], {}
        for end, (size, weight, exempt) in self._automaton.iter(folded):
            start = end - size + 1
            if exempt:
                spans.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (end, weight)
        if spans:
            best = {s: v for s, v in best.items() if not any(a <= s and v[0] <= b for a, b in spans)}
        return [(s, e, w) for s, (e, w) in sorted(best.items())]

    def features(self, folded: str) -> tuple[float, float, float]:
        """Logs of the summed weights, of their sum per hundred words and of the number of matches."""
        found = [w for _, _, w in self.matches(folded)] if folded else []
        total = sum(found)
        n = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100 * total / (n + 10)) if total else 0.0, math.log1p(len(found))

    def judge(self, text: str | None) -> tuple[float, int]:
        """(score, number of matches), in one pass."""
        x = self.features(fold(text))
        z = sum(w * v for w, v in zip(self.calibration, (1.0, *x), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), round(math.expm1(x[2]))

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]


def _candidates(words: list[str]) -> Counter[str]:
    """How often each possible term, whole word or word beginning, stands in a text."""
    out: Counter[str] = Counter()
    for w, n in Counter(words).items():
        if len(w) >= 4:
            out[f" {w} "] += n
        for size in PREFIXES:
            if len(w) >= size:
                out[f" {w[:size]}"] += n
    return out


def _lexicon(docs: list[tuple[Counter[str], int]], setting: tuple[int, float, bool], most_terms: int) -> dict[str, float]:
    """Terms and weights from texts' candidates with their labels."""
    least_cover, least_odds, repeats = setting
    bad = [c for c, y in docs if y]
    support = Counter(c for x in bad for c in x)
    support = {c: n for c, n in support.items() if n >= least_cover}
    again = Counter(c for x in bad for c, n in x.items() if n > 1 and c in support)
    clean, clean_again, n_clean = Counter(), Counter(), 0
    for found, y in docs:
        if not y:
            n_clean += 1
            clean.update(c for c in found if c in support)
            clean_again.update(c for c, n in found.items() if n > 1 and c in support)
    log_odds = lambda a, b: math.log((a + 0.5) / (len(bad) + 1)) - math.log((b + 0.5) / (n_clean + 1))
    odds = lambda c: log_odds(support.get(c, 0), clean[c])
    twice = lambda c: repeats and again[c] >= least_cover and odds(c) > 1 and log_odds(again[c], clean_again[c]) > least_odds
    terms = {f" {fold(w).strip()} ": 2.0 for w in SEEDS}
    good = {c: odds(c) for c in support if odds(c) > least_odds or twice(c)}
    members: dict[str, set[int]] = {c: set() for c in good}
    for k, x in enumerate(bad):
        for c in x:
            if c in members:
                members[c].add(k)
    open_ = set(range(len(bad)))
    for c in terms:
        if c in members:
            open_ -= members[c]
            terms[c] = good[c]
        elif c in support:
            terms[c] = max(0.0, odds(c))
    heap = {c: len(m & open_) for c, m in members.items()}
    while open_ and len(terms) < most_terms:
        # most newly covered, then purest, then shortest
        c = max(heap, key=lambda c: (heap[c], good[c], -len(c), c), default=None)
        if c is None:
            break
        fresh = len(members[c] & open_)
        if fresh < heap[c]:
            heap[c] = fresh
            continue
        if fresh < least_cover:
            break
        terms[c] = good[c]
        open_ -= members[c]
        del heap[c]
    return terms


def _fitted(folded: list[str], docs: list[tuple[Counter[str], int]], setting: tuple[int, float, bool], most_terms: int) -> ToxicityModel:
    """A lexicon with its calibration."""
    model = ToxicityModel(_lexicon(docs, setting, most_terms))
    y = np.array([v for _, v in docs], float)
    if 0 < y.sum() < len(y):
        x = np.array([(1.0, *model.features(t)) for t in folded])
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-x @ w))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
            w += np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
        model.calibration = tuple(map(float, w))
    return model


def train(texts: list[str], toxic: list[int], most_terms: int = 400, seed: int = 5) -> ToxicityModel:
    """Fit lexicon, weights and calibration, with the setting of the least cross-validated log loss."""
    rows = list(dict(zip(texts, toxic, strict=True)).items())  # copies of a text teach once
    folded = [fold(t) for t, _ in rows]
    docs = [(_candidates(f.split()), y) for f, (_, y) in zip(folded, rows, strict=True)]
    setting = SETTINGS[0]
    order = np.random.default_rng(seed).permutation(len(rows))[:CHOOSING_ROWS]
    if min(sum(docs[i][1] for i in order), sum(1 - docs[i][1] for i in order)) >= 10 * CHOOSING_PARTS:
        loss = dict.fromkeys(SETTINGS, 0.0)
        for part in range(CHOOSING_PARTS):
            own, held = [i for k, i in enumerate(order) if k % CHOOSING_PARTS != part], order[part::CHOOSING_PARTS]
            for s in SETTINGS:
                model = _fitted([folded[i] for i in own], [docs[i] for i in own], s, most_terms)
                x = np.array([(1.0, *model.features(folded[i])) for i in held]) @ np.array(model.calibration)
                loss[s] += float(np.logaddexp(0, np.where([docs[i][1] for i in held], -x, x)).sum())
        setting = min(SETTINGS, key=loss.get)
    return _fitted(folded, docs, setting, most_terms)


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most: int = 4000) -> ToxicityModel:
    """Train on about ``most`` labelled documents, chosen by a hash of the id."""
    return train(*labelled_texts(documents, labels, id_column, text_column, label_column, most))


def score(documents: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, n_matches) of every document."""

    def make():
        def fn(ids, texts):
            got = [model.judge(t) for t in texts]
            return [ids, [g[0] for g in got], [g[1] for g in got]]

        return fn

    kind = dict(documents.dtypes)[id_column]
    return map_batches(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), make, ["id", "text"], f"id {kind}, score double, n_matches int")
