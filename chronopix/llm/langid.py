"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the character 1- to 4-grams of the lower-cased text in which every
run of non-letters is one space; those with a space inside are left out, so they
lie in one word, its ends included.  Each hashes to a bucket with an embedding;
a text is the average of its subwords' embeddings, and a linear layer with
softmax gives its languages.  Trained by mini-batch stochastic gradient descent
in NumPy on a bounded, documented sample.  A held-out fifth of the sample sets
the temperature that calibrates the probabilities and the confidence under
which a prediction is rejected: the level that at most ``max_rejected`` of that
fifth's rightly named texts fall below, never over ``reject_most``.

Defined results: null texts and texts with no letter are ``und`` with score 0
and rejected; empty training data give ``und`` for every text; very long texts
are read whole, in slices of 65,536 characters; repeated rows, ties (the first
language in sorted order) and other columns make no difference.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.llm.common import bounded_rows, filter_batches, map_batches

BUCKETS = 1 << 15  # two bytes name one
SIZES = (1, 2, 3, 4)
_NO_LETTER = re.compile(r"[\W\d_]+")
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))
_SLICE = 65_536


def letters(text: str | None) -> str:
    """The lower-cased text with one space for every run of what is no letter; '' without letters."""
    out = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    # word characters that are neither letters nor decimal digits: superscripts, fractions, numerals in circles
    if odd := [c for c in set(out) if c != " " and not c.isalpha()]:
        out = " ".join(out.translate(dict.fromkeys(map(ord, odd), " ")).split())
    return out


def subwords(text: str | None) -> list[np.ndarray]:
    """Buckets of all subwords, one array per slice; empty if the text has no letter."""
    clean = letters(text)
    if not clean:
        return []
    out = []
    clean = f" {clean} "
    for at in range(0, len(clean), _SLICE):
        # slices overlap by three characters, so that no subword is lost
        part = clean[max(0, at - 3) : at + _SLICE]
        skip = at - max(0, at - 3)
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = code == 32
        h = np.zeros(len(code), np.uint32)
        for n in SIZES:
            # h[i]: hash of the n characters from i on
            h = (h[: len(code) - n + 1] if n > 1 else h) ^ (code[n - 1 :] + np.uint32(n)) * _MULTIPLIERS[n - 1]
            if n == 1:
                ok = ~space
            elif n == 2:
                ok = ~(space[:-1] & space[1:])
            else:
                inner = space[1 : len(code) - n + 2].copy()
                for k in range(2, n - 1):
                    inner |= space[k : len(code) - n + 1 + k]
                ok = ~inner
            if skip:
                ok = ok.copy()
                ok[: max(0, skip - n + 1)] = False
            mixed = h * np.uint32(0x2C1B3C6D)
            out.append(((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1))[ok])
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        parts = subwords(text)
        n = sum(map(len, parts))
        if not n:
            return None
        total = np.zeros(len(self.languages))
        for p in parts:
            total += np.ones(len(p), np.float32) @ self.table[p]
        return total / n + self.bias

    def probabilities(self, text: str | None) -> np.ndarray | None:
        z = self.logits(text)
        if z is None:
            return None
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        p = self.probabilities(text) if self.languages else None
        if p is None:
            return "und", 0.0, True
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.reject_below)


def train(texts: list[str], languages: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, batch: int = 64, max_rejected: float = 0.001, reject_most: float = 0.5, seed: int = 3) -> LanguageModel:
    """Fit on texts with their languages (texts without letters are left out)."""
    # of each text its buckets and their shares only: all its subwords would be many times its size
    bags, spoken = [], []
    for text, lang in zip(texts, languages, strict=True):
        parts = subwords(text)
        if parts and (n := sum(map(len, parts))):
            b, c = np.unique(np.concatenate(parts), return_counts=True)
            bags.append((b.astype(np.uint16), (c / n).astype(np.float32)))
            spoken.append(lang)
    names = sorted(set(spoken))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(lang) for lang in spoken])
    order = rng.permutation(len(bags))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    lin, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    weight = 1 / np.maximum(np.bincount(y[fit], minlength=len(names)), 1)
    weight *= len(fit) / weight[y[fit]].sum()
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in rows])
            share = np.concatenate([bags[i][1] for i in rows])
            own = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            mean = np.zeros((len(rows), dim), np.float32)
            taken = emb[ids]
            for d in range(dim):
                mean[:, d] = np.bincount(own, share * taken[:, d], len(rows))
            z = mean @ lin + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None]
            back = (p @ lin.T).astype(np.float32)
            lin -= step * (mean.T @ p) / len(rows) * 8
            bias -= step * p.mean(axis=0)
            move = share[:, None] * back[own] * (step * 4)
            for d in range(dim):
                emb[:, d] -= np.bincount(ids, move[:, d], BUCKETS)
        fit = rng.permutation(fit)
    model = LanguageModel(names, (emb @ lin).astype(np.float32), bias.astype(np.float64))
    if not len(held):
        return model
    z = np.array([(c[:, None] * model.table[b]).sum(axis=0) + model.bias for b, c in (bags[i] for i in held)], float)
    z -= z.max(axis=1, keepdims=True)

    def loss(t: float) -> float:
        q = z / t
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(held)), y[held]]).mean())

    model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
    q = np.exp(z / model.temperature)
    q /= q.sum(axis=1, keepdims=True)
    right = np.sort(q.max(axis=1)[q.argmax(axis=1) == y[held]])
    if len(right):
        model.reject_below = float(min(reject_most, right[int(max_rejected * len(right))]))
    return model


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most: int = 4000) -> LanguageModel:
    """Train on about ``most`` rows (chosen by a hash of the id) with a text and a language."""
    usable = documents.where(F.col(lang_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.col(lang_column).alias("_lang"))
    rows = bounded_rows(usable.where("_text is not null"), ["_id", "_text"], most, usable).collect()
    rows.sort(key=lambda r: (r["_id"], r["_lang"], r["_text"]))
    return train([r["_text"] for r in rows], [r["_lang"] for r in rows])


def identify(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every document."""

    def make():
        def fn(ids, texts):
            got = [model.predict(t) for t in texts]
            return [ids, *([g[k] for g in got] for k in range(3))]

        return fn

    kind = dict(documents.dtypes)[id_column]
    return map_batches(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), make, ["id", "text"], f"id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The documents, all columns, whose language the model does not reject."""
    return filter_batches(documents, lambda: lambda texts: [not model.predict(t)[2] for t in texts], text_column)
