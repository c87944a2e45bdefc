"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its characters, words and repetition, and those of
the line before and behind it.  A chain with two states, good and bad, is
trained by gradient steps on the conditional likelihood (forward-backward in
NumPy, documents of like length together).  Labels exist for documents only, so
lines begin with their document's label; after the first fit, lines of bad
documents that the model finds clearly good are taken as good, and the chain is
fitted again.  A document's quality is the mean of its lines' forward-backward
marginals of good, weighted by length, through a logistic calibration on rows
the chain was not fitted on.  Fitted on a bounded, documented sample.

Defined results: null, empty and blank texts have one empty line and a score;
very long texts and lines are read whole; repeated rows and other columns make
no difference; without labelled rows (or with one label only) every score is the
share of good labels, or 0.5 if there are none; with too few labelled rows to
set some of both kinds apart, fit and calibration share them.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.llm.common import filter_batches, labelled_texts, map_batches

# character classes of code points below 0x250, and what is above
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _MARK, _SYMBOL, _FAR = range(9)
_CLASS = np.array([_SPACE if chr(c).isspace() else _UPPER if chr(c).isupper() else _LOWER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _POINT if chr(c) in ".,;:'\"-()?" else _MARK if chr(c) == "!" else _SYMBOL if chr(c) in "#*$%&|<>@^~_=+{}[]\\/" else _OTHER for c in range(0x250)] + [_FAR], np.int64)
OWN = 16


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features of the line itself, lengths of the lines + 1)."""
    text = text or ""
    lines = text.split("\n")
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x250).astype(np.int64)
    of_line = np.cumsum(code == 10) - (code == 10)  # a line end belongs to its line
    counts = np.bincount(of_line * 9 + _CLASS[code], minlength=9 * len(lines)).reshape(-1, 9)[: len(lines)].astype(float)
    counts[:-1, _SPACE] -= 1  # the line end itself
    chars = counts.sum(axis=1)
    ink = np.maximum(chars - counts[:, _SPACE], 1)
    letters = np.maximum(counts[:, _LOWER] + counts[:, _UPPER] + counts[:, _FAR], 1)
    out = np.zeros((len(lines), OWN))
    out[:, 0] = np.log1p(chars) / 5
    out[:, 1] = counts[:, _UPPER] / letters
    out[:, 2] = counts[:, _DIGIT] / ink
    out[:, 3] = counts[:, _POINT] / ink * 5
    out[:, 4] = counts[:, _MARK] / ink * 5
    out[:, 5] = counts[:, _SYMBOL] / ink * 3
    out[:, 6] = (counts[:, _FAR] + counts[:, _OTHER]) / ink
    seen: set[str] = set()
    total = Counter(lines)
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if not n:
            out[k, 7] = 1
            continue
        kinds = set(words)
        out[k, 8] = min(3.0, (ink[k] / n) / 5)
        out[k, 9] = (1 - len(kinds) / n) * min(1.0, n / 10)
        out[k, 10] = sum(map(str.__eq__, words, words[1:])) / n * 2
        out[k, 11] = line in seen
        out[k, 12] = line.rstrip()[-1:] in ".!?"
        out[k, 13] = words[0][:1].isupper()
        if n >= 6:
            pairs = len(set(zip(words, words[1:], strict=False)))
            out[k, 14] = 1 - pairs / (n - 1)
        out[k, 15] = total[line] > 1
        seen.add(line)
    return out, chars + 1


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and behind, flags of the first and last line, one constant."""
    zero = np.zeros((1, own.shape[1]))
    first, last = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    first[0] = last[-1] = 1
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), first, last, np.ones((len(own), 1))])


WIDTH = 3 * OWN + 3


def forward_backward(unary: np.ndarray, keep: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains, unary (docs x lines: score of good over bad), keep (docs x lines: 1 where a line is).

    Gives log likelihood terms' normaliser, marginals of good (docs x lines) and
    expected transitions (2 x 2, summed).  State 1 is good.
    """
    n, t = unary.shape
    alpha, beta = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    score = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha[0] = score[:, 0]
    for k in range(1, t):
        step = np.stack([np.logaddexp(alpha[k - 1, :, 0] + trans[0, j], alpha[k - 1, :, 1] + trans[1, j]) for j in (0, 1)], axis=1) + score[:, k]
        alpha[k] = np.where(keep[:, k, None] > 0, step, alpha[k - 1])
    for k in range(t - 2, -1, -1):
        nxt = beta[k + 1] + score[:, k + 1]
        step = np.stack([np.logaddexp(nxt[:, 0] + trans[i, 0], nxt[:, 1] + trans[i, 1]) for i in (0, 1)], axis=1)
        beta[k] = np.where(keep[:, k + 1, None] > 0, step, beta[k + 1])
    norm = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    good = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - norm)).T
    moves = np.zeros((2, 2))
    for k in range(1, t):
        live = keep[:, k] > 0
        for i in (0, 1):
            for j in (0, 1):
                p = alpha[k - 1, :, i] + trans[i, j] + score[:, k, j] + beta[k, :, j] - norm
                moves[i, j] += np.exp(np.minimum(0, p[live])).sum()
    return norm, good, moves


@dataclass
class QualityModel:
    weights: np.ndarray | None = None
    trans: np.ndarray | None = None
    calibration: tuple[float, float] = (0.0, 1.0)
    constant: float = 0.5

    def lines(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of good, length) of every line of a text."""
        own, length = line_features(text)
        if self.weights is None:
            return np.full(len(own), self.constant), length
        unary = with_neighbours(own) @ self.weights
        if len(unary) == 1:
            return 1 / (1 + np.exp(-unary)), length
        # the chain's recursion on plain numbers, rescaled at each line
        e = np.exp(np.clip(unary, -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.trans).tolist()
        n = len(e)
        forward, x, y = [], 1 / (1 + e[0]), e[0] / (1 + e[0])
        forward.append((x, y))
        for k in range(1, n):
            x, y = x * bb + y * gb, (x * bg + y * gg) * e[k]
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
        good = [0.0] * n
        p, q = 1.0, 1.0
        for k in range(n - 1, -1, -1):
            x, y = forward[k]
            good[k] = y * q / (x * p + y * q)
            p, q = bb * p + bg * e[k] * q, gb * p + gg * e[k] * q
            s = p + q
            p, q = p / s, q / s
        return np.array(good), length

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        good, length = self.lines(text)
        return _sigmoid(self.calibration[0] + self.calibration[1] * _logit((good * length).sum() / length.sum()))


def _logit(p: float) -> float:
    p = min(max(float(p), 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


#: Lines that a training batch holds at most, padding included; longer documents are fitted in parts of ``_PART`` lines.
_CELLS, _PART = 1 << 16, 1 << 10


def _batches(docs: list[np.ndarray], states: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of like length together, padded to the longest: features, states, where a line is."""
    parts = [(x[at : at + _PART], y[at : at + _PART]) for x, y in zip(docs, states, strict=True) for at in range(0, len(x), _PART)]
    parts.sort(key=lambda p: len(p[0]))
    out, at = [], 0
    while at < len(parts):
        end = at + 1
        while end < len(parts) and end - at < 128 and (end - at + 1) * len(parts[end][0]) <= _CELLS:
            end += 1
        t = len(parts[end - 1][0])
        x, y, keep = np.zeros((end - at, t, WIDTH)), np.zeros((end - at, t)), np.zeros((end - at, t))
        for r, (a, b) in enumerate(parts[at:end]):
            x[r, : len(a)], y[r, : len(a)], keep[r, : len(a)] = a, b, 1
        out.append((x, y, keep))
        at = end
    return out


def _fit_chain(docs: list[np.ndarray], states: list[np.ndarray], weights: np.ndarray, trans: np.ndarray, epochs: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    batches = _batches(docs, states)
    m = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))]
    rng, step = np.random.default_rng(11), 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            x, y, keep = batches[b]
            _, good, moves = forward_backward(x @ weights * keep, keep, trans)
            seen = np.zeros((2, 2))
            both = keep[:, 1:] > 0
            for i in (0, 1):
                for j in (0, 1):
                    seen[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()
            n = keep.sum()
            gw = (((y - good) * keep)[:, :, None] * x).sum(axis=(0, 1)) / n - ridge * weights
            gt = (seen - moves) / n - ridge * trans
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, g, a, s in ((weights, gw, m[0], m[1]), (trans, gt, m[2], m[3])):
                a *= 0.9
                a += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                p += now * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return weights, trans


def train(texts: list[str], labels: list[int], epochs: int = 25, rate: float = 0.05, ridge: float = 1e-4, seed: int = 9) -> QualityModel:
    """Fit on whole texts with document labels (1 good)."""
    if len(set(labels)) < 2:
        return QualityModel(constant=float(labels[0]) if labels else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, rows = order[: len(order) // 4], order[len(order) // 4 :]
    if len({labels[i] for i in rows}) < 2 or len({labels[i] for i in held}) < 2:
        held = rows = order  # too few to set some apart for the calibration
    docs = [with_neighbours(line_features(texts[i])[0]) for i in rows]
    states = [np.full(len(x), labels[i], float) for x, i in zip(docs, rows, strict=True)]
    weights, trans = _fit_chain(docs, states, np.zeros(WIDTH), np.array([[0.5, -0.5], [-0.5, 0.5]]), epochs, rate, ridge)
    draft = QualityModel(weights.copy(), trans.copy())
    for k, i in enumerate(rows):
        if not labels[i]:
            good, _ = draft.lines(texts[i])
            states[k] = ((good > 0.8) & (good > good.min())).astype(float)
    weights, trans = _fit_chain(docs, states, weights, trans, epochs, rate / 2, ridge)
    model = QualityModel(weights, trans)
    x = []
    for i in held:
        good, length = model.lines(texts[i])
        x.append((1.0, _logit((good * length).sum() / length.sum())))
    x, y, w = np.array(x), np.array([labels[i] for i in held], float), np.array([0.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * (w - np.array([0.0, 1.0])))
    model.calibration = (float(w[0]), float(w[1]))
    return model


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most: int = 5000) -> QualityModel:
    """Train on about ``most`` labelled documents, chosen by a hash of the id."""
    return train(*labelled_texts(documents, labels, id_column, text_column, label_column, most))


def score(documents: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, n_lines) of every document."""

    def make():
        def fn(ids, texts):
            return [ids, [model.score(t) for t in texts], [(t or "").count("\n") + 1 for t in texts]]

        return fn

    kind = dict(documents.dtypes)[id_column]
    return map_batches(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), make, ["id", "text"], f"id {kind}, score double, n_lines int")


def keep_good(documents: DataFrame, model: QualityModel, text_column: str = "text", reject_below: float = 0.3) -> DataFrame:
    """The documents, all columns, with a score of ``reject_below`` or more."""
    return filter_batches(documents, lambda: lambda texts: [model.score(t) >= reject_below for t in texts], text_column)
