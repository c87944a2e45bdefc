"""Segmentation of one pixel's series: the kernel behind ``operators.segmentation``.

A series is cut into segments in turns of two steps.  ``Ccdc.grow`` finds the next
window of observations that a model describes well from its first to its last.
``_Track`` follows the series from there: it looks at the next ``consecutive``
observations again and again, until all of one look are far from the model (a
change, which ends the segment) or the series ends.  A look of which only the
first is far takes that one out as noise.

The observations themselves are never copied: what screening and noise removal
leave over is an array of their positions.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np

from chronopix.errors import SeriesTooShort
from chronopix.functions.kernels import EPS, Lasso, fit_bands, fold_intercept, multitemporal_masks, rmse, smooth_mask

YEAR = 365.25
#: At most as many windows are screened together.
AHEAD = 8


@dataclass
class Segment:
    start: int = 0
    end: int = 0
    change: int = 0  # ordinal of the change that ended it, 0 for none
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # bands x features
    rmse: np.ndarray = field(default_factory=lambda: np.zeros(0))
    magnitude: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Observations:
    """A pixel's whole series: design (observations x features), bands x observations, ordinals."""

    x: np.ndarray
    y: np.ndarray
    dates: np.ndarray

    def days(self, a: int, b: int) -> float:
        return abs(float(self.dates[b]) - float(self.dates[a]))


@dataclass
class Ccdc:
    """Parameters of the segmentation; bands are counted from 0."""

    test_indices: list[int] | None = None
    estimator: object = None
    consecutive: int = 5
    threshold: float = 2.56
    min_obs: int | None = None
    min_rmse: float | list[float] | None = None
    retrain_time: float = YEAR
    screening: str = "RLM"
    screening_crit: float = 400.0
    remove_noise: bool = True
    green_band: int = 1
    swir1_band: int = 4
    dynamic_rmse: bool = False
    circular_days: bool = False
    slope_test: float | bool = False
    idx_slope: int = 1

    def __post_init__(self):
        if self.screening not in ("RLM", "LOWESS"):
            raise TypeError(f"unknown screening {self.screening!r}")
        self.estimator = self.estimator or Lasso(alpha=20.0)
        self.min_obs = 16 if self.min_obs is None else self.min_obs
        if self.slope_test is True:
            self.slope_test = self.threshold

    def fit(self, x: np.ndarray, y: np.ndarray, dates: np.ndarray) -> list[Segment]:
        """Segments of a series: x observations x features, y bands x observations, dates ordinals in order."""
        o = Observations(np.asarray(x, float), np.asarray(y, float), np.asarray(dates))
        if not len(o.x) == o.y.shape[1] == len(o.dates):
            raise ValueError("design, observations and dates differ in length")
        kept = np.arange(len(o.dates))
        if self.screening == "LOWESS" and len(kept):  # sees the whole series, so once is enough
            kept = kept[smooth_mask(o.dates, o.y, self.min_obs, self.screening_crit, self.green_band, self.swir1_band)]
        if len(kept) < self.min_obs + self.consecutive:
            raise SeriesTooShort(f"{len(kept)} observations")
        out, first, last = [], 0, self.min_obs
        while window := self.grow(o, kept, first, last):
            track = _Track(self, o, *window)
            at = track.follow()
            out.append(track.segment(at))
            if at is None:
                break
            # a window needs an observation on either side of its first
            kept, first, last = np.array(track.kept), at + 1, at + 2
        return out

    def bands(self, o: Observations) -> list[int]:
        return list(self.test_indices) if self.test_indices else list(range(len(o.y)))

    def floors(self, o: Observations) -> np.ndarray:
        """The least scale of residuals of each band."""
        low = np.finfo(float).tiny if self.min_rmse is None else self.min_rmse
        return np.maximum(np.broadcast_to(np.asarray(low, float), (len(o.y),)), EPS)

    def grow(self, o: Observations, kept: np.ndarray, first: int, last: int) -> tuple[np.ndarray, int, int] | None:
        """(kept, first, last) of the next stable window, screened; None if a whole look no longer fits behind one.

        The window is over a year long and has more observations than features.
        Its end moves on by one each time; its beginning does where it is unstable.
        """
        clear: dict[tuple[int, int], np.ndarray] = {}
        ahead, gone = 1, 0
        for last in range(last, len(kept) - self.consecutive - 1):
            if not self.long(o, kept, first, last):
                continue
            if self.screening == "RLM" and (first, last) not in clear:
                clear, ahead = self.clear(o, kept, first, last, ahead, gone), min(2 * ahead, AHEAD)
            gone = int((~clear[first, last][: last - first]).sum()) if clear else 0
            screened = self.screen(o, kept, first, last, clear)
            if screened is None:
                continue
            if self.stable(o, screened[0][first : screened[1] + 1]):
                return screened[0], first, screened[1]
            first += 1
        return None

    def long(self, o: Observations, kept: np.ndarray, first: int, last: int) -> bool:
        """Whether a window can be long enough; screening leaves none beyond the one before its last, at most."""
        if o.days(kept[first], kept[last]) <= YEAR or last - first < o.x.shape[1]:
            return False
        return self.screening == "LOWESS" or (last - first >= self.min_obs and o.days(kept[first], kept[last - 1]) >= YEAR)

    def clear(self, o: Observations, kept: np.ndarray, first: int, last: int, ahead: int, gone: int) -> dict[tuple[int, int], np.ndarray]:
        """What is clear in a window and in those that follow it if each loses ``gone`` observations and is unstable; they are fitted together."""
        places = []
        while len(places) < ahead and last < len(kept) - self.consecutive - 1:
            if self.long(o, kept, first, last):
                places.append((first, last))
                left = last - first - gone
                first += left >= self.min_obs and o.days(kept[first], kept[first + left - 1]) >= YEAR
            last += 1
        near = [kept[a : b + self.consecutive] for a, b in places]
        bands = [self.green_band, self.swir1_band]
        windows = [(o.dates[n], o.y[bands][:, n], o.days(kept[a], kept[b]) / YEAR) for n, (a, b) in zip(near, places, strict=True)]
        return dict(zip(places, multitemporal_masks(windows, self.screening_crit), strict=True))

    def screen(self, o: Observations, kept: np.ndarray, first: int, last: int, clears: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, int] | None:
        """(kept, last) without clouds and shadows in the window and the look behind it; None if too little is left."""
        if self.screening == "LOWESS":
            return (kept, last) if last - first + 1 >= self.min_obs else None
        near, clear = kept[first : last + self.consecutive], clears[first, last]
        n = int(clear[: last - first].sum())
        # the length in days is that of as many observations before the screening
        if n < self.min_obs or o.days(kept[first], kept[first + n - 1]) < YEAR:
            return None
        return np.concatenate([kept[:first], near[clear], kept[last + self.consecutive :]]), first + n - 1

    def stable(self, o: Observations, rows: np.ndarray) -> bool:
        """Whether models of the test bands fit the first and the last observation, and do not slope if that is tested."""
        low, off, x = self.floors(o), [], o.x[rows]
        bands = self.bands(o)
        for b, model in zip(bands, fit_bands(self.estimator, x, o.y[np.ix_(bands, rows)]), strict=True):
            residual = np.abs(o.y[b, rows] - model.predict(x))
            slope = abs(model.coef_[self.idx_slope] * (len(rows) - 1)) if self.slope_test else 0.0
            off.append(np.array([residual[0], residual[-1], slope]) / max(low[b], float(np.sqrt(np.mean(residual**2)))))
        first, last, slope = np.sqrt((np.array(off) ** 2).sum(axis=0))
        ends = max(first, last)
        return not (ends > self.threshold or (self.slope_test and slope > self.slope_test))


class _Track:
    """The series from a stable window on: models that are refitted now and then, and looks ahead.

    Between two fits an observation's residuals stay the same, and its score does
    unless the scale is seasonal; so they are computed for the whole series at each fit.
    """

    def __init__(self, p: Ccdc, o: Observations, kept: np.ndarray, first: int, last: int):
        self.p, self.o, self.first = p, o, first
        self.kept: list[int] = kept.tolist()  # positions, without noise found on the way
        self.bands, self.low = p.bands(o), p.floors(o)
        self.coef, self.rmse = np.zeros((len(o.y), o.x.shape[1])), np.zeros(len(o.y))
        self.fitted = 0.0  # the date up to which the models have seen the series
        self.far = np.zeros((p.consecutive, len(self.bands)))  # scores of a look that is a change
        self.dates: list[float] = np.asarray(o.dates, float).tolist()
        self.seasons: list[tuple[float, int]] = []  # (day of the year, position) of the segment's observations, in order
        self.seen = first  # the first place that is not yet among them
        self.refit(last + 1)
        self.next = last + 1

    def refit(self, last: int) -> None:
        """Models of all bands on what lies between the first and ``last``, if the present ones are too old."""
        date = self.dates[self.kept[last]]
        if abs(date - self.fitted) <= self.p.retrain_time:
            return
        rows, self.fitted = np.array(self.kept[self.first : last + 1]), date
        x, y = self.o.x[rows], self.o.y[:, rows]
        for b, model in enumerate(fit_bands(self.p.estimator, x, y)):
            self.rmse[b] = rmse(y[b], model.predict(x))
            self.coef[b] = fold_intercept(model)
        # the places of positions before the first one's are of no use
        self.from_ = self.kept[self.first]
        self.residual = self.o.y[self.bands, self.from_ :] - self.coef[self.bands] @ self.o.x[self.from_ :].T
        if self.p.dynamic_rmse:
            self.squares = (self.residual**2).tolist()
            self.values = self.residual.tolist()
        else:
            self.steady = np.maximum(self.low[self.bands], self.rmse[self.bands])
            self.scores = np.sqrt(((self.residual / self.steady[:, None]) ** 2).sum(axis=0)).tolist()

    def follow(self) -> int | None:
        """Looks ahead from observation to observation; the place where a change is, or None at the series' end."""
        kept, n, p = self.kept, self.p.consecutive, self.p
        while self.next < len(kept) - n - 1:
            self.refit(self.next)
            far = self.score(kept[self.next], scale := self.scales()) > p.threshold
            if far and all(self.score(k, scale) > p.threshold for k in kept[self.next + 1 : self.next + n]):
                self.far = (self.residual[:, np.array(kept[self.next : self.next + n]) - self.from_] / np.array(scale)[:, None]).T
                return self.next
            if far and p.remove_noise:
                del kept[self.next]
            else:
                self.next += 1
        # too few are left for another look, but the models still see them
        for last in range(self.next + 1, len(kept)):
            self.refit(last)
        return None

    def scales(self) -> list[float] | np.ndarray:
        """The scale of residuals of each test band in the present look."""
        return self.seasonal_rmse() if self.p.dynamic_rmse else self.steady

    def score(self, position: int, scale: list[float]) -> float:
        """How far an observation is from the models, over all test bands."""
        k = position - self.from_
        if not self.p.dynamic_rmse:
            return self.scores[k]
        return math.sqrt(sum((v[k] / s) ** 2 for v, s in zip(self.values, scale, strict=True)))

    def seasonal_rmse(self) -> list[float]:
        """The residual scale of the segment's observations that are nearest in the season to the end of the look."""
        kept, seasons, n = self.kept, self.seasons, self.p.min_obs
        while self.seen < self.next:
            insort(seasons, (self.dates[kept[self.seen]] % YEAR, kept[self.seen]))
            self.seen += 1
        day = self.dates[kept[min(self.next + self.p.consecutive, len(kept) - 1)]] % YEAR
        k = bisect_left(seasons, (day, -1))
        near = seasons[k : k + n]  # those on or after that day, then the next year's
        near += seasons[: min(k, n - len(near))]
        if self.p.circular_days:
            before = seasons[max(0, k - n) : k]
            before = seasons[len(seasons) - min(n - len(before), len(seasons) - k) :] + before if len(before) < n else before
            apart = {position: min((d - day) % YEAR, (day - d) % YEAR) for d, position in (*near, *before)}
            rows = sorted(apart, key=lambda position: (apart[position], position))[:n]
        else:
            rows = [position for _, position in near]
        low = self.low[self.bands].tolist()
        return [max(floor, math.sqrt(sum(v[r - self.from_] for r in rows) / len(rows))) for floor, v in zip(low, self.squares, strict=True)]

    def segment(self, at: int | None) -> Segment:
        """Up to a change at ``at``; without one up to the last observation that began a whole look."""
        date = lambda k: int(self.o.dates[self.kept[k]])
        magnitude = np.zeros(len(self.o.y))
        if at is None:
            return Segment(date(self.first), date(max(self.first, len(self.kept) - self.p.consecutive - 2)), 0, self.coef, self.rmse, magnitude)
        magnitude[self.bands] = self.far.mean(axis=0)
        return Segment(date(self.first), date(at), date(at + 1), self.coef, self.rmse, magnitude)
