"""The segmentation against a naive one, written from its rules with lists and least squares from NumPy."""

import numpy as np
import pytest

from chronopix.errors import SeriesTooShort
from chronopix.functions import kernels as K
from chronopix.functions.ccdc import Ccdc

YEAR = 365.25


def line(x, y):
    return np.linalg.lstsq(x, y, rcond=None)[0]


def naive(x, y, dates, consecutive=5, threshold=4.0, min_obs=16, min_rmse=20.0, crit=900.0, test=(2, 3, 4), noise=True, dynamic=False, circular=False, slope=None, retrain=YEAR, lowess=False):
    """[(start, end, change, coefficients, rmse, magnitude)], by the rules."""
    rows = list(range(len(dates)))
    if lowess:
        keep = K.smooth_mask(dates, y, min_obs, crit)
        rows = [r for r in rows if keep[r]]
    if len(rows) < min_obs + consecutive:
        return None
    found, begin, now = [], 0, min_obs
    while True:
        # 1. the first end of a window for which everything holds
        window = None
        while window is None and now <= len(rows) - consecutive - 2:
            span = dates[rows[now]] - dates[rows[begin]]
            if span > YEAR and now - begin >= x.shape[1]:
                clean, end = rows, now
                good = now - begin + 1 >= min_obs
                if not lowess:
                    near = rows[begin : now + consecutive]
                    mask = K.multitemporal_mask(dates[near], y[:, near], span / YEAR, crit)
                    n = sum(mask[: now - begin])
                    good = n >= min_obs and dates[rows[begin + n - 1]] - dates[rows[begin]] >= YEAR
                    clean, end = rows[:begin] + [r for r, m in zip(near, mask, strict=True) if m] + rows[now + consecutive :], begin + n - 1
                if good:
                    own = clean[begin : end + 1]
                    worst = []
                    for b in test:
                        beta = line(x[own], y[b, own])
                        e = y[b, own] - x[own] @ beta
                        s = max(min_rmse, np.sqrt((e**2).mean()))
                        worst.append((e[0] / s, e[-1] / s, beta[1] * (end - begin) / s))
                    size = np.sqrt((np.array(worst) ** 2).sum(axis=0))
                    if max(size[0], size[1]) > threshold or (slope and size[2] > slope):
                        begin += 1
                    else:
                        window = clean, end
            now += 1
        if window is None:
            return found
        rows, now = list(window[0]), window[1] + 1
        # 2. looks ahead
        seen, models = None, None

        def fit(upto):
            own = rows[begin : upto + 1]  # noqa: B023
            betas = [line(x[own], y[b, own]) for b in range(len(y))]
            return betas, [np.sqrt(((y[b, own] - x[own] @ beta) ** 2).mean()) for b, beta in enumerate(betas)]

        def old(upto):
            return seen is None or dates[rows[upto]] - seen > retrain  # noqa: B023

        if old(now):
            models, seen = fit(now), dates[rows[now]]
        change = None
        while change is None and now <= len(rows) - consecutive - 2:
            if old(now):
                models, seen = fit(now), dates[rows[now]]
            scores = []
            for r in rows[now : now + consecutive]:
                one = []
                for b in test:
                    s = models[1][b]
                    if dynamic:
                        at = dates[rows[min(now + consecutive, len(rows) - 1)]]
                        apart = [((dates[q] - at) % YEAR, q) for q in rows[begin:now]]
                        if circular:
                            apart = [(min(a, YEAR - a), q) for a, q in apart]
                        near = [q for _, q in sorted(apart, key=lambda t: t[0])[:min_obs]]
                        s = np.sqrt(np.mean([(y[b, q] - x[q] @ models[0][b]) ** 2 for q in near]))
                    one.append((y[b, r] - x[r] @ models[0][b]) / max(min_rmse, s))
                scores.append(one)
            far = [np.sqrt(sum(v * v for v in one)) > threshold for one in scores]
            if all(far):
                change = now
            elif far[0] and noise:
                del rows[now]
            else:
                now += 1
        if change is None:
            for k in range(now + 1, len(rows)):
                if old(k):
                    models, seen = fit(k), dates[rows[k]]
            found.append((dates[rows[begin]], dates[rows[max(begin, len(rows) - consecutive - 2)]], 0, *models, np.zeros(len(y))))
            return found
        magnitude = np.zeros(len(y))
        magnitude[list(test)] = np.mean(scores, axis=0)
        found.append((dates[rows[begin]], dates[rows[change]], dates[rows[change + 1]], *models, magnitude))
        begin, now = change + 1, change + 2


def random_series(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(30, 220))
    dates = 730000 + np.cumsum(r.integers(4, 30, n))
    w = 2 * np.pi / YEAR
    x = np.column_stack([np.ones(n), (dates - 733000) / 100, np.cos(w * dates), np.sin(w * dates)])
    y = np.vstack([1000 + 300 * np.cos(w * dates + k) + r.normal(size=n) * 20 for k in range(5)])
    for s in r.integers(0, n, int(r.integers(0, 3))):
        y[:, s:] += r.choice([-1, 1]) * r.integers(100, 2000)
    for s in r.integers(0, n, int(r.integers(0, 9))):
        y[:, s] += r.normal() * 1500
    return x, y, dates


VARIANTS = [
    ({}, {}),
    ({"remove_noise": False}, {"noise": False}),
    ({"dynamic_rmse": True}, {"dynamic": True}),
    ({"dynamic_rmse": True, "circular_days": True, "consecutive": 3}, {"dynamic": True, "circular": True, "consecutive": 3}),
    ({"slope_test": True}, {"slope": 4.0}),
    ({"screening": "LOWESS"}, {"lowess": True}),
    ({"retrain_time": 90.0, "min_obs": 12}, {"retrain": 90.0, "min_obs": 12}),
]


@pytest.mark.parametrize("more, naive_more", VARIANTS)
def test_segments_equal_the_naive_ones(more, naive_more):
    n = changes = 0
    for seed in range(100):
        x, y, dates = random_series(seed)
        p = Ccdc(**({"test_indices": [2, 3, 4], "threshold": 4.0, "min_rmse": 20.0, "screening_crit": 900.0, "estimator": K.Ols()} | more))
        expected = naive(x, y, dates, **naive_more)
        try:
            got = p.fit(x, y, dates)
        except SeriesTooShort:
            got = None
        assert (got is None) == (expected is None)
        if got is None:
            continue
        assert [(s.start, s.end, s.change) for s in got] == [e[:3] for e in expected]
        for s, e in zip(got, expected, strict=True):
            assert s.coef == pytest.approx(np.array(e[3]), rel=1e-6, abs=1e-6) and s.rmse == pytest.approx(np.array(e[4]), rel=1e-6) and s.magnitude == pytest.approx(e[5], rel=1e-6, abs=1e-9)
        n, changes = n + len(got), changes + sum(s.change > 0 for s in got)
    assert n > 80 and changes > 15


@pytest.mark.parametrize("more", [v[0] for v in VARIANTS])
def test_segments_are_in_order_and_apart(more):
    for seed in range(100, 140):
        x, y, dates = random_series(seed)
        try:
            got = Ccdc(**({"test_indices": [2, 3, 4], "threshold": 4.0, "min_rmse": 20.0, "screening_crit": 900.0} | more)).fit(x, y, dates)
        except SeriesTooShort:
            continue
        assert all(s.start <= s.end and (s.change == 0 or s.change > s.end) for s in got)
        assert all(a.change and a.end < a.change <= b.start for a, b in zip(got, got[1:], strict=False))
        assert all((s.magnitude[:2] == 0).all() and bool(s.magnitude.any()) == bool(s.change) for s in got)


def test_windows_screened_together_are_as_one_by_one():
    from chronopix.functions.kernels import multitemporal_mask, multitemporal_masks

    r = np.random.default_rng(8)
    windows = []
    for n in (25, 40, 90):
        x = 729000 + np.sort(r.choice(900, n, replace=False))
        y = r.normal(size=(2, n)) * 50 + 300 * np.cos(x / 58)
        y[0, 3], y[1, n // 2] = 5000, -5000
        windows.append((x, y, (x[-1] - x[0]) / 365.25))
    together = multitemporal_masks(windows)
    for (x, y, years), clear in zip(windows, together, strict=True):
        assert np.flatnonzero(~clear).tolist() == [3, len(x) // 2] and (clear == multitemporal_mask(x, y, years, green=0, swir1=1)).all()
