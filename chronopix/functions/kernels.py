"""Numerical kernels in NumPy: regressions, tests, smoothers.  No Spark here."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from chronopix.errors import UnknownAlgorithm

EPS = float(np.finfo(float).eps)


def rmse(y: np.ndarray, fitted: np.ndarray) -> float:
    return float(np.sqrt(np.mean((np.asarray(y) - fitted) ** 2)))


def median(v: np.ndarray) -> float:
    """np.median of a short series, which spends most of its time on checks; NaN if there is one."""
    n = len(v)
    v = np.sort(v)
    return float(v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2) if n and not math.isnan(v[-1]) else math.nan


def mad(resid: np.ndarray, constant: float = 0.6745) -> float:
    """Median absolute deviation from the median, scaled to a standard deviation."""
    resid = np.asarray(resid, float)
    return median(np.abs(resid - median(resid))) / constant


def bisquare(resid: np.ndarray, c: float = 4.685) -> np.ndarray:
    """Tukey's weights."""
    return np.where(np.abs(resid) < c, (1 - (resid / c) ** 2) ** 2, 0.0)


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """OLS coefficients.  A constant column, if there is one, takes the means of the others out first."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    flat = np.ptp(x, axis=0) == 0 if len(x) else np.zeros(x.shape[1], bool)
    const = np.flatnonzero(flat & (x[0] != 0)) if len(x) else []
    if len(const):
        k = int(const[0])
        rest = [j for j in range(x.shape[1]) if j != k]
        mean_x, mean_y = x[:, rest].mean(axis=0), y.mean(axis=0)
        b = np.linalg.lstsq(x[:, rest] - mean_x, y - mean_y, rcond=None)[0]
        out = np.zeros((x.shape[1], *y.shape[1:]))
        out[rest] = b
        out[k] = (mean_y - mean_x @ b) / x[0, k]
        return out
    return np.linalg.lstsq(x, y, rcond=None)[0]


@dataclass
class Ols:
    """Ordinary least squares; the constant column holds the intercept."""

    intercept_: float = 0.0
    coef_: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x, y) -> "Ols":
        self.coef_ = least_squares(x, y)
        return self

    def predict(self, x) -> np.ndarray:
        return np.asarray(x) @ self.coef_ + self.intercept_

    def fresh(self):
        return type(self)(**{k: v for k, v in self.__dict__.items() if not k.endswith("_")})


@dataclass
class Rlm(Ols):
    """Robust regression by iteratively reweighted least squares.

    Weight function and scale estimate are parameters.  Converged when no
    coefficient moves by more than ``tol``; ``one_sided`` counts falling ones only.
    """

    weight: Callable = bisquare
    tune: float = 4.685
    scale: Callable = mad
    scale_constant: float = 0.6745
    update_scale: bool = True
    maxiter: int = 50
    tol: float = 1e-8
    one_sided: bool = False

    def fit(self, x, y) -> "Rlm":
        self.coef_ = self.fit_rows(x, np.asarray(y, float)[None])[0]
        return self

    def fit_rows(self, x, y) -> np.ndarray:
        """Coefficients for each row of y, all rows together."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        return self.fit_windows(x[None], y[None], np.ones((1, len(x)), bool))[0]

    def fit_windows(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Coefficients (windows x rows x features) for designs (windows x observations x features), rows of
        values of each (windows x rows x observations) and which observations there are; all together."""
        coef = np.array([least_squares(a[u], v[:, u].T).T for a, v, u in zip(x, y, used, strict=True)])
        back, solve, there = x.transpose(0, 2, 1), _Weighted(x * used[:, :, None]), used[:, None, :]
        resid = y - coef @ back
        scale = self.scales(resid, used)
        active = ~(scale < EPS)  # those that have not converged
        for _ in range(1, self.maxiter):
            if not active.any():
                break
            new = solve(self.weight(resid / np.where(active, scale, 1.0)[:, :, None], self.tune) * there, y)
            new = np.where(active[:, :, None], new, coef)
            moved = coef - new if self.one_sided else np.abs(coef - new)
            coef, resid = new, y - new @ back
            if self.update_scale:
                scale = np.where(active, np.maximum(EPS, self.scales(resid, used)), scale)
            active = active & (moved > self.tol).any(axis=2)
        return coef

    def scales(self, resid: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The scale of each window's rows."""
        if self.scale is not mad:
            return np.array([[self.scale(r[u], self.scale_constant) for r in rows] for rows, u in zip(resid, used, strict=True)])
        n, there = used.sum(axis=1), used[:, None, :]
        low, high, window = (n - 1) // 2, n // 2, np.arange(len(n))

        def middle(v: np.ndarray) -> np.ndarray:
            v = np.sort(np.where(there, v, np.inf), axis=2)
            return (v[window, :, low] + v[window, :, high]) / 2

        return middle(np.abs(resid - middle(resid)[:, :, None])) / self.scale_constant


class _Weighted:
    """Weighted least squares of a design for each window, for rows of weights and values.

    Normal equations of the scaled columns; where they are near to singular or few weights are left, by singular values.
    """

    LIMIT = 1e7

    def __init__(self, x: np.ndarray):
        self.x = x
        g, n, p = x.shape
        size = np.sqrt((x * x).sum(axis=1))
        self.size = np.where(size > 0, size, 1.0)[:, None, :]
        self.z = x / self.size
        self.products = (self.z[:, :, :, None] * self.z[:, :, None, :]).reshape(g, n, p * p)

    def __call__(self, w: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = self.x.shape[2]
        gram = (w @ self.products).reshape(*w.shape[:2], p, p)
        try:
            inverse = np.linalg.inv(gram)
            bad = ~(gram.max(axis=(2, 3)) * np.abs(inverse).max(axis=(2, 3)) * p * p < self.LIMIT) | ((w > 0).sum(axis=2) < 2 * p)
            out = (inverse @ ((w * y) @ self.z)[..., None])[..., 0] / self.size
        except np.linalg.LinAlgError:
            bad, out = np.ones(w.shape[:2], bool), np.empty((*w.shape[:2], p))
        for k, r in zip(*np.nonzero(bad), strict=True):
            root = np.sqrt(w[k, r])
            out[k, r] = np.linalg.lstsq(self.x[k] * root[:, None], y[k, r] * root, rcond=None)[0]
        return out


@dataclass
class Lasso(Ols):
    """L1-penalised least squares by coordinate descent on the centred Gram matrix.

    Minimises |y - b0 - Xb|^2 / (2 n) + alpha |b|_1; constant columns get 0 and the
    intercept is free.
    """

    alpha: float = 20.0
    max_iter: int = 1000
    tol: float = 1e-4

    def fit(self, x, y) -> "Lasso":
        x, y = np.asarray(x, float), np.asarray(y, float)
        n, p = x.shape
        mean_x, mean_y = x.mean(axis=0), y.mean()
        xc, yc = x - mean_x, y - mean_y
        gram, xy = xc.T @ xc, xc.T @ yc
        diag = np.diag(gram).tolist()
        b, limit, total = [0.0] * p, self.alpha * n, float(yc @ yc)
        live = [j for j in range(p) if diag[j] > 1e-12 * max(1.0, mean_x[j] ** 2 * n)]
        g = gram.tolist()
        r = xy.tolist()  # x'(y - Xb)
        for _ in range(self.max_iter):
            change = largest = 0.0
            for j in live:
                old = b[j]
                rho = r[j] + diag[j] * old
                new = (rho - limit if rho > limit else rho + limit if rho < -limit else 0.0) / diag[j]
                if new != old:
                    d, row = new - old, g[j]
                    for k in live:
                        r[k] -= row[k] * d
                    b[j] = new
                    change = max(change, abs(d))
                largest = max(largest, abs(new))
            if largest == 0 or change / largest < self.tol:
                # the duality gap, as the usual stopping rule
                bv = np.array(b)
                rss = total - 2 * bv @ xy + bv @ gram @ bv
                top = max((abs(r[j]) for j in live), default=0.0)
                scale = 1.0 if top <= limit else limit / top
                ry = total - bv @ xy
                gap = 0.5 * rss * (1 + scale**2) + limit * np.abs(bv).sum() - scale * ry
                if gap < self.tol * total or change == 0:
                    break
        self.coef_ = np.array(b)
        self.intercept_ = float(mean_y - mean_x @ self.coef_)
        return self


@dataclass
class LassoCV(Ols):
    """Lasso whose alpha, of a grid, has the least mean squared error over contiguous folds."""

    alphas: tuple[float, ...] = tuple(np.logspace(1e-4, 35, 50))
    folds: int = 3
    alpha_: float = 0.0

    def fit(self, x, y) -> "LassoCV":
        x, y = np.asarray(x, float), np.asarray(y, float)
        parts = [p for p in np.array_split(np.arange(len(y)), min(self.folds, len(y))) if len(p)]
        errors = []
        for alpha in self.alphas:
            if len(parts) < 2:
                errors.append(0.0)
                continue
            total = 0.0
            for p in parts:
                rest = np.setdiff1d(np.arange(len(y)), p)
                total += float(np.mean((y[p] - Lasso(alpha=alpha).fit(x[rest], y[rest]).predict(x[p])) ** 2))
            errors.append(total)
        self.alpha_ = float(self.alphas[int(np.argmin(errors))])
        best = Lasso(alpha=self.alpha_).fit(x, y)
        self.coef_, self.intercept_ = best.coef_, best.intercept_
        return self


#: Estimators by name.
ESTIMATORS: dict[str, Callable[[], Ols]] = {
    "ols": Ols,
    "lasso20": Lasso,
    "lassocv": LassoCV,
    "rlm": Rlm,
    "rlm_maxiter10": lambda: Rlm(maxiter=10),
    "glmnet_lasso20": Lasso,
    "glmnet_lassocv": LassoCV,
}


def estimator(name: str) -> Ols:
    """A new estimator of a registered name (any case)."""
    try:
        return ESTIMATORS[name.lower()]()
    except KeyError:
        raise UnknownAlgorithm(f"no estimator {name!r}; there are {sorted(ESTIMATORS)}") from None


def fit_bands(model: Ols, x: np.ndarray, y: np.ndarray) -> list[Ols]:
    """A model of each band (row of y); least squares and robust fits are of all of them at once."""
    if type(model) not in (Ols, Rlm):
        return [model.fresh().fit(x, band) for band in y]
    coef = least_squares(x, y.T).T if type(model) is Ols else model.fresh().fit_rows(x, y)
    out = [model.fresh() for _ in y]
    for m, c in zip(out, coef, strict=True):
        m.coef_ = c.copy()
    return out


def fold_intercept(model, coef: np.ndarray | None = None) -> np.ndarray:
    """Coefficients with the separate intercept added to the first one."""
    out = np.array(model.coef_ if coef is None else coef, float)
    out[0] += model.intercept_
    return out


def recursive_residuals(x: np.ndarray, y: np.ndarray, span: int | None = None) -> np.ndarray:
    """Standardised one-step forecast errors of regressions on all earlier rows, from row ``span`` (default p) on."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, p = x.shape
    span = p if span is None else span
    gram_inv = np.linalg.inv(x[:span].T @ x[:span])
    beta = least_squares(x[:span], y[:span])
    out = np.empty(n - span)
    for k in range(span, n):
        row = x[k]
        gx = gram_inv @ row
        f = 1 + row @ gx
        err = y[k] - row @ beta
        out[k - span] = err / math.sqrt(f)
        gram_inv -= np.outer(gx, gx) / f
        beta = beta + gx * (err / f)
    return out


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return 1.0 if f <= 0 else 1 - beta_fraction(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))


def kolmogorov_tail(s: float) -> float:
    """P(sup |Brownian bridge| > s)."""
    if s < 1e-3:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * s * s) for k in range(1, 101)))))


def cusum_ols(resid: np.ndarray, ddof: int = 0) -> tuple[float, float]:
    """(statistic, p-value) of the CUSUM test on OLS residuals."""
    resid = np.asarray(resid, float)
    n = len(resid)
    scale = math.sqrt(float((resid**2).sum()) * n / max(1, n - ddof))
    s = float(np.abs(np.cumsum(resid)).max() / scale) if scale > 0 else 0.0
    return s, kolmogorov_tail(s)


#: ``lowess`` weighs about as many neighbours at a time.
LOWESS_CELLS = 1 << 18


def _lowess_places(xs: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """(places that are fitted, whether a place has the fit of one of the same x before it)."""
    n, at, tied = len(xs), [], np.zeros(len(xs), bool)
    v = xs.tolist()
    i = 0
    while i < n:
        at.append(i)
        last, j = i, i + 1
        while j < n and v[j] <= v[last] + delta:
            if v[j] == v[last]:
                tied[j] = True
                last = j
            j += 1
        i = max(last + 1, j - 1) if last < n - 1 else n
    return np.array(at, int), tied


def _lowess_windows(xs: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For each place, where its k nearest begin."""
    v, n, out = xs.tolist(), len(xs), []
    for i, first in zip(at.tolist(), np.searchsorted(xs, xs[at]).tolist(), strict=True):
        lo = min(max(first - k, 0), n - k)
        while lo + k < n and v[i] - v[lo] > v[lo + k] - v[i]:
            lo += 1
        out.append(lo)
    return np.array(out, int)


def lowess(y: np.ndarray, x: np.ndarray, frac: float = 2 / 3, it: int = 3, delta: float = 0.0) -> np.ndarray:
    """Locally weighted linear regression with robustness iterations; points within ``delta`` are interpolated."""
    order = np.argsort(x, kind="stable")
    xs, ys = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(xs)
    k = int(min(n, max(2, math.floor(frac * n + 1e-10))))
    if not n:
        return np.empty(0)
    # what is fitted, from which neighbours and with what weights depends on x only
    at, tied = _lowess_places(xs, delta)
    lo = _lowess_windows(xs, at, k)
    step = max(1, LOWESS_CELLS // k)
    blocks = [slice(b, b + step) for b in range(0, len(at), step)]

    def near(block: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        win, centre = lo[block, None] + np.arange(k), xs[at[block], None]
        dist = np.abs(xs[win] - centre)
        radius = dist.max(axis=1, keepdims=True)
        flat = radius <= 0
        w = np.where(dist < 0.999 * radius, (1 - (dist / np.where(flat, 1.0, radius)) ** 3) ** 3, 0.0)
        w[(dist <= 0.001 * radius) | flat] = 1.0
        return win, centre, flat, w

    def fitted(win: np.ndarray, centre: np.ndarray, flat: np.ndarray, w: np.ndarray) -> np.ndarray:
        w = w * robust[win]
        total = w.sum(axis=1, keepdims=True)
        w /= np.where(total > 0, total, 1.0)
        xw = xs[win]
        mx = (w * xw).sum(axis=1, keepdims=True)
        apart = xw - mx
        sxx = (w * apart**2).sum(axis=1, keepdims=True)
        sloped = (np.sqrt(np.maximum(sxx, 0)) > 0.001 * (xs[-1] - xs[0])) & ~flat
        w = np.where(sloped, w * (1 + (centre - mx) * apart / np.where(sloped, sxx, 1.0)), w)
        return np.where(total[:, 0] > 0, (w * ys[win]).sum(axis=1), np.nan)

    held = near(blocks[0]) if len(blocks) == 1 else None
    # an observation between two that are fitted is interpolated, a tied one has the fit of its first
    left = np.searchsorted(at, np.arange(n), "right") - 1
    right = np.minimum(left + 1, len(at) - 1)
    same = tied | (at[left] == np.arange(n)) | (xs[at[right]] <= xs[at[left]])
    a = np.where(same, 0.0, (xs - xs[at[left]]) / np.where(same, 1.0, xs[at[right]] - xs[at[left]]))
    robust, fit = np.ones(n), np.zeros(n)
    for round_ in range(it + 1):
        here = fitted(*held) if held else np.concatenate([fitted(*near(b)) for b in blocks])
        fit = np.where(same, here[left], a * here[right] + (1 - a) * here[left])
        if round_ == it:
            break
        resid = np.abs(ys - fit)
        scale = median(resid)
        if not scale > 0:
            break
        robust = np.where(resid < 6 * scale, (1 - (resid / (6 * scale)) ** 2) ** 2, 0.0)
    out = np.empty(n)
    out[order] = fit
    return out


def harmonic_design(x: np.ndarray, years: int) -> np.ndarray:
    """Constant, a yearly cycle and one over ``years`` years."""
    w = 2 * np.pi / 365.25
    return np.column_stack([np.ones(len(x)), np.cos(w * x), np.sin(w * x), np.cos(w / years * x), np.sin(w / years * x)])


def multitemporal_mask(x: np.ndarray, y: np.ndarray, n_year: float, crit: float = 400.0, green: int = 1, swir1: int = 4, maxiter: int = 10) -> np.ndarray:
    """Kept observations: none much brighter in green (cloud) or darker in swir1 (shadow) than a robust seasonal fit."""
    return multitemporal_masks([(x, np.asarray(y)[[green, swir1]], n_year)], crit, maxiter)[0]


def multitemporal_masks(windows: list[tuple[np.ndarray, np.ndarray, float]], crit: float = 400.0, maxiter: int = 10) -> list[np.ndarray]:
    """``multitemporal_mask`` of many (dates, green and swir1, years), fitted together."""
    sizes = [len(x) for x, _, _ in windows]
    design, both, used = np.zeros((len(sizes), max(sizes), 5)), np.zeros((len(sizes), 2, max(sizes))), np.arange(max(sizes)) < np.array(sizes)[:, None]
    for k, (x, y, n_year) in enumerate(windows):
        design[k, : sizes[k]] = harmonic_design(np.asarray(x, float), max(1, math.ceil(n_year)))
        both[k, :, : sizes[k]] = y
    off = both - Rlm(maxiter=maxiter).fit_windows(design, both, used) @ design.transpose(0, 2, 1)
    clear = (off[:, 0] < crit) & (off[:, 1] > -crit)
    return [c[:n] for c, n in zip(clear, sizes, strict=True)]


def smooth_mask(x: np.ndarray, y: np.ndarray, span: int, crit: float = 400.0, green: int = 1, swir1: int = 4, maxiter: int = 5) -> np.ndarray:
    """The same test against LOWESS curves over about ``span`` observations (wider while there are gaps)."""
    x = np.asarray(x, float)
    delta = 0.01 * (x.max() - x.min()) if len(x) else 0.0

    def curve(v: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        for k in range(maxiter):
            out = lowess(v, x, min(1.0, (span + k) / len(x)), 3, delta)
            if not np.isnan(out).any():
                break
        return out

    return (y[green] - curve(y[green]) < crit) & (y[swir1] - curve(y[swir1]) > -crit)


def _bsplines(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the ``degree`` + 1 B-splines that are not 0 at each point; the ends of the knots repeat."""
    spans = np.flatnonzero(np.diff(knots) > 0)
    inside = np.clip(np.searchsorted(knots, x, "right") - 1, spans[0], spans[-1])
    below, above = [x - knots[inside - j] for j in range(degree)], [knots[inside + 1 + j] - x for j in range(degree)]
    values = [np.ones(len(x))]
    for d in range(1, degree + 1):
        carried, new = 0.0, []
        for r, value in enumerate(values):
            part = value / (above[r] + below[d - 1 - r])
            new.append(carried + above[r] * part)
            carried = below[d - 1 - r] * part
        values = [*new, carried]
    return inside[:, None] + np.arange(-degree, 1), np.column_stack(values)


def _bspline_basis(x: np.ndarray, knots: np.ndarray, degree: int = 3, derivative: int = 0) -> np.ndarray:
    """Values (or derivatives) of all B-splines of a knot vector whose ends repeat."""
    if derivative:
        low = _bspline_basis(x, knots, degree - 1, derivative - 1)
        width = knots[degree:] - knots[:-degree]
        part = low * np.divide(degree, width, out=np.zeros(len(width)), where=width > 0)
        return part[:, :-1] - part[:, 1:]
    places, values = _bsplines(x, knots, degree)
    basis = np.zeros((len(x), len(knots) - 1 - degree))
    basis[np.arange(len(x))[:, None], places] = values
    return basis


def smoothing_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, spar: float = 0.55) -> np.ndarray:
    """A penalised cubic B-spline, evaluated at ``at``.

    Ties in x are averaged and weighted, x is scaled to [0, 1], and the penalty is
    r * 256 ** (3 * spar - 1), r being the ratio of the traces of the weighted
    basis and the roughness matrices.  Beyond the data the curve is linear.
    """
    ux, inverse = np.unique(np.asarray(x, float), return_inverse=True)
    w = np.bincount(inverse).astype(float)
    uy = np.bincount(inverse, np.asarray(y, float)) / w
    n, low, high = len(ux), ux[0], ux[-1]
    if n < 4:
        return np.interp(at, ux, uy)
    z = (ux - low) / (high - low)
    count = n if n < 50 else min(n, int(2 ** (math.log2(50) + (math.log2(100) - math.log2(50)) * (n - 50) / 150)) if n < 200 else 100 + int((n - 200) ** 0.5))
    inner = z[np.linspace(0, n - 1, count).round().astype(int)]
    knots = np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3])
    basis = _bspline_basis(z, knots)
    # the second derivatives are linear between knots: two-point Gauss integrates their products exactly
    left, width = inner[:-1], np.diff(inner)
    g = 0.5 / math.sqrt(3)
    points = np.concatenate([left + width * (0.5 - g), left + width * (0.5 + g)])
    second = _bspline_basis(points, knots, 3, 2)
    omega = (second * np.concatenate([width, width])[:, None] / 2).T @ second
    bwb = (basis * w[:, None]).T @ basis
    lam = np.trace(bwb[2:-3, 2:-3]) / np.trace(omega[2:-3, 2:-3]) if n > 6 else np.trace(bwb) / np.trace(omega)
    lam *= 256 ** (3 * spar - 1)
    coef = np.linalg.solve(bwb + lam * omega + 1e-12 * np.eye(len(bwb)), (basis * w[:, None]).T @ uy)
    zt = (np.asarray(at, float) - low) / (high - low)
    places, values = _bsplines(np.clip(zt, 0, 1), knots)
    out = (values * coef[places]).sum(axis=1)
    for side, edge in ((zt < 0, 0.0), (zt > 1, 1.0)):
        if side.any():
            slope = (_bspline_basis(np.array([edge]), knots, 3, 1) @ coef)[0]
            out[side] += slope * (zt[side] - edge)
    return out


def halfmax(x: np.ndarray) -> int:
    """0-based place of the value nearest to half way between the smallest and the largest."""
    x = np.asarray(x, float)
    low, high = np.nanmin(x), np.nanmax(x)
    return int(np.nanargmin(np.abs((x - low) / (high - low) - 0.5))) if high > low else 0
