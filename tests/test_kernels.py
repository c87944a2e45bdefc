import time

import numpy as np
import pytest

from chronopix.errors import SeriesTooShort, UnknownAlgorithm
from chronopix.functions import kernels as K
from chronopix.functions.ccdc import Ccdc, Segment
from chronopix.operators.segmentation import algorithm, commission, omission, refit


def test_mad_and_rmse():
    assert K.mad(np.array([1, 1, 2, 2, 4, 6, 9.0])) == pytest.approx(1.4825796)
    y = np.random.default_rng(0).normal(size=50)
    assert K.rmse(y, y + 1) == pytest.approx(1.0)


def line():
    x = np.column_stack([np.ones(10), np.arange(10.0)])
    y = 2 * x[:, 1] + 5
    y[9] = 0
    return x, y


def test_robust_regression_passes_over_an_outlier():
    x, y = line()
    for one_sided in (False, True):
        assert K.Rlm(one_sided=one_sided).fit(x, y).coef_ == pytest.approx([5, 2])
    assert len(K.Rlm().fit(x[:2], y[:2]).coef_) == 2


def test_lasso_against_its_optimality_conditions():
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(80), 730000 + 16 * np.arange(80), r.normal(size=80) * 10, r.normal(size=80)])
    y = 0.05 * x[:, 1] + 4 * x[:, 2] + r.normal(size=80)
    m = K.Lasso(alpha=3.0, tol=1e-10, max_iter=20000).fit(x, y)
    grad = (x - x.mean(axis=0)).T @ (y - m.predict(x)) / 80
    for g, b in zip(grad, m.coef_, strict=True):
        assert abs(g - 3.0 * np.sign(b)) < 1e-3 if b else abs(g) <= 3.0 + 1e-6
    assert m.coef_[0] == 0


def test_lasso_cv_and_registry():
    x, y = line()
    assert K.LassoCV(alphas=(0.01, 1.0)).fit(x, y).alpha_ in (0.01, 1.0)
    assert type(K.estimator("RLM")) is K.Rlm and K.estimator("rlm_maxiter10").maxiter == 10 and K.estimator("Lasso20").alpha == 20
    with pytest.raises(UnknownAlgorithm):
        K.estimator("nothing")
    with pytest.raises(UnknownAlgorithm):
        algorithm("nothing")


def test_recursive_residuals_equal_refits():
    r = np.random.default_rng(2)
    x = np.column_stack([np.ones(30), r.normal(size=(30, 2))])
    y = r.normal(size=30)
    got = K.recursive_residuals(x, y)
    for k in range(3, 30):
        b, *_ = np.linalg.lstsq(x[:k], y[:k], rcond=None)
        expected = (y[k] - x[k] @ b) / np.sqrt(1 + x[k] @ np.linalg.inv(x[:k].T @ x[:k]) @ x[k])
        assert got[k - 3] == pytest.approx(expected, abs=1e-8)


def test_tails():
    assert K.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4) and K.f_tail(1.0, 5, 5) == pytest.approx(0.5)
    assert K.f_tail(0, 2, 3) == 1 and K.beta_fraction(2, 3, 0.5) == pytest.approx(0.6875)
    assert K.kolmogorov_tail(1.3581) == pytest.approx(0.05, abs=1e-4)
    drift = np.concatenate([np.ones(50), -np.ones(50)])
    assert K.cusum_ols(drift)[1] < 0.001 < K.cusum_ols(np.tile([1.0, -1.0], 50))[1]


def masking():
    x = np.arange(735851, 735851 + 730, 8)
    w = 2 * np.pi / 365.25
    y = np.zeros((5, len(x)))
    y[1], y[4] = 1000 + 750 * np.cos(w * x), 1250 + 500 * np.cos(w * x)
    y[1, 15], y[4, 30] = 8000, 10
    return x, y


def test_masks_find_exactly_the_outliers():
    x, y = masking()
    assert set(np.flatnonzero(~K.multitemporal_mask(x, y, 2))) == {15, 30}
    assert set(np.flatnonzero(~K.smooth_mask(x, y, 9))) == {15, 30}


def test_lowess_keeps_lines_and_gaps():
    x = np.concatenate([np.arange(20.0), np.arange(40.0, 60)])
    assert K.lowess(3 * x + 1, x, 0.4) == pytest.approx(3 * x + 1)
    assert K.lowess(3 * x + 1, x, 0.4, delta=2.0) == pytest.approx(3 * x + 1)


def test_spline_smooths_and_interpolates():
    x = np.arange(1.0, 101)
    y = np.sin(x / 15) + np.random.default_rng(3).normal(size=100) * 0.1
    fit = K.smoothing_spline(x, y, x)
    assert np.sqrt(np.mean((fit - np.sin(x / 15)) ** 2)) < 0.06
    assert K.smoothing_spline(x, 2 * x + 1, np.array([0.0, 50.5, 120])) == pytest.approx([1, 102, 241], rel=1e-6)
    assert np.isfinite(K.smoothing_spline(np.repeat(np.arange(400.0), 2), np.ones(800), np.arange(400.0))).all()
    assert K.halfmax(np.array([0.0, 4, 6, 10])) == 1 and K.halfmax(np.ones(3)) == 0


def simulated(change: bool):
    r = np.random.RandomState(123456789)
    dates = np.arange(730120, 730120 + 1827, 16)
    n = len(dates)
    y = np.concatenate([np.linspace(0, 10, n // 2), np.linspace(20, 10, n - n // 2)]) if change else np.linspace(0, 10, n)
    y = y + r.normal(size=n)
    return np.column_stack([np.ones(n), dates]), np.vstack([y, y]), dates


def parts(dates, cuts, p=2, bands=2):
    edges = [0, *cuts, len(dates) - 1]
    return [Segment(int(dates[a]), int(dates[b - 1 if b in cuts else b]), int(dates[b]) if b in cuts else 0, np.ones((bands, p)), np.ones(bands), np.zeros(bands)) for a, b in zip(edges, edges[1:], strict=False)]


def test_commission_merges_false_and_keeps_real_changes():
    x, y, dates = simulated(False)
    n = len(dates)
    one = parts(dates, [])
    assert commission(x, y, dates, one, None, K.Ols(), 0.01) == one
    for cuts in ([n // 2], [n // 4, n // 2]):
        got = commission(x, y, dates, parts(dates, cuts), None, K.Ols(), 0.01)
        assert len(got) == 1 and got[0].change == 0 and got[0].start == dates[0]
    x, y, dates = simulated(True)
    assert len(commission(x, y, dates, parts(dates, [n // 2]), None, K.Ols(), 0.10)) == 2


def test_refit_and_omission():
    x, y, dates = simulated(False)
    got = refit(x, y, dates, parts(dates, []), K.Ols())
    assert got[0][0][0] == pytest.approx([-3830.16528, 5.24635240e-3], rel=1e-5) and got[0][1][0] == pytest.approx(0.96794599, rel=1e-5)
    got = refit(x, y, dates, parts(dates, []), K.Rlm(maxiter=10), keep_regularized=True)
    assert got[0][0][0] == pytest.approx([-3842.592, 5.263297e-3], rel=1e-5)
    zero = parts(dates, [])
    zero[0].coef[:] = 0
    kept = refit(x, y, dates, zero, K.Rlm(), keep_regularized=True)
    assert not kept[0][0].any() and (kept[0][1] == zero[0].rmse).all()
    assert omission(x, y, dates, parts(dates, [])) == [False]
    x, y, dates = simulated(True)
    assert omission(x, y, dates, parts(dates, [])) == [True] and omission(x, y, dates, parts(dates, []), behavior="ALL") == [True]
    with pytest.raises(ValueError):
        omission(x, y, dates, [], behavior="SOME")
    with pytest.raises(ValueError):
        omission(x, y, dates, [], indices=[3], test=[0])


def series(step=None, noise=20.0, seed=1, n=200):
    r = np.random.default_rng(seed)
    dates = 730000 + 16 * np.arange(n)
    w = 2 * np.pi / 365.25
    x = np.column_stack([np.ones(n), dates - 730000, np.cos(w * dates), np.sin(w * dates)])
    y = np.vstack([1000 + 300 * np.cos(w * dates + k) + r.normal(size=n) * noise for k in range(5)])
    if step:
        y[:, step:] += 1500
    return x, y, dates


OPTIONS = [{}, {"remove_noise": False}, {"dynamic_rmse": True}, {"slope_test": True, "threshold": 4.0}, {"screening": "LOWESS"}, {"circular_days": True, "dynamic_rmse": True}]


@pytest.mark.parametrize("more", OPTIONS)
def test_one_change_is_found(more):
    x, y, dates = series(step=120)
    p = Ccdc(**({"test_indices": [2, 3, 4], "threshold": 4.0, "min_rmse": 20.0, "screening_crit": 4000.0, "estimator": K.Lasso(alpha=1.0)} | more))
    got = p.fit(x, y, dates)
    assert len(got) == 2 and got[0].change == dates[121] and got[1].change == 0
    assert all(s.start <= s.end and (s.rmse >= 0).all() for s in got) and got[0].end < got[0].change <= got[1].start
    assert got[0].magnitude[0] == 0 and got[0].magnitude[2] > 4


def test_no_change_noise_and_short_series():
    x, y, dates = series()
    p = Ccdc(threshold=6.0, min_rmse=30.0, screening_crit=4000.0, estimator=K.Ols())
    assert len(p.fit(x, y, dates)) == 1 and p.fit(x, y, dates)[0].change == 0
    y[:, 150] += 5000
    assert len(p.fit(x, y, dates)) == 1  # a single far observation is noise
    with pytest.raises(SeriesTooShort):
        p.fit(x[:10], y[:, :10], dates[:10])
    with pytest.raises(ValueError):
        p.fit(x[:100], y, dates)
    with pytest.raises(TypeError):
        Ccdc(screening="other")
    assert Ccdc(test_indices=[0]).test_indices == [0]


def naive_lowess(y, x, k, rounds):
    robust, fit = np.ones(len(x)), np.zeros(len(x))
    for _ in range(rounds + 1):
        for i in range(len(x)):
            near = np.argsort(np.abs(x - x[i]), kind="stable")[:k]
            apart = np.abs(x[near] - x[i])
            w = np.where(apart < 0.999 * apart.max(), (1 - (apart / apart.max()) ** 3) ** 3, 0.0) * robust[near]
            fit[i] = np.polyval(np.polyfit(x[near] - x[i], y[near], 1, w=np.sqrt(w)), 0.0)
        off = np.abs(y - fit)
        robust = np.maximum(0, 1 - (off / (6 * np.median(off))) ** 2) ** 2
    return fit


def test_lowess_against_point_by_point_fits(monkeypatch):
    r = np.random.default_rng(5)
    for cells in (K.LOWESS_CELLS, 100):  # all points at once, and a few at a time
        monkeypatch.setattr(K, "LOWESS_CELLS", cells)
        for n in (30, 61):
            x = np.sort(r.random(n)) * 1000
            y = np.sin(x / 150) * 100 + r.normal(size=n) * 10 + (r.random(n) < 0.1) * 500
            assert K.lowess(y, x, 0.5, 3) == pytest.approx(naive_lowess(y, x, n // 2, 3), abs=1e-6)
    assert K.lowess(np.zeros(0), np.zeros(0)).shape == (0,)


def test_smooth_masks_are_made_for_all_points_at_once():
    # point by point, with a dozen calls of NumPy each, these took over five seconds
    r = np.random.default_rng(6)
    start = time.process_time()
    for _ in range(50):
        x = 729000 + np.sort(r.choice(2500, 530, replace=False))
        y = r.normal(size=(2, 530)) * 100
        y[0, 100], y[1, 200] = 5000, -5000
        assert np.flatnonzero(~K.smooth_mask(x, y, 40, crit=1500.0, green=0, swir1=1)).tolist() == [100, 200]
    assert time.process_time() - start < 2.5
