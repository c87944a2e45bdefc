"""Every registered query against DuckDB, and the streaming monitor."""

import math
import sys
from collections import defaultdict
from datetime import date
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from chronopix.plans.adapters import CENTRE  # noqa: E402
from chronopix.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def canonical(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6g}".replace("-0", "0") if isinstance(v, float) and v == 0 else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rel = con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    expected = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert canonical(df.collect(), columns) == canonical(expected, columns)


# -- queries beyond SQL: values held against other computations on the collected series
@pytest.fixture(scope="module")
def series(spark, sf):
    """{pixel: (dates, bands x observations)}, all of them daily means, and the same with the steps of the segment queries."""
    from chronopix.plans import queries as Q

    def collect(df, bands):
        rows = defaultdict(list)
        for r in df.collect():
            rows[r["py"], r["px"]].append((r["ordinal"], *(r[b] for b in bands)))
        return {k: (np.array([o[0] for o in sorted(v)]), np.array([o[1:] for o in sorted(v)]).T) for k, v in rows.items()}

    return collect(Q._daily(spark, sf), ("b0", "b1", "b2", "b3")), collect(Q._stepped(spark, sf), ("b0", "b1"))


def design(dates, years=1.0):
    w = 2 * np.pi / 365.25
    x = dates - CENTRE
    return np.column_stack([np.ones(len(x)), x, np.cos(w * x), np.sin(w * x)]).astype(float)


def lines(rows, *columns):
    out = defaultdict(list)
    for r in rows:
        out[r["py"], r["px"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=lambda t: t[0]) for k, v in out.items()}


def robust(x, y, maxiter=50):
    """Bisquare reweighting from least squares on, by its textbook steps."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(maxiter):
        r = y - x @ beta
        a = np.sort(np.abs(r))[x.shape[1] - 1 :]
        s = np.median(a) / 0.6745
        u = r / s / 4.685
        w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
        new = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if np.abs(new - beta).max() < 1e-10:
            break
        beta = new
    return beta


def test_robust_fits_solve_their_equations(spark, sf, series):
    for r in QUERIES["rlm_fit"](spark, sf).collect():
        dates, y = series[0][r["py"], r["px"]]
        x, coef = design(dates), np.array(r["coef"])
        # fitted values agree with reweighting to the end, within the iterations' tolerance
        assert np.abs(x @ coef - x @ robust(x, y[0])).max() < 0.02 * y[0].std()


def test_penalised_fits_meet_their_conditions(spark, sf, series):
    for r in QUERIES["lasso_fit"](spark, sf).collect():
        dates, y = series[0][r["py"], r["px"]]
        x, coef = design(dates), np.array(r["coef"])
        grad = (x - x.mean(axis=0)).T @ (y[0] - x @ coef) / len(dates)
        for g, b in list(zip(grad, coef, strict=True))[2:]:
            assert abs(g - 20 * np.sign(b)) < 1.0 if b else abs(g) <= 21.0


@pytest.mark.parametrize("name", ["multitemp_mask", "lowess_mask"])
def test_masks_are_those_of_curves(spark, sf, series, name):
    from chronopix.functions import kernels as K

    rows = lines(QUERIES[name](spark, sf).collect(), "ordinal", "keep")
    for k, (dates, y) in series[0].items():
        if name == "multitemp_mask":
            w = 2 * np.pi / 365.25
            n = max(1, math.ceil((dates[-1] - dates[0]) / 365.25))
            x = np.column_stack([np.ones(len(dates)), np.cos(w * dates), np.sin(w * dates), np.cos(w / n * dates), np.sin(w / n * dates)])
            fits = [x @ robust(x, y[b], 10) for b in (0, 1)]
            margin = np.minimum(np.abs(y[0] - fits[0] - 1500), np.abs(y[1] - fits[1] + 1500))
            keep = (y[0] - fits[0] < 1500) & (y[1] - fits[1] > -1500)
            sure = margin > 30  # near the limit the iterations' end decides
        else:
            delta = 0.01 * (dates[-1] - dates[0])
            fits = [K.lowess(y[b], dates.astype(float), min(1.0, 40 / len(dates)), 3, delta) for b in (0, 1)]
            keep, sure = (y[0] - fits[0] < 1500) & (y[1] - fits[1] > -1500), np.ones(len(dates), bool)
        assert [o for o, _ in rows[k]] == dates.tolist() and (np.array([v for _, v in rows[k]]) == keep)[sure].all() and sure.mean() > 0.9


def test_recursive_residuals_are_those_of_refits(spark, sf, series):
    rows = lines(QUERIES["recresid_harmonic"](spark, sf).collect(), "ordinal", "recresid")
    assert rows
    for k, (dates, y) in series[0].items():
        x = design(dates)
        x[:, 1] /= 1000
        expected = []
        for i in range(24, len(dates)):
            b = np.linalg.lstsq(x[:i], y[0, :i], rcond=None)[0]
            expected.append((y[0, i] - x[i] @ b) / np.sqrt(1 + x[i] @ np.linalg.inv(x[:i].T @ x[:i]) @ x[i]))
        assert [v for _, v in rows.get(k, [])] == pytest.approx(expected, rel=1e-5, abs=1e-4)


@pytest.mark.parametrize(("name", "more"), [("ccdc_lowess", {"lowess": True}), ("ccdc_seasonal_rmse", {"dynamic": True}), ("ccdc_omission", {})])
def test_segments_equal_the_naive_ones(spark, sf, series, name, more):
    from chronopix.functions import kernels as K
    from test_segmentation import naive

    rows, n = lines(QUERIES[name](spark, sf).collect(), "seg_id", "start", "end", "break", "coef", "rmse", *(["omission"] if name == "ccdc_omission" else [])), 0
    mask, smooth = K.multitemporal_mask, K.smooth_mask
    try:  # the naive one takes the bands for clouds and shadows from fixed places
        K.multitemporal_mask = lambda d, y, years, crit: mask(d, y, years, crit, 0, 1)
        K.smooth_mask = lambda d, y, span, crit: smooth(d, y, span, crit, 0, 1)
        for k, (dates, y) in series[1].items():
            expected = naive(design(dates), y, dates, threshold=3.0, min_rmse=100.0, crit=4000.0, test=(0, 1), **more) or []
            got = rows.get(k, [])
            assert [g[1:4] for g in got] == [e[:3] for e in expected]
            for g, e in zip(got, expected, strict=True):
                x = design(dates)
                assert (x @ np.array(g[4])).T == pytest.approx((x @ np.array(e[3]).T).T, rel=1e-3, abs=1) and g[5] == pytest.approx(e[4], rel=1e-4)
                if name == "ccdc_omission":
                    own = (dates >= g[1]) & (dates <= g[2])
                    hits = []
                    for b in (0, 1):
                        r = y[b, own] - x[own] @ np.linalg.lstsq(x[own], y[b, own], rcond=None)[0]
                        s = np.abs(np.cumsum(r)).max() / np.sqrt((r**2).sum() * len(r) / (len(r) - 4))
                        hits.append(sum(2 * (-1) ** (j - 1) * np.exp(-2 * j * j * s * s) for j in range(1, 60)) < 0.05)
                    assert g[6] == any(hits)
            n += len(got)
    finally:
        K.multitemporal_mask, K.smooth_mask = mask, smooth
    assert n > 0


def test_segments_of_the_published_parameters(spark, sf, series):
    """The penalised segmentation through Spark against the kernel on the collected series, which has its own naive twin."""
    from chronopix.errors import SeriesTooShort
    from chronopix.functions import kernels as K
    from chronopix.functions.ccdc import Ccdc
    from chronopix.plans.queries import PARAMETERS, PUBLISHED

    for name, parameters in (("ccdc_eight_bands", PUBLISHED), ("ccdc_segments", PARAMETERS)):
        rows = lines(QUERIES[name](spark, sf).collect(), "seg_id", "start", "end", "break", "rmse")
        for k in series[0]:
            if name == "ccdc_segments":
                dates, y = series[1][k]
                x = design(dates)
            else:
                dates, b = series[0][k]
                y = np.vstack([b, (b[0] + b[1]) / 2, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] + b[3]) / 2])
                w = 4 * np.pi / 365.25 * (dates - CENTRE)
                x = np.column_stack([design(dates), np.cos(w), np.sin(w)])
            try:
                expected = Ccdc(**parameters, estimator=K.Lasso(alpha=20.0)).fit(x, y, dates)
            except SeriesTooShort:
                expected = []
            assert [g[1:4] for g in rows.get(k, [])] == [(s.start, s.end, s.change) for s in expected]
            assert all(g[4] == pytest.approx(s.rmse, rel=1e-3) for g, s in zip(rows.get(k, []), expected, strict=True))


def test_merged_segments_are_those_that_a_chow_test_joins(spark, sf, series):
    """Neighbours stay apart if, and only if, the F statistic of separate lines is beyond its one per cent point."""
    plain = lines(QUERIES["ccdc_segments"](spark, sf).collect(), "seg_id", "start", "end", "break")
    merged = lines(QUERIES["commission_merge"](spark, sf).collect(), "seg_id", "start", "end", "break")
    assert set(plain) == set(merged)
    for k, own in plain.items():
        dates, y = series[1][k]
        x = design(dates)
        rss = lambda rows: np.mean([((y[b, rows] - x[rows] @ np.linalg.lstsq(x[rows], y[b, rows], rcond=None)[0]) ** 2).sum() for b in (0, 1)])  # noqa: E731, B023
        out = []
        for _, start, end, change in own:
            if out:
                a, b = out[-1][0], out[-1][1]
                one, two, both = (dates > a) & (dates <= b), (dates > start) & (dates <= end), (dates > a) & (dates <= end)
                n, p = both.sum(), x.shape[1]
                if one.sum() > p and two.sum() > p and n > 2 * p:
                    apart = rss(one) + rss(two)
                    f = (rss(both) - apart) / p / (apart / (n - 2 * p))
                    # the tail of F by a sum over many draws of its density
                    t = np.linspace(0, 1, 200_001)[1:-1]
                    density = t ** (p / 2 - 1) * (1 - t) ** ((n - 2 * p) / 2 - 1)
                    z = p * f / (p * f + n - 2 * p)
                    if density[t > z].sum() / density.sum() >= 0.01:
                        out[-1] = (a, end, change)
                        continue
            out.append((start, end, change))
        assert [m[1:] for m in merged[k]] == out


def test_refits_are_regressions_on_the_segments(spark, sf, series):
    for r in QUERIES["refit_segments"](spark, sf).collect():
        dates, y = series[1][r["py"], r["px"]]
        own = (dates >= r["start"]) & (dates <= r["end"])
        x = design(dates)[own]
        for b in (0, 1):
            beta = np.linalg.lstsq(x, y[b, own], rcond=None)[0]
            assert x @ np.array(r["ols_coef"])[:, b] == pytest.approx(x @ beta, rel=1e-3, abs=1)
            assert r["ols_rmse"][b] == pytest.approx(np.sqrt(((y[b, own] - x @ beta) ** 2).mean()), rel=1e-4)
            first, again = np.array(r["coef"])[:, b], np.array(r["rlm_coef"])[:, b]
            assert (again[first == 0] == 0).all()
            if first.any():
                use = np.flatnonzero(first)
                fit = x[:, use] @ robust(x[:, use], y[b, own], 10)
                assert np.abs(x @ again - fit).max() < 0.03 * y[b, own].std() + 1


def test_phenology_finds_the_halves_of_known_curves(spark):
    """Seasons that rise and fall around known days, every year, with noise; the index is scaled to about 0 and 1."""
    from chronopix.operators import phenology

    r = np.random.default_rng(4)
    rows, first = [], date(2000, 1, 1).toordinal()
    for px, (up, down) in enumerate([(120, 280), (100, 300), (140, 260)]):
        for o in range(first, first + 3650, 9):
            doy = date.fromordinal(o).timetuple().tm_yday
            evi = 0.2 + 0.5 / (1 + np.exp(-(doy - up) / 8)) - 0.5 / (1 + np.exp(-(doy - down) / 8)) + r.normal() * 0.01
            rows.append((0, px, o, float(evi)))
    obs = spark.createDataFrame(rows, "py int, px int, ordinal int, evi double")
    segs = spark.createDataFrame([(0, px, 0, first, first + 3650) for px in range(3)], "py int, px int, seg_id int, start int, end int")
    got = {x["px"]: x for x in phenology.long_term_mean(obs, segs, phenology.Phenology(evi_band="evi", evi_scale=1.0)).collect()}
    for px, (up, down) in enumerate([(120, 280), (100, 300), (140, 260)]):
        assert abs(got[px]["spring_doy"] - up) <= 8 and abs(got[px]["autumn_doy"] - down) <= 8 and up < got[px]["peak_doy"] < down
        assert got[px]["pheno_cor"] > 0.9 and got[px]["peak_evi"] == pytest.approx(1.0, abs=0.06) and got[px]["pheno_nobs"] == len(range(0, 3650, 9))


def test_phenology_query_counts_the_observations_of_its_segments(spark, sf, series):
    for r in QUERIES["phenology_ltm"](spark, sf).collect():
        if r["pheno_nobs"]:
            dates, y = series[0][r["py"], r["px"]]
            evi = y[0] * 0.0002
            own = (dates >= r["start"]) & (dates <= r["end"])
            assert r["pheno_nobs"] == (own & (evi >= 0) & (evi <= 1)).sum() and -1 <= r["pheno_cor"] <= 1


@pytest.mark.parametrize("name", ["omission_any", "omission_all", "omission_segments"])
def test_omission_is_dealt_into_more_tasks_the_larger_the_files(spark, sf, monkeypatch, name):
    from chronopix.operators import prep

    held = sorted(map(tuple, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(prep, "PARTITION_BYTES", prep.source_bytes(spark.read.parquet(f"{sf}/lineitem.parquet")) // 9)
    df = QUERIES[name](spark, sf)
    assert df.rdd.getNumPartitions() >= 9 and sorted(map(tuple, df.collect())) == held


def test_classes_are_the_likeliest_and_learnt(spark, sf):
    from chronopix.operators import classify
    from chronopix.plans import adapters as A
    from chronopix.plans.queries import DAY

    rows = QUERIES["rf_classify"](spark, sf).collect()
    assert rows and all(sum(r["class_proba"]) == pytest.approx(1, abs=1e-5) and r["class_proba"][r["class"]] == max(r["class_proba"]) for r in rows)
    table = {(r["py"], r["px"]): r["label"] for r in classify.training_table(A.labels(spark, sf), A.segments(spark, sf), DAY, DAY + 10, [0], 1, A.CENTRE).collect()}
    held = {(r["py"], r["px"], r["seg_id"]): r["class"] for r in rows}
    inside = A.segments(spark, sf).where(f"start < {DAY} and end > {DAY + 10}").select("py", "px", "seg_id").collect()
    hits = [held[tuple(s)] == table[s["py"], s["px"]] for s in inside if (s["py"], s["px"]) in table]
    assert hits and np.mean(hits) > 0.8  # a forest knows what it was shown


def test_scores_of_folds_and_importances(spark, sf):
    from chronopix.operators import classify

    got = {r["variant"]: (r["mean"], r["std"]) for r in QUERIES["forest_scores"](spark, sf).collect()}
    assert set(got) == {"kfold", "stratified", "spatial"} and all(0 <= m <= 1 and 0 <= s <= 0.5 for m, s in got.values())
    rows = QUERIES["forest_importances"](spark, sf).collect()
    assert sorted(r["feature"] for r in rows) == ["B1_Intercept", "B1_RMSE", "B1_x", "B2_Intercept", "B2_RMSE", "B2_x"]
    assert sum(r["importance"] for r in rows) == pytest.approx(1) and rows == sorted(rows, key=lambda r: -r["importance"])
    # a label that one feature tells is learnt from that one, in every variant; without it half of the guesses are right at best
    r = np.random.default_rng(3)
    told = [(k // 10, k % 10, 1 + (k * 7) % 2, [float((k * 7) % 2), float(r.normal())]) for k in range(120)]
    table = spark.createDataFrame(told, "py int, px int, label int, features array<double>")
    config = {"algorithm": "RandomForest", "RandomForest": {"init": {"n_estimators": 5, "max_features": None}}}
    assert all(r["mean"] == 1 and r["std"] == 0 for r in classify.diagnostics(table, config, 3).collect())
    first = classify.importances(classify.train(table, config), ["told", "noise"]).first()
    assert first["feature"] == "told" and first["importance"] > 0.95
    with pytest.raises(ValueError):
        classify.importances(classify.train(table, config), ["told"])
    # by hand: the folds of one row each are scored by forests of the other row, which know one label only
    two = table.where("py = 0 and px < 2").withColumn("fold", F.col("px"))
    assert classify.fold_scores(two, config, 2) == (0.0, 0.0)
    assert all(math.isnan(v) for v in classify.fold_scores(two.where("px = 0"), config, 1))


def test_every_query_beyond_sql_has_a_value_test():
    here = Path(__file__).read_text()
    assert not [n for n in set(QUERIES) - set(ORACLE_SQL) if f'"{n}"' not in here]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_of_observations_finds_a_change(spark, tmp_path):
    from chronopix.streaming.monitor import monitor

    rows = [(0, px, 730000 + 16 * k, 100.0 + (k % 3) + (500 if px == 1 and k >= 30 else 0)) for k in range(50) for px in range(2)]
    for part in range(5):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], "py int, px int, ordinal int, b0 double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("py int, px int, ordinal int, b0 double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = monitor(stream, "b0").writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("found").collect()
    assert [(r["px"], r["change"]) for r in got] == [(1, 730000 + 16 * 30)] and got[0]["magnitude"] > 3


def test_streamed_composites(spark, tmp_path):
    from chronopix.streaming.monitor import composites

    spark.sql("SELECT 0 AS py, 0 AS px, timestamp(date_add(date'2024-01-01', int(id div 2))) AS ts, double(id) AS b0 FROM range(20)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("py int, px int, ts timestamp, b0 double").parquet(f"{tmp_path}/in")
    q = composites(stream, ["b0"]).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert all(r["n"] == 2 for r in spark.table("days").collect())
