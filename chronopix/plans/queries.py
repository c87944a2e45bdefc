"""Registered queries: each operator applied to the adapter views, with its twin in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopix.config import parse
from chronopix.functions import columns as C
from chronopix.functions.formula import Design
from chronopix.operators import aggregates, changes, classify, incremental, maps, segmentation, windows
from chronopix.operators import phenology as pheno
from chronopix.operators.prep import by_pixel, clear_observations, daily_composite, dates_up_to, pixel_series, with_catalog, with_design
from chronopix.plans import adapters as A
from chronopix.plans import jobs
from chronopix.scratch import Scratch
from chronopix.sources import catalog as catalogs
from chronopix.sources import raster, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 729500
RANGE = (729000, 730500)


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _daily(spark, d, bands=("b0", "b1", "b2", "b3")) -> DataFrame:
    return daily_composite(A.obs(spark, d), list(bands))


_ARCHIVES: dict[tuple[str, str], str] = {}


def _dealt(spark, d, bands) -> DataFrame:
    """``_daily`` with each pixel's in one partition, of which there are more the larger the input is."""
    return daily_composite(by_pixel(A.obs(spark, d).select("py", "px", "ordinal", *bands)), list(bands))


def _archive(spark, d) -> str:
    """The observations as an archive in time-series order, written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ARCHIVES:
        path = f"{Scratch(spark, 'archive').root}/archive"
        raster.layout(A.obs(spark, d), path, rows_per_bucket=4)
        _ARCHIVES[key] = path
    return _ARCHIVES[key]


def _catalog(spark, d) -> DataFrame:
    o = A.obs(spark, d).groupBy("ordinal").agg(F.max("sensor").alias("sensor"))
    return o.select(F.col("ordinal").cast("string").alias("image_id"), "ordinal", "sensor", F.concat(F.lit("/data/"), F.col("sensor"), F.col("ordinal").cast("string"), F.lit("/stack.dat")).alias("filename"))


CATALOG = f"{A.OBS}, catalog AS (SELECT ordinal, max(sensor) AS sensor FROM obs GROUP BY ordinal)"
ORD = "DATE '1970-01-01' + (ordinal - 719163)"


# -- sources -------------------------------------------------------------------
@query(f"WITH {CATALOG} SELECT sensor || ordinal AS image_id, substr(sensor || ordinal, 1, 3) AS sensor, CAST(strftime({ORD}, '%Y%j') AS INTEGER) AS ydoy, ordinal, ordinal AS x FROM catalog")
def catalog_dates(spark, d):
    path = f"{Scratch(spark, 'catalog').root}/catalog"
    catalogs.write_catalog(_catalog(spark, d).withColumn("image_id", C.parent_folder(F.col("filename"))), path)
    found = catalogs.read_catalog(spark, path)  # the dates' column comes back as a date, so the year and day are made again
    return found.select("image_id", "sensor", C.format_ordinal(F.col("ordinal")).alias("ydoy"), "ordinal", "x")


@query(f"WITH {CATALOG} SELECT '/data/' || sensor || ordinal || '/stack.dat' AS filename, sensor || ordinal AS image_id FROM catalog")
def image_ids(spark, d):
    return _catalog(spark, d).select("filename", C.parent_folder(F.col("filename")).alias("image_id"))


@query(f"WITH {CATALOG} SELECT strftime({ORD}, '%Y-%m-%d') AS text, ordinal AS parsed, CAST(strftime({ORD}, '%Y%m%d') AS INTEGER) AS ymd FROM catalog")
def date_parse(spark, d):
    t = _catalog(spark, d).withColumn("text", C.from_ordinal(F.col("ordinal")).cast("string"))
    return t.select("text", C.parse_ordinal(F.col("text"), "%Y-%m-%d").alias("parsed"), C.format_ordinal(F.col("ordinal"), "%Y%m%d").alias("ymd"))


@query(f"WITH {A.OBS} SELECT ordinal, b0, round(b1, 4) AS b1, mask FROM obs WHERE py = 0 AND px = 3")
def pixel_lookup(spark, d):
    return raster.read_pixel(spark, _archive(spark, d), 3, 0, 4).select("ordinal", "b0", _r("b1").alias("b1"), "mask")


@query(f"WITH {A.OBS} SELECT px, ordinal, count(*) AS n, round(sum(b0), 2) AS b0 FROM obs WHERE py = 0 GROUP BY px, ordinal")
def row_scan(spark, d):
    return raster.read_line(spark, _archive(spark, d), 0, 4).groupBy("px", "ordinal").agg(F.count("*").alias("n"), F.round(F.sum("b0"), 2).alias("b0"))


@query(f"WITH {A.OBS} SELECT py, px, CAST(max(CAST(trunc(b2) AS INTEGER)) AS INTEGER) AS b2 FROM obs GROUP BY py, px")
def band_select(spark, d):
    return A.obs(spark, d).select("py", "px", F.col("b2").cast("int").alias("b2")).groupBy("py", "px").agg(F.max("b2").alias("b2"))


@query(f"WITH {A.OBS} SELECT max(py) + 1 AS n_row, max(px) + 1 AS n_col, unnest(['b0', 'b1', 'b2', 'b3']) AS band, 'double' AS kind FROM obs")
def image_attributes(spark, d):
    rows, cols, bands = raster.attributes(spark.read.parquet(_archive(spark, d)))
    return spark.createDataFrame([(rows, cols, *b) for b in bands], "n_row int, n_col int, band string, kind string")


@query(f"""WITH {A.OBS}, m AS (SELECT py, px, count(*) AS n, max(b2) AS top FROM obs GROUP BY py, px), e AS (SELECT max(py) + 1 AS n_row, max(px) + 1 AS n_col FROM obs)
SELECT CAST(y AS INTEGER) AS py, CAST(x AS INTEGER) AS px, coalesce(n, -9999)::FLOAT AS n, coalesce(top, -9999)::FLOAT AS top FROM (SELECT unnest(range(n_row)) AS y, n_col FROM e), LATERAL (SELECT unnest(range(n_col)) AS x) LEFT JOIN m ON py = y AND px = x""")
def raster_roundtrip(spark, d):
    rows, cols, _ = raster.attributes(spark.read.parquet(_archive(spark, d)))
    values = A.obs(spark, d).groupBy("py", "px").agg(F.count("*").alias("n"), F.max("b2").alias("top"))
    path = f"{Scratch(spark, 'raster').root}.envi"
    raster.write_raster(values, path, ["n", "top"], rows, cols, -9999)
    names = raster.read_header(path)["names"]
    return raster.read_envi(spark, [path]).select("py", "px", *(F.col(f"b{k}").alias(n) for k, n in enumerate(names, 1)))


@query(f"WITH {A.SEGMENTS} SELECT py, px, seg_id, start, \"end\", brk AS change, round(i0, 2) AS i0, round(s1, 4) AS s1, round(r1, 3) AS r1, '1 + x' AS design FROM seg")
def result_roundtrip(spark, d):
    path = f"{Scratch(spark, 'result').root}/result"
    results.write_segments(A.segments(spark, d), path, {"design": {"Intercept": 0, "x": 1}, "design_matrix": "1 + x", "n_bands": 2}, rows_per_bucket=4)
    design = results.read_metadata(spark, path, ("design", "design_matrix"))["design_matrix"]
    found = results.read_segments(spark, path)
    return found.select("py", "px", "seg_id", "start", "end", F.col("break").alias("change"), _r(F.col("coef")[0][0], 2).alias("i0"), _r(F.col("coef")[1][1]).alias("s1"), _r(F.col("rmse")[1], 3).alias("r1"), F.lit(design).alias("design"))


@query(f"WITH {A.OBS} SELECT ordinal, CAST(year({ORD}) AS INTEGER) AS year, CAST(dayofyear({ORD}) AS INTEGER) AS doy, CASE WHEN month({ORD}) IN (4, 5) THEN 'spring' WHEN month({ORD}) IN (6, 7, 8) THEN 'summer' WHEN month({ORD}) IN (9, 10) THEN 'fall' ELSE 'winter' END AS season, b0 AS b1, round(b1, 4) AS b2 FROM obs WHERE py = 0 AND px = 3 AND mask NOT IN (4) AND b0 BETWEEN 500 AND 9000 AND b1 BETWEEN 0 AND 9000")
def pixel_seasons(spark, d):
    config = parse({"dataset": {"n_bands": 3, "mask_band": 3, "mask_values": [4], "min_values": [500, 0, 0], "max_values": [9000, 9000, 5]}, "model": {"algorithm": "CCDC", "prediction": "ols", "design_matrix": "1 + x"}, "CCDC": {}})
    obs = spark.read.parquet(_archive(spark, d)).select("py", "px", "ordinal", F.col("b0").alias("b1"), F.col("b1").alias("b2"), F.col("mask").alias("b3"))
    return jobs.seasonal(obs, config, 0, 3).select("ordinal", "year", "doy", "season", "b1", _r("b2").alias("b2"))


# -- filters, projections ------------------------------------------------------
@query(f"WITH {A.OBS} SELECT py, px, count(*) AS n, round(sum(b0), 2) AS b0 FROM obs WHERE b0 BETWEEN 500 AND 4500 AND b1 BETWEEN 0 AND 6000 AND b2 BETWEEN 0 AND 10000 AND b3 BETWEEN 0 AND 10000 GROUP BY py, px")
def valid_range_filter(spark, d):
    kept = clear_observations(A.obs(spark, d), ["b0", "b1", "b2", "b3"], [500, 0, 0, 0], [4500, 6000, 10000, 10000])
    return kept.groupBy("py", "px").agg(F.count("*").alias("n"), F.round(F.sum("b0"), 2).alias("b0"))


@query(f"WITH {A.OBS} SELECT py, px, count(*) AS n FROM obs WHERE mask NOT IN (4) GROUP BY py, px")
def mask_band_filter(spark, d):
    return clear_observations(A.obs(spark, d), ["b0"], mask="mask", mask_values=[4]).groupBy("py", "px").agg(F.count("*").alias("n"))


@query(f"WITH {A.OBS} SELECT py, px, ordinal, round(avg(b0), 4) AS b0, round(avg(b1), 4) AS b1 FROM obs WHERE b0 BETWEEN 0 AND 4500 AND b1 BETWEEN 0 AND 9000 AND mask NOT IN (4) GROUP BY py, px, ordinal")
def preprocess_pixel(spark, d):
    kept = clear_observations(A.obs(spark, d), ["b0", "b1"], 0, [4500, 9000], "mask", [4])
    return daily_composite(kept, ["b0", "b1"]).select("py", "px", "ordinal", _r("b0").alias("b0"), _r("b1").alias("b1"))


@query(f"WITH {A.OBS}, {A.DAILY} SELECT py, px, ordinal, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(b3, 4) AS b3 FROM daily")
def daily_composites(spark, d):
    return _daily(spark, d).select("py", "px", "ordinal", *(_r(b).alias(b) for b in ("b0", "b1", "b2", "b3")))


W = "(2 * pi() / 365.25)"


@query(f"WITH {CATALOG} SELECT ordinal, 1.0::DOUBLE AS intercept, (ordinal)::DOUBLE AS x, round(cos({W} * ordinal), 5) + 0 AS cos1, round(sin({W} * ordinal), 5) + 0 AS sin1, round(cos(2 * {W} * ordinal), 5) + 0 AS cos2, round(sin(2 * {W} * ordinal), 5) + 0 AS sin2 FROM catalog")
def harmonic_design(spark, d):
    c = _catalog(spark, d).withColumn("x", F.col("ordinal"))
    design = Design("1 + x + harm(x, 1) + harm(x, 2)")
    names = ("intercept", "x", "cos1", "sin1", "cos2", "sin2")
    return with_design(c, design.formula, levels={}).select("ordinal", *(F.round(F.element_at("design", i + 1), 5).alias(n) for i, n in enumerate(names)))


@query(f"WITH {CATALOG} SELECT ordinal, (ordinal)::DOUBLE AS x, CASE WHEN sensor = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS sensor_o FROM catalog")
def categorical_design(spark, d):
    c = with_design(_catalog(spark, d).withColumn("x", F.col("ordinal")), "1 + x + C(sensor)", levels={"sensor": ["F", "O"]})
    return c.select("ordinal", F.element_at("design", 2).alias("x"), F.element_at("design", 3).alias("sensor_o"))


@query(f"WITH {A.OBS}, {A.DAILY} SELECT py, px, row_number() OVER (PARTITION BY py, px ORDER BY ordinal DESC) - 1 AS place, ordinal FROM daily")
def reverse_series(spark, d):
    rows = pixel_series(_daily(spark, d, ("b0",)), ["b0"], reverse=True)
    return rows.select("py", "px", F.posexplode("series").alias("place", "s")).select("py", "px", F.col("place").cast("long").alias("place"), F.col("s.ordinal").alias("ordinal"))


@query(f"WITH {CATALOG} SELECT c.sensor AS image_sensor, count(*) AS n, round(sum(o.b0), 2) AS b0 FROM obs o JOIN catalog c USING (ordinal) GROUP BY 1")
def observation_catalog_join(spark, d):
    c = _catalog(spark, d).select("ordinal", F.col("sensor").alias("image_sensor"))
    return with_catalog(A.obs(spark, d).drop("sensor"), c, "ordinal").groupBy("image_sensor").agg(F.count("*").alias("n"), F.round(F.sum("b0"), 2).alias("b0"))


# -- functions -----------------------------------------------------------------
@query(f"WITH {A.OBS}, {A.DAILY} SELECT py, px, ordinal, round(2.5 * (n - r) / nullif(n + 6 * r - 7.5 * b + 1, 0), 5) AS evi FROM (SELECT py, px, ordinal, b2 / 10000 AS r, b0 / 10000 AS n, b3 / 10000 AS b FROM daily)")
def evi(spark, d):
    s = lambda b: F.col(b) / 10000
    return _daily(spark, d).select("py", "px", "ordinal", F.round(C.evi(s("b2"), s("b0"), s("b3")), 5).alias("evi"))


@query(f"WITH {CATALOG} SELECT ordinal, CAST(year({ORD}) AS INTEGER) AS year, CAST(dayofyear({ORD}) AS INTEGER) AS doy FROM catalog")
def ordinal_yeardoy(spark, d):
    year, doy = C.year_and_doy(F.col("ordinal"))
    return _catalog(spark, d).select("ordinal", year.alias("year"), doy.alias("doy"))


@query(f"WITH {CATALOG} SELECT ordinal, CASE WHEN month({ORD}) IN (4, 5) THEN 'spring' WHEN month({ORD}) IN (6, 7, 8) THEN 'summer' WHEN month({ORD}) IN (9, 10) THEN 'fall' ELSE 'winter' END AS season FROM catalog")
def season(spark, d):
    return _catalog(spark, d).select("ordinal", C.season(F.col("ordinal")).alias("season"))


@query(f"WITH {A.OBS} SELECT py, px, round(sum(CASE WHEN abs(z) < 4.685 THEN (1 - (z / 4.685) ** 2) ** 2 ELSE 0 END), 4) AS weight FROM (SELECT py, px, (b0 - 2500) / 400 AS z FROM obs) GROUP BY py, px")
def bisquare_weights(spark, d):
    return A.obs(spark, d).groupBy("py", "px").agg(F.round(F.sum(C.bisquare((F.col("b0") - 2500) / 400)), 4).alias("weight"))


@query("SELECT doc_id, regexp_full_match(trim(w), '[+-]?[0-9]+') AND try_cast(trim(w) AS BIGINT) IS NOT NULL AS is_integer FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ')[1] AS w FROM documents)")
def is_integer(spark, d):
    t = A.table(spark, d, "documents")
    return t.select("doc_id", C.is_integer(F.element_at(F.split(F.coalesce("text", F.lit("")), " "), 1)).alias("is_integer"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax FROM embeddings")
def array_norms(spark, d):
    return A.table(spark, d, "embeddings").select("vec_id", F.round(C.norm(F.col("embedding")), 4).alias("norm"), C.argmax(F.col("embedding")).cast("long").alias("argmax"))


@query(f"WITH {A.OBS} SELECT DISTINCT py, px, py::BIGINT * 10 + px AS pixel_id FROM obs")
def pixel_ids(spark, d):
    o = A.obs(spark, d).select("py", "px").distinct().withColumn("pixel_id", C.pixel_id(F.col("py"), F.col("px"), A.NCOL))
    py, px = C.pixel_of(F.col("pixel_id"), A.NCOL)
    return o.select(py.alias("py"), px.alias("px"), "pixel_id")


# -- aggregates, fits ----------------------------------------------------------
@query(f"WITH {A.OBS} SELECT py, px, round(sqrt(avg((b0 - 2500) ** 2)), 4) AS rmse FROM obs GROUP BY py, px")
def rmse_by_pixel(spark, d):
    return A.obs(spark, d).groupBy("py", "px").agg(F.round(aggregates.rmse(F.col("b0"), F.lit(2500.0)), 4).alias("rmse"))


@query(f"WITH {A.OBS}, m AS (SELECT py, px, median(b1) AS m FROM obs GROUP BY py, px) SELECT py, px, round(median(abs(b1 - m)) / 0.6745, 4) AS mad FROM obs JOIN m USING (py, px) GROUP BY py, px")
def mad_by_pixel(spark, d):
    return aggregates.mad(A.obs(spark, d), "b1").select("py", "px", _r("mad").alias("mad"))


@query(f"WITH {A.OBS} SELECT py, px, round(corr(b0, b1), 5) AS corr, round(quantile_cont(b0, 0.1), 4) AS q10, round(quantile_cont(b0, 0.9), 4) AS q90, round(stddev_pop(b0), 4) AS std FROM obs GROUP BY py, px")
def corr_by_pixel(spark, d):
    return A.obs(spark, d).groupBy("py", "px").agg(F.round(F.corr("b0", "b1"), 5).alias("corr"), F.round(F.percentile("b0", F.lit(0.1)), 4).alias("q10"), F.round(F.percentile("b0", F.lit(0.9)), 4).alias("q90"), F.round(F.stddev_pop("b0"), 4).alias("std"))


@query(f"WITH {A.OBS}, {A.DAILY} SELECT py, px, count(*) AS n, round(regr_slope(b0, ordinal - {A.CENTRE}), 5) AS slope, round(regr_intercept(b0, ordinal - {A.CENTRE}), 3) AS intercept FROM daily GROUP BY py, px")
def ols_linear_fit(spark, d):
    x = F.col("ordinal") - A.CENTRE
    return _daily(spark, d, ("b0",)).groupBy("py", "px").agg(F.count("*").alias("n"), F.round(F.regr_slope("b0", x), 5).alias("slope"), F.round(F.regr_intercept("b0", x), 3).alias("intercept"))


@query(f"WITH {A.OBS}, {A.DAILY} SELECT py, px, count(*) AS n, round(regr_intercept(b0, (ordinal - {A.CENTRE}) / 1000), 3) AS b_0, round(regr_slope(b0, (ordinal - {A.CENTRE}) / 1000), 3) AS b_1, round((regr_syy(b0, (ordinal - {A.CENTRE}) / 1000) - regr_slope(b0, (ordinal - {A.CENTRE}) / 1000) * regr_sxy(b0, (ordinal - {A.CENTRE}) / 1000)) / count(*), 0) AS mse FROM daily GROUP BY py, px")
def ols_gram_fit(spark, d):
    x = (F.col("ordinal") - A.CENTRE) / 1000
    fit = aggregates.solve_gram(aggregates.gram(_daily(spark, d, ("b0",)), [F.lit(1.0), x], F.col("b0")), 2)
    return fit.select("py", "px", "n", _r("b_0", 3).alias("b_0"), _r("b_1", 3).alias("b_1"), F.round(F.col("rss") / F.col("n"), 0).alias("mse"))


# least squares by taking one feature after the other out of the rest
@query(f"""WITH {A.OBS}, {A.DAILY}, v AS (SELECT py, px, b0 AS y, (ordinal - {A.CENTRE}) / 1000 AS x, cos(2 * pi() / 365.25 * ordinal) AS c, sin(2 * pi() / 365.25 * ordinal) AS s FROM daily),
m AS (SELECT py, px, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(c) AS mc, avg(s) AS ms FROM v GROUP BY py, px),
v1 AS (SELECT py, px, n, my, mx, mc, ms, y - my AS y, x - mx AS x, c - mc AS c, s - ms AS s FROM v JOIN m USING (py, px)),
f1 AS (SELECT py, px, sum(x * y) / sum(x * x) AS xy, sum(x * c) / sum(x * x) AS xc, sum(x * s) / sum(x * x) AS xs FROM v1 GROUP BY py, px),
v2 AS (SELECT v1.*EXCLUDE (y, c, s), xy, xc, xs, y - xy * x AS y, c - xc * x AS c, s - xs * x AS s FROM v1 JOIN f1 USING (py, px)),
f2 AS (SELECT py, px, sum(c * y) / sum(c * c) AS cy, sum(c * s) / sum(c * c) AS cs FROM v2 GROUP BY py, px),
v3 AS (SELECT v2.*EXCLUDE (y, s), cy, cs, y - cy * c AS y, s - cs * c AS s FROM v2 JOIN f2 USING (py, px)),
f3 AS (SELECT py, px, any_value(n) AS n, any_value(my) AS my, any_value(mx) AS mx, any_value(mc) AS mc, any_value(ms) AS ms, any_value(xy) AS xy, any_value(xc) AS xc, any_value(xs) AS xs, any_value(cy) AS cy, any_value(cs) AS cs,
  sum(s * y) / sum(s * s) AS b3, sum(y * y) - sum(s * y) ** 2 / sum(s * s) AS rss FROM v3 GROUP BY py, px),
b AS (SELECT *, cy - cs * b3 AS b2, xy - xc * (cy - cs * b3) - xs * b3 AS b1 FROM f3)
SELECT py, px, n, round(my - b1 * mx - b2 * mc - b3 * ms, 3) AS b_0, round(b1, 3) AS b_1, round(b2, 3) AS b_2, round(b3, 3) AS b_3, round(rss / n, 0) AS mse FROM b""")
def ols_harmonic_fit(spark, d):
    design = Design("1 + x + harm(ordinal, 1)")
    rows = _daily(spark, d, ("b0",)).withColumn("x", (F.col("ordinal") - A.CENTRE) / 1000)
    fit = aggregates.solve_gram(aggregates.gram(rows, [f.column for f in design.features], F.col("b0")), 4)
    return fit.select("py", "px", "n", *(_r(f"b_{k}", 3).alias(f"b_{k}") for k in range(4)), F.round(F.col("rss") / F.col("n"), 0).alias("mse"))


# -- windows -------------------------------------------------------------------
EXPANDING = "WINDOW w AS (PARTITION BY py, px ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {A.OBS}, {A.DAILY}, g AS (SELECT py, px, ordinal, b0, ordinal - {A.CENTRE} AS x, count(b0) OVER w AS n, avg(ordinal - {A.CENTRE}) OVER w AS m, regr_sxx(b0, ordinal - {A.CENTRE}) OVER w AS s,
  regr_slope(b0, ordinal - {A.CENTRE}) OVER w AS b, regr_intercept(b0, ordinal - {A.CENTRE}) OVER w AS a FROM daily {EXPANDING})
  SELECT py, px, ordinal, round((b0 - a - b * x) / sqrt(1 + 1.0 / n + (x - m) ** 2 / s), 2) AS recresid FROM g WHERE n >= 2 AND s > 0""")
def recresid_linear(spark, d):
    rows = _daily(spark, d, ("b0",)).withColumn("x", F.col("ordinal") - A.CENTRE)
    return windows.recursive_residuals(rows, "b0").where("recresid is not null").select("py", "px", "ordinal", _r("recresid", 2).alias("recresid"))


RESID = f"""{A.OBS}, {A.DAILY}, fit AS (SELECT py, px, regr_slope(b0, ordinal - {A.CENTRE}) AS b, regr_intercept(b0, ordinal - {A.CENTRE}) AS a FROM daily GROUP BY py, px),
res AS (SELECT py, px, ordinal, b0 - a - b * (ordinal - {A.CENTRE}) AS r FROM daily JOIN fit USING (py, px)),
cum AS (SELECT py, px, r, sum(r) OVER (PARTITION BY py, px ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS c FROM res),
stat AS (SELECT py, px, count(*) AS n, max(abs(c)) / sqrt(sum(r * r) * count(*) / (count(*) - 2)) AS s FROM cum GROUP BY py, px)"""
TAIL = "(CASE WHEN s < 0.3 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 13), lambda k: 2 * (-1) ** (k - 1) * exp(-2 * k * k * s * s))))) END)"


@query(f"WITH {RESID} SELECT py, px, n, round(s, 4) AS statistic, round({TAIL}, 4) AS p_value FROM stat")
def cusum_test(spark, d):
    rows = windows.line_residuals(_daily(spark, d, ("b0",)).withColumn("x", F.col("ordinal") - A.CENTRE), "b0")
    return windows.cusum_test(rows, "resid").select("py", "px", "n", _r("statistic").alias("statistic"), _r("p_value").alias("p_value"))


def _omission(spark, d, how):
    rows = _dealt(spark, d, ("b0", "b1")).withColumn("x", F.col("ordinal") - A.CENTRE)
    whole = rows.groupBy("py", "px").agg(F.lit(0).alias("seg_id"), F.min("ordinal").alias("start"), F.max("ordinal").alias("end"))
    return segmentation.drifting_segments(rows, whole, ["b0", "b1"], 0.3, how).select("py", "px", "omission")


def _omission_sql(how: str) -> str:
    other = re.sub(r"\b(fit|res|cum|stat)\b(?! *\()", r"\g<1>1", RESID)
    other = other[other.index("fit1 AS") :].replace("b0", "b1")
    return f"WITH {RESID}, {other} SELECT py, px, {how}(hit) AS omission FROM (SELECT py, px, {TAIL} < 0.3 AS hit FROM stat UNION ALL SELECT py, px, {TAIL} < 0.3 FROM stat1) GROUP BY py, px"


@query(_omission_sql("bool_or"))
def omission_any(spark, d):
    return _omission(spark, d, "ANY")


@query(_omission_sql("bool_and"))
def omission_all(spark, d):
    return _omission(spark, d, "ALL")


@query(f"WITH {A.OBS}, {A.DAILY}, r AS (SELECT py, px, ordinal, ((ordinal - {DAY}) % 365.25 + 365.25) % 365.25 AS off FROM daily), k AS (SELECT *, row_number() OVER (PARTITION BY py, px ORDER BY off, ordinal) AS rank FROM r) SELECT py, px, ordinal, round(off::DOUBLE, 2) AS distance, rank::BIGINT AS rank FROM k WHERE rank <= 8")
def doy_nearest_k(spark, d):
    got = windows.nearest_in_season(_daily(spark, d, ("b0",)), DAY, 8)
    return got.select("py", "px", "ordinal", _r("distance", 2).alias("distance"), F.col("rank").cast("long").alias("rank"))


PERIOD = f"""{A.OBS}, {A.DAILY}, y AS (SELECT *, CAST(year({ORD}) AS INTEGER) AS year FROM daily),
y2 AS (SELECT *, year - min(year) OVER p AS i, max(year) OVER p - min(year) OVER p + 1 AS n, CAST(ceil((max(year) OVER p - min(year) OVER p) / 3.0) AS INTEGER) AS g FROM y WINDOW p AS (PARTITION BY py, px)),
per AS (SELECT *, CAST(CASE WHEN g <= 1 THEN 0 WHEN i < (n % g) * (n // g + 1) THEN i // (n // g + 1) ELSE (n % g) + (i - (n % g) * (n // g + 1)) // (n // g) END AS INTEGER) AS period FROM y2)"""


def _periods(spark, d):
    return windows.group_years(_daily(spark, d).withColumn("year", F.year(C.from_ordinal(F.col("ordinal")))))


@query(f"WITH {PERIOD} SELECT DISTINCT py, px, year, period FROM per")
def group_years(spark, d):
    return _periods(spark, d).select("py", "px", "year", "period").distinct()


@query(f"WITH {PERIOD}, q AS (SELECT py, px, period, quantile_cont(b0, 0.1) AS a, quantile_cont(b0, 0.9) AS z FROM per GROUP BY 1, 2, 3) SELECT py, px, ordinal, period, round((b0 - a) / nullif(z - a, 0), 4) AS scaled FROM per JOIN q USING (py, px, period)")
def scale_evi(spark, d):
    return windows.scale_by_period(_periods(spark, d), "b0").select("py", "px", "ordinal", "period", _r("scaled").alias("scaled"))


@query(f"WITH {A.OBS}, {A.DAILY} SELECT py, px, count(*) FILTER (ordinal <= {DAY}) AS index FROM daily GROUP BY py, px")
def date2index(spark, d):
    return dates_up_to(_daily(spark, d, ("b0",)), DAY)


@query(f"WITH {A.OBS}, {A.DAILY}, s AS (SELECT *, abs(b0 - 2500) / 800 AS score FROM daily) SELECT py, px, ordinal, count(score) OVER w = 3 AND min(score) OVER w > 1 AS change FROM s WINDOW w AS (PARTITION BY py, px ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)")
def static_monitor(spark, d):
    rows = _daily(spark, d, ("b0",)).withColumn("score", F.abs(F.col("b0") - 2500) / 800)
    return windows.look_ahead_change(rows, "score", 3, 1.0).select("py", "px", "ordinal", "change")


# -- joins with segments -------------------------------------------------------
@query(f"WITH {A.SEGMENTS} SELECT s.py, s.px, s.seg_id, count(*) AS n, round(avg(o.b0), 3) AS b0 FROM daily o JOIN seg s ON o.py = s.py AND o.px = s.px AND o.ordinal BETWEEN s.start AND s.\"end\" GROUP BY 1, 2, 3")
def segment_obs_rangejoin(spark, d):
    return segmentation.observations_of_segments(_daily(spark, d), A.segments(spark, d)).groupBy("py", "px", "seg_id").agg(F.count("*").alias("n"), F.round(F.avg("b0"), 3).alias("b0"))


def _rss(cond: str) -> str:
    y, x = f"CASE WHEN {cond} THEN o.b0 END", f"CASE WHEN {cond} THEN o.ordinal - {A.CENTRE} END"
    return f"greatest(0, regr_syy({y}, {x}) - regr_sxy({y}, {x}) ** 2 / regr_sxx({y}, {x}))"


@query(f"""WITH {A.SEGMENTS}, pr AS (SELECT py, px, seg_id, lag(start) OVER w AS s1, lag("end") OVER w AS e1, start AS s2, "end" AS e2 FROM seg WINDOW w AS (PARTITION BY py, px ORDER BY seg_id)),
g AS (SELECT o.py, o.px, seg_id, count(*) AS n, count(*) FILTER (o.ordinal <= e1) AS n1, count(*) FILTER (o.ordinal > s2) AS n2, {_rss('TRUE')} AS r, {_rss('o.ordinal <= e1')} AS r1, {_rss('o.ordinal > s2')} AS r2
  FROM daily o JOIN pr ON o.py = pr.py AND o.px = pr.px AND o.ordinal > s1 AND o.ordinal <= e2 WHERE s1 IS NOT NULL GROUP BY 1, 2, 3)
SELECT py, px, seg_id, n, round(((r - r1 - r2) / 2) / ((r1 + r2) / (n - 4)), 3) AS f FROM g WHERE n1 > 2 AND n2 > 2""")
def chow_pairwise(spark, d):
    rows = _daily(spark, d, ("b0",)).withColumn("x", F.col("ordinal") - A.CENTRE)
    return segmentation.chow_pairs(rows, A.segments(spark, d), "b0").select("py", "px", "seg_id", "n", _r("f", 3).alias("f"))


# -- maps ----------------------------------------------------------------------
def _at(day: int, after: bool = False, before: bool = False) -> str:
    parts = [f'SELECT *, 3 AS qa, seg_id AS place FROM seg WHERE start <= {day} AND "end" >= {day}']
    if after:
        parts.append(f'SELECT *, 2, -seg_id FROM seg WHERE start >= {day} AND NOT (start <= {day} AND "end" >= {day})')
    if before:
        parts.append(f'SELECT *, 1, seg_id FROM seg WHERE "end" <= {day} AND brk = 0 AND NOT (start <= {day} AND "end" >= {day}) {f"AND NOT start >= {day}" if after else ""}')
    return f"{A.SEGMENTS}, {A.GRID}, cand AS ({' UNION ALL '.join(parts)}), pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY py, px ORDER BY qa DESC, place DESC) AS rk FROM cand) WHERE rk = 1)"


def _map(select: str, **how) -> str:
    return f"WITH {_at(DAY, **how)} SELECT grid.py, grid.px, {select} FROM grid LEFT JOIN pick USING (py, px)"


def _seg(spark, d):
    return A.segments(spark, d), A.grid(spark, d)


@query(_map("coalesce(CAST(seg_id AS INTEGER), -1) AS seg_id, coalesce(qa, 0) AS qa"))
def map_intersect(spark, d):
    s, g = _seg(spark, d)
    return maps.on_grid(maps.at_date(s, DAY).select("py", "px", "seg_id", "qa"), g, -1).withColumn("qa", F.greatest(F.col("qa"), F.lit(0)))


@query(_map("coalesce(seg_id, -1) AS seg_id", before=True))
def map_before(spark, d):
    s, g = _seg(spark, d)
    return maps.on_grid(maps.at_date(s, DAY, before=True).select("py", "px", "seg_id"), g, -1)


@query(_map("coalesce(seg_id, -1) AS seg_id", after=True))
def map_after(spark, d):
    s, g = _seg(spark, d)
    return maps.on_grid(maps.at_date(s, DAY, after=True).select("py", "px", "seg_id"), g, -1)


@query(_map("coalesce(qa, 0) AS qa", after=True, before=True))
def map_qa(spark, d):
    s, g = _seg(spark, d)
    return maps.on_grid(maps.at_date(s, DAY, True, True).select("py", "px", "qa"), g, 0)


@query(_map(f"round(coalesce(i0 + s0 * (start + \"end\" - {2 * A.CENTRE}) / 2.0, -9999), 2) AS B1_Intercept, round(coalesce(i1 + s1 * (start + \"end\" - {2 * A.CENTRE}) / 2.0, -9999), 2) AS B2_Intercept, round(coalesce(s0, -9999), 4) AS B1_x, round(coalesce(s1, -9999), 4) AS B2_x, round(coalesce(r0, -9999), 3) AS B1_RMSE, round(coalesce(r1, -9999), 3) AS B2_RMSE, coalesce(qa, 0) AS SegmentQAQC", after=True, before=True))
def map_coef(spark, d):
    s, g = _seg(spark, d)
    m = maps.coefficient_map(s, g, DAY, ["Intercept", "x"], 2, after=True, before=True, centre=A.CENTRE)
    places = {"B1_Intercept": 2, "B2_Intercept": 2, "B1_x": 4, "B2_x": 4, "B1_RMSE": 3, "B2_RMSE": 3}
    return m.select("py", "px", *(F.round(c, n).alias(c) for c, n in places.items()), "SegmentQAQC")


@query(_map('round(coalesce(sqrt(s0 * s0 + s1 * s1), -9999), 4) AS "B1_amplitude(x,1)"'))
def map_amplitude(spark, d):
    s, g = _seg(spark, d)
    # the two bands' slopes stand for a harmonic pair of one band
    paired = s.withColumn("coef", F.expr("array(array(coef[0][0]), array(coef[1][0]), array(coef[1][1]))"))
    m = maps.coefficient_map(paired, g, DAY, ["Intercept", "harm(x, 1)[0]", "harm(x, 1)[1]"], 1, coefs=("seasonality",), amplitude=True, with_rmse=False, qa=False)
    return m.select("py", "px", F.round("B1_amplitude(x,1)", 4).alias("B1_amplitude(x,1)"))


@query(_map(f"CAST(coalesce(CASE WHEN abs(trunc(i0 + s0 * {DAY - A.CENTRE})) <= 32767 THEN trunc(i0 + s0 * {DAY - A.CENTRE}) END, -9999) AS SMALLINT) AS Band_0"))
def predict_at_date(spark, d):
    s, g = _seg(spark, d)
    return maps.prediction_map(s, g, DAY, "1 + x + C(sensor)", 2, bands=[1], centre=A.CENTRE)


@query(_map("CAST(coalesce(class, 0) AS INTEGER) AS Classification, CAST(CASE WHEN qa IS NULL THEN 0 ELSE trunc(round(greatest(p0, 0.5) * 10000, 3)) END AS INTEGER) AS PredProba_x10000"))
def map_class(spark, d):
    s, g = _seg(spark, d)
    return maps.class_map(s, g, DAY, proba=True)


@query(_map("CAST(coalesce(spring_doy, -9999) AS INTEGER) AS SpringDOY, CAST(coalesce(autumn_doy, -9999) AS INTEGER) AS AutumnDOY, CAST(coalesce(autumn_doy - spring_doy, -9999) AS INTEGER) AS GrowingDOY, CAST(coalesce(peak_doy, -9999) AS INTEGER) AS PeakDOY, CAST(coalesce(trunc(round(peak_evi * 10000, 3)), -9999) AS INTEGER) AS PeakEVI, CAST(CASE WHEN qa IS NULL THEN -9999 ELSE 5000 END AS INTEGER) AS SplineR, CAST(coalesce(n, -9999) AS INTEGER) AS NObs"))
def map_pheno(spark, d):
    s, g = _seg(spark, d)
    return maps.phenology_map(s, g, DAY)


def _change(pick: str, extra: str = "") -> str:
    return f"WITH {A.SEGMENTS}, {A.GRID}, c AS (SELECT py, px, {pick}(brk, seg_id) AS b{', ' + pick + '(m1, seg_id) AS m' if extra else ''} FROM seg WHERE brk BETWEEN {RANGE[0]} AND {RANGE[1]} GROUP BY py, px) SELECT py, px, coalesce(CAST(strftime(DATE '1970-01-01' + (b - 719163), '%Y%j') AS INTEGER), -9999) AS change{extra} FROM grid LEFT JOIN c USING (py, px)"


@query(_change("arg_min"))
def change_first(spark, d):
    return changes.change_date_map(*_seg(spark, d), *RANGE, first=True)


@query(_change("arg_max"))
def change_last(spark, d):
    return changes.change_date_map(*_seg(spark, d), *RANGE)


@query(_change("arg_max", ", coalesce(m, -9999) AS MagnitudeIndex1"))
def change_magnitude(spark, d):
    s, g = _seg(spark, d)
    return changes.change_date_map(s, g, *RANGE, magnitude=changes.magnitude_bands(s, 2))


@query(f"WITH {A.SEGMENTS}, {A.GRID}, c AS (SELECT py, px, count(*) AS k FROM seg WHERE brk BETWEEN {RANGE[0]} AND {RANGE[1]} GROUP BY py, px) SELECT py, px, CAST(coalesce(k, -9999) AS INTEGER) AS n_changes FROM grid LEFT JOIN c USING (py, px)")
def change_num(spark, d):
    return changes.change_count_map(*_seg(spark, d), *RANGE)


@query(f"WITH {A.SEGMENTS} SELECT CAST(1 AS INTEGER) AS band FROM seg HAVING bool_or(m1 <> 0)")
def magnitude_indices(spark, d):
    found = changes.magnitude_bands(A.segments(spark, d), 2)
    return spark.createDataFrame([(b,) for b in found], "band int")


@query(f"WITH {A.SEGMENTS} SELECT py, px, seg_id, CAST(t.day AS INTEGER) AS ordinal, round(i0 + s0 * (t.day - {A.CENTRE}), 3) AS b0, round(i1 + s1 * (t.day - {A.CENTRE}), 3) AS b1 FROM seg, unnest(range(start, \"end\")) t(day)")
def fitted_curve(spark, d):
    curves = jobs.fitted_curves(A.segments(spark, d), "1 + x", A.CENTRE)
    return curves.select("py", "px", "seg_id", "ordinal", *(F.round(F.element_at("fitted", k + 1), 3).alias(f"b{k}") for k in range(2)))


# -- training ------------------------------------------------------------------
MID = f"(start + \"end\" - {2 * A.CENTRE}) / 2.0"


@query(f"WITH {A.SEGMENTS}, {A.LABELS} SELECT l.py, l.px, l.label, round(i0 + s0 * {MID}, 2) AS f0, round(i1 + s1 * {MID}, 2) AS f1, round(s0, 4) AS f2, round(s1, 4) AS f3, round(r0, 3) AS f4, round(r1, 3) AS f5 FROM labels_ l JOIN seg USING (py, px) WHERE l.label NOT IN (0) AND start < {DAY} AND \"end\" > {DAY + 10}")
def train_features(spark, d):
    t = classify.training_table(A.labels(spark, d), A.segments(spark, d), DAY, DAY + 10, [0], 1, A.CENTRE)
    return t.select("py", "px", "label", *(F.round(F.element_at("features", k + 1), n).alias(f"f{k}") for k, n in enumerate((2, 2, 4, 4, 3, 3))))


@query(f"WITH {A.LABELS} SELECT py, px, label FROM labels_ WHERE label NOT IN (0, 3)")
def roi_filter(spark, d):
    return classify.roi(A.labels(spark, d), [0, 3])


@query(f"WITH {A.LABELS} SELECT py, px, label, CAST((row_number() OVER (ORDER BY py, px) - 1) % 3 AS INTEGER) AS fold FROM labels_")
def kfold_assign(spark, d):
    return classify.kfold(A.labels(spark, d), 3, ["py", "px"])


@query(f"WITH {A.LABELS} SELECT py, px, label, CAST((row_number() OVER (PARTITION BY label ORDER BY py, px) - 1) % 3 AS INTEGER) AS fold FROM labels_")
def stratified_kfold(spark, d):
    return classify.kfold(A.labels(spark, d), 3, ["py", "px"], "label")


@query(f"""WITH RECURSIVE {A.LABELS}, n AS (SELECT py, px, label, py::BIGINT * 1048576 + px AS id FROM labels_ WHERE label <> 0),
r(py, px, label, id) AS (SELECT * FROM n UNION SELECT n.py, n.px, n.label, r.id FROM r JOIN n ON n.label = r.label AND abs(n.py - r.py) + abs(n.px - r.px) = 1)
SELECT py, px, label, min(id) AS component FROM r GROUP BY py, px, label""")
def spatial_components(spark, d):
    return classify.components(A.labels(spark, d)).select("py", "px", "label", "component")


@query(f"""WITH RECURSIVE {A.LABELS}, n AS (SELECT py, px, label, py::BIGINT * 1048576 + px AS id FROM labels_ WHERE label <> 0),
r(py, px, label, id) AS (SELECT * FROM n UNION SELECT n.py, n.px, n.label, r.id FROM r JOIN n ON n.label = r.label AND abs(n.py - r.py) + abs(n.px - r.px) = 1),
c AS (SELECT py, px, label, min(id) AS component FROM r GROUP BY py, px, label)
SELECT py, px, label, component, CAST((dense_rank() OVER (ORDER BY component) - 1) % 3 AS INTEGER) AS fold FROM c""")
def spatial_folds(spark, d):
    return classify.spatial_folds(A.labels(spark, d), 3).select("py", "px", "label", "component", "fold")


@query()
def rf_classify(spark, d):
    s = A.segments(spark, d)
    table = classify.training_table(A.labels(spark, d), s, DAY, DAY + 10, [0], 1, A.CENTRE)
    model = classify.train(table, {"algorithm": "RandomForest", "RandomForest": {"init": {"n_estimators": 20, "max_depth": 6}}})
    return classify.classify(s, model, 1, A.CENTRE).select("py", "px", "seg_id", "class", "class_proba")


FOREST = {"algorithm": "RandomForest", "RandomForest": {"init": {"n_estimators": 10, "max_depth": 5}}}


def _training(spark, d) -> DataFrame:
    return classify.training_table(A.labels(spark, d), A.segments(spark, d), DAY, DAY + 10, [0], 1, A.CENTRE)


@query()
def forest_scores(spark, d):
    return classify.diagnostics(_training(spark, d), FOREST, 3)


@query()
def forest_importances(spark, d):
    return classify.importances(classify.train(_training(spark, d), FOREST), classify.feature_names(["Intercept", "x"], 2))


# -- incremental ---------------------------------------------------------------
def _images(spark, d):
    c = A.obs(spark, d).select("ordinal").distinct()
    return c.where("ordinal % 3 <> 0"), c.where("ordinal % 2 = 0")


IMG = f"{A.OBS}, old AS (SELECT DISTINCT ordinal FROM obs WHERE ordinal % 3 <> 0), want AS (SELECT DISTINCT ordinal FROM obs WHERE ordinal % 2 = 0)"


@query(f"WITH {IMG} SELECT ordinal FROM old WHERE ordinal IN (SELECT ordinal FROM want)")
def cache_retain(spark, d):
    old, want = _images(spark, d)
    return incremental.retained(old, want, "ordinal")


@query(f"WITH {IMG} SELECT ordinal FROM want WHERE ordinal NOT IN (SELECT ordinal FROM old)")
def cache_insert(spark, d):
    old, want = _images(spark, d)
    return incremental.missing(want, old, "ordinal")


@query(f"WITH {IMG} SELECT py, px, o.ordinal, count(*) AS n FROM obs o WHERE o.ordinal IN (SELECT ordinal FROM want) GROUP BY 1, 2, 3")
def cache_update(spark, d):
    o = A.obs(spark, d).select("py", "px", "ordinal")
    old, want = _images(spark, d)
    return incremental.update(o.join(old, "ordinal", "left_semi"), want, o, "ordinal").groupBy("py", "px", "ordinal").agg(F.count("*").alias("n"))


@query(f"WITH {IMG} SELECT py, px, o.ordinal, count(*) AS n, round(sum(b0), 2) AS b0 FROM obs o WHERE o.ordinal IN (SELECT ordinal FROM want) GROUP BY 1, 2, 3")
def archive_read_through(spark, d):
    o = A.obs(spark, d)
    old, want = _images(spark, d)
    path = f"{Scratch(spark, 'archive').root}/archive"
    for images in (old, want, want):  # none is there, one of other images is, one of the same
        found = raster.read_through(spark, images, lambda wanted: o.join(wanted, "ordinal", "left_semi"), path, 4, "ordinal")
    return found.groupBy("py", "px", "ordinal").agg(F.count("*").alias("n"), F.round(F.sum("b0"), 2).alias("b0"))


@query(f"WITH {A.GRID} SELECT py, px FROM grid WHERE py NOT IN (SELECT DISTINCT py FROM grid WHERE py % 2 = 0)")
def resume_antijoin(spark, d):
    g = A.grid(spark, d)
    return incremental.unfinished(g, g.where("py % 2 = 0"), "py")


@query(f"WITH {A.GRID} SELECT py, px FROM grid WHERE ((py % 3) + 3) % 3 = 1")
def distribute_interlaced(spark, d):
    return windows.job_rows(A.grid(spark, d), 1, 3)


@query(f"WITH {A.OBS} SELECT py, px, list_has_all([0, 1, 4], list(DISTINCT mask)) AS subset FROM obs GROUP BY py, px")
def array_subset(spark, d):
    return A.obs(spark, d).groupBy("py", "px").agg(F.collect_set("mask").alias("m")).select("py", "px", incremental.array_subset(F.col("m"), F.array(F.lit(0), F.lit(1), F.lit(4))).alias("subset"))


# -- kernels -------------------------------------------------------------------
def _kernel(spark, d, fn, schema: str, bands=("b0", "b1", "b2", "b3")) -> DataFrame:
    """A function of (dates, bands x observations) -> rows, for every pixel, over Arrow batches."""
    import numpy as np
    import pandas as pd

    from chronopix.shipping import ship_package

    ship_package(spark)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for p in batch.to_dict("records"):
                out += [(p["py"], p["px"], *row) for row in fn(np.asarray(p["ordinal"]), np.array([p[b] for b in bands], float))]
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=["py", "px", *names])
                    out = []
            yield pd.DataFrame(out, columns=["py", "px", *names])

    daily = daily_composite(by_pixel(A.obs(spark, d).select("py", "px", "ordinal", *bands)), list(bands))
    series = pixel_series(daily, list(bands)).select("py", "px", *(F.col("series")[c].alias(c) for c in ("ordinal", *bands)))
    return series.mapInPandas(run, f"py int, px int, {schema}")


def _regression(name: str):
    def fn(dates, y):
        from chronopix.functions.formula import Design
        from chronopix.functions.kernels import estimator, fold_intercept

        x = Design("1 + x + harm(x, 1)", columns=False).matrix({"x": dates - A.CENTRE})
        m = estimator(name).fit(x, y[0])
        return [(fold_intercept(m).tolist(),)]

    return fn


@query()
def rlm_fit(spark, d):
    return _kernel(spark, d, _regression("rlm"), "coef array<double>")


@query()
def lasso_fit(spark, d):
    return _kernel(spark, d, _regression("lasso20"), "coef array<double>")


def _masked(which: str):
    def fn(dates, y):
        from chronopix.functions import kernels

        if which == "rlm":
            keep = kernels.multitemporal_mask(dates, y, (dates[-1] - dates[0]) / 365.25, crit=1500.0, green=0, swir1=1)
        else:
            keep = kernels.smooth_mask(dates, y, 40, crit=1500.0, green=0, swir1=1)
        return list(zip(dates.tolist(), keep.tolist(), strict=True))

    return fn


@query()
def multitemp_mask(spark, d):
    return _kernel(spark, d, _masked("rlm"), "ordinal int, keep boolean", ("b0", "b1"))


@query()
def lowess_mask(spark, d):
    return _kernel(spark, d, _masked("lowess"), "ordinal int, keep boolean", ("b0", "b1"))


FORMULA = "1 + x + harm(x, 1)"
PARAMETERS = {"consecutive": 5, "threshold": 3.0, "min_obs": 16, "min_rmse": 100.0, "screening_crit": 4000.0, "green_band": 0, "swir1_band": 1, "remove_noise": True}


def _stepped(spark, d) -> DataFrame:
    o = daily_composite(by_pixel(A.obs(spark, d).select("py", "px", "ordinal", "b0", "b1")), ["b0", "b1"])
    # a step in the middle of every third pixel's series gives changes to find
    return o.withColumn("b0", F.when((F.col("px") % 3 == 0) & (F.col("ordinal") > 729700), F.col("b0") + 15000).otherwise(F.col("b0")))


def _segments(spark, d, parameters=None, **more) -> DataFrame:
    return segmentation.segment_pixels(_stepped(spark, d), ["b0", "b1"], FORMULA, PARAMETERS | (parameters or {}), centre=A.CENTRE, levels={}, dealt=True, **more)


REFITS = [{"prefix": "ols", "model": "ols", "keep_regularized": False}, {"prefix": "rlm", "model": "rlm_maxiter10", "keep_regularized": True}]


@query()
def ccdc_segments(spark, d):
    return _segments(spark, d)


@query()
def ccdc_lowess(spark, d):
    return _segments(spark, d, {"estimator": "ols", "screening": "LOWESS"})


@query()
def ccdc_seasonal_rmse(spark, d):
    return _segments(spark, d, {"estimator": "ols", "dynamic_rmse": True})


@query()
def ccdc_omission(spark, d):
    return _segments(spark, d, {"estimator": "ols"}, omission_crit=0.05)


#: The parameters of the published timings: eight bands, four of them tested.
PUBLISHED = {"test_indices": [2, 3, 4, 5], "consecutive": 5, "threshold": 4.0, "min_obs": 24, "min_rmse": 100.0, "screening_crit": 4000.0, "green_band": 0, "swir1_band": 1, "remove_noise": True}


@query()
def ccdc_eight_bands(spark, d):
    o = daily_composite(by_pixel(A.obs(spark, d).select("py", "px", "ordinal", "b0", "b1", "b2", "b3")), ["b0", "b1", "b2", "b3"])
    mixed = o.withColumns({"b4": (F.col("b0") + F.col("b1")) / 2, "b5": (F.col("b0") + F.col("b2")) / 2, "b6": (F.col("b1") + F.col("b3")) / 2, "b7": (F.col("b2") + F.col("b3")) / 2})
    return segmentation.segment_pixels(mixed, [f"b{k}" for k in range(8)], "1 + x + harm(x, 1) + harm(x, 2)", PUBLISHED, centre=A.CENTRE, levels={}, dealt=True)


@query()
def commission_merge(spark, d):
    return _segments(spark, d, commission_alpha=0.01)


@query()
def refit_segments(spark, d):
    return _segments(spark, d, refits=REFITS)


@query()
def recresid_harmonic(spark, d):
    def fn(dates, y):
        from chronopix.functions.formula import Design
        from chronopix.functions.kernels import recursive_residuals

        # the first fit is over two dozen dates: the first four alone hardly tell a trend from a season
        x = Design(FORMULA, columns=False).matrix({"x": dates - A.CENTRE})
        x[:, 1] /= 1000
        return [(int(o), float(r)) for o, r in zip(dates[24:], recursive_residuals(x, y[0], 24), strict=True)] if len(dates) > 24 else []

    return _kernel(spark, d, fn, "ordinal int, recresid double", ("b0",))


@query(f"""WITH {A.SEGMENTS}, o AS (SELECT d.py, d.px, s.seg_id, d.ordinal, d.ordinal - {A.CENTRE} AS x, unnest([d.b0, d.b1]) AS v, unnest(['b0', 'b1']) AS band FROM daily d JOIN seg s ON d.py = s.py AND d.px = s.px AND d.ordinal BETWEEN s.start AND s."end"),
fit AS (SELECT py, px, seg_id, band, regr_slope(v, x) AS b, regr_intercept(v, x) AS a FROM o GROUP BY 1, 2, 3, 4),
res AS (SELECT py, px, seg_id, band, ordinal, v - a - b * x AS r FROM o JOIN fit USING (py, px, seg_id, band)),
cum AS (SELECT py, px, seg_id, band, r, sum(r) OVER (PARTITION BY py, px, seg_id, band ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS c FROM res),
stat AS (SELECT py, px, seg_id, band, max(abs(c)) / sqrt(sum(r * r) * count(*) / (count(*) - 2)) AS s FROM cum GROUP BY 1, 2, 3, 4 HAVING count(*) > 2 AND sum(r * r) > 0)
SELECT py, px, seg_id, bool_or({TAIL} < 0.2) AS omission FROM stat GROUP BY 1, 2, 3""")
def omission_segments(spark, d):
    rows = _dealt(spark, d, ("b0", "b1")).withColumn("x", F.col("ordinal") - A.CENTRE)
    return segmentation.drifting_segments(rows, A.segments(spark, d), ["b0", "b1"], 0.2)


@query()
def phenology_ltm(spark, d):
    rows = daily_composite(by_pixel(A.obs(spark, d).select("py", "px", "ordinal", "b0")), ["b0"])
    segs = A.segments(spark, d).select("py", "px", "seg_id", "start", "end")
    return pheno.long_term_mean(rows, segs, pheno.Phenology(evi_band="b0", evi_scale=0.0002), dealt=True)


@query(f"WITH {A.OBS}, {A.DAILY} SELECT py, px, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n, CAST(count(DISTINCT year({ORD})) AS BIGINT) AS n_years FROM daily GROUP BY py, px")
def series_extent(spark, d):
    return _daily(spark, d, ("b0",)).groupBy("py", "px").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"), F.countDistinct(F.year(C.from_ordinal(F.col("ordinal")))).alias("n_years"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high, CAST(max(gap) AS BIGINT) AS longest_gap FROM (SELECT user_id, value, date_diff('second', lag(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), date_trunc('second', ts)) AS gap FROM events) GROUP BY user_id")
def event_series(spark, d):
    e = A.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = F.unix_timestamp("ts")
    return e.withColumn("gap", s - F.lag(s).over(w)).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.max("gap").alias("longest_gap"))
