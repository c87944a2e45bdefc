"""Views of star-schema tables as an image archive, for the registered queries.

lineitem becomes observations: a supplier is a pixel, a ship date an acquisition,
and quantity, price, discount and tax are bands.  Each view has its twin in
DuckDB's SQL as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopix.functions.columns import to_ordinal

NCOL = 10
#: Ordinals are centred here before regressions.
CENTRE = 729000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """py, px, ordinal, b0..b3, mask, sensor."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.expr(f"int(l_suppkey div {NCOL})").alias("py"), F.expr(f"int(l_suppkey % {NCOL})").alias("px"), to_ordinal(F.to_date("l_shipdate")).alias("ordinal"),
        (F.col("l_quantity") * 100).alias("b0"), (F.col("l_extendedprice") / 10).alias("b1"), (F.col("l_discount") * 10000).alias("b2"), (F.col("l_tax") * 10000).alias("b3"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(4).alias("mask"), F.col("l_linestatus").alias("sensor"),
    )


OBS = f"""obs AS (SELECT CAST(l_suppkey // {NCOL} AS INTEGER) AS py, CAST(l_suppkey % {NCOL} AS INTEGER) AS px,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 719163 AS INTEGER) AS ordinal,
  l_quantity * 100 AS b0, l_extendedprice / 10 AS b1, l_discount * 10000 AS b2, l_tax * 10000 AS b3,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 4 END AS mask, l_linestatus AS sensor FROM lineitem)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and three pixels that nothing was observed in."""
    t = table(spark, sf_dir, "supplier").select(F.expr(f"int(s_suppkey div {NCOL})").alias("py"), F.expr(f"int(s_suppkey % {NCOL})").alias("px"))
    return t.unionByName(spark.range(3).select(F.lit(-1).alias("py"), F.col("id").cast("int").alias("px"))).distinct()


GRID = f"grid AS (SELECT DISTINCT CAST(s_suppkey // {NCOL} AS INTEGER) AS py, CAST(s_suppkey % {NCOL} AS INTEGER) AS px FROM supplier UNION SELECT -1, CAST(x AS INTEGER) FROM range(3) t(x))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of a pixel as a segment: start, end, break, coef (2 x 2), rmse, magnitude, class_proba."""
    from chronopix.operators.prep import by_pixel, daily_composite

    d = daily_composite(by_pixel(obs(spark, sf_dir).select("py", "px", "ordinal", "b0", "b1")), ["b0", "b1"])
    x = F.col("ordinal") - CENTRE
    year = F.year(F.date_from_unix_date(F.col("ordinal") - 719163))
    fit = lambda b: (F.regr_intercept(b, x), F.regr_slope(b, x), F.sqrt(F.greatest(F.lit(0.0), (F.regr_syy(b, x) - F.pow(F.regr_slope(b, x), F.lit(2.0)) * F.regr_sxx(b, x)) / F.count("*"))))
    (i0, s0, r0), (i1, s1, r1) = fit(F.col("b0")), fit(F.col("b1"))
    g = d.groupBy("py", "px", year.alias("year")).agg(F.min("ordinal").alias("start"), F.max("ordinal").alias("end"), i0.alias("i0"), s0.alias("s0"), r0.alias("r0"), i1.alias("i1"), s1.alias("s1"), r1.alias("r1"), F.count("*").alias("n"))
    w = Window.partitionBy("py", "px").orderBy("start")
    return g.select(
        "py", "px", (F.row_number().over(w) - 1).alias("seg_id"), "year", "start", "end", F.when(F.col("year") % 3 == 0, F.lit(0)).otherwise(F.coalesce(F.lead("start").over(w), F.lit(0))).alias("break"),
        F.array(F.array("i0", "i1"), F.array("s0", "s1")).alias("coef"), F.array("r0", "r1").alias("rmse"),
        F.array(F.lit(0.0), (F.col("n") % 7 - 3).cast("double")).alias("magnitude"), (F.col("year") % 5 + 1).alias("class"), F.array((F.col("n") % 10) / 20.0, F.lit(0.5)).alias("class_proba"),
        (F.col("n") % 100 + 60).alias("spring_doy"), (F.col("n") % 90 + 250).alias("autumn_doy"), F.lit(0.5).alias("pheno_cor"), ((F.col("n") % 9) / 10.0).alias("peak_evi"), (F.col("n") % 200).alias("peak_doy"), F.col("n").alias("pheno_nobs"),
    )


DAILY = "daily AS (SELECT py, px, ordinal, avg(b0) AS b0, avg(b1) AS b1, avg(b2) AS b2, avg(b3) AS b3 FROM obs GROUP BY py, px, ordinal)"
SEGMENTS = f"""{OBS}, {DAILY},
seg0 AS (SELECT py, px, CAST(year(DATE '1970-01-01' + (ordinal - 719163)) AS INTEGER) AS year, min(ordinal) AS start, max(ordinal) AS "end", count(*) AS n,
  regr_intercept(b0, ordinal - {CENTRE}) AS i0, regr_slope(b0, ordinal - {CENTRE}) AS s0, sqrt(greatest(0, (regr_syy(b0, ordinal - {CENTRE}) - regr_slope(b0, ordinal - {CENTRE}) ** 2 * regr_sxx(b0, ordinal - {CENTRE})) / count(*))) AS r0,
  regr_intercept(b1, ordinal - {CENTRE}) AS i1, regr_slope(b1, ordinal - {CENTRE}) AS s1, sqrt(greatest(0, (regr_syy(b1, ordinal - {CENTRE}) - regr_slope(b1, ordinal - {CENTRE}) ** 2 * regr_sxx(b1, ordinal - {CENTRE})) / count(*))) AS r1
  FROM daily GROUP BY 1, 2, 3),
seg AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS seg_id, CASE WHEN year % 3 = 0 THEN 0 ELSE coalesce(lead(start) OVER w, 0) END AS brk, year % 5 + 1 AS class,
  (n % 7 - 3)::DOUBLE AS m1, (n % 10) / 20.0 AS p0, n % 100 + 60 AS spring_doy, n % 90 + 250 AS autumn_doy, (n % 9) / 10.0 AS peak_evi, n % 200 AS peak_doy FROM seg0 WINDOW w AS (PARTITION BY py, px ORDER BY start))"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """py, px, label: the nation of a supplier modulo 5 (0 is masked)."""
    return table(spark, sf_dir, "supplier").select(F.expr(f"int(s_suppkey div {NCOL})").alias("py"), F.expr(f"int(s_suppkey % {NCOL})").alias("px"), (F.col("s_nationkey") % 5).cast("int").alias("label"))


LABELS = f"labels_ AS (SELECT CAST(s_suppkey // {NCOL} AS INTEGER) AS py, CAST(s_suppkey % {NCOL} AS INTEGER) AS px, CAST(s_nationkey % 5 AS INTEGER) AS label FROM supplier)"
