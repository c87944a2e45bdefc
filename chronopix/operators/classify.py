"""Training and classification of segments, and folds for their validation."""

from __future__ import annotations

import warnings

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopix.errors import TrainingDataError, UnknownAlgorithm
from chronopix.operators.components import connected_components
from chronopix.operators.maps import class_features
from chronopix.scratch import Scratch

_PARAMETERS = {"n_estimators": "numTrees", "criterion": "impurity", "max_features": "featureSubsetStrategy", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "bootstrap": "bootstrap", "random_state": "seed"}
#: Without effect on the trees.
_IGNORED = {"n_jobs", "verbose", "min_density", "compute_importances"}
#: What Spark's forest cannot honour, each with the values that ask for nothing.
_UNSUPPORTED = {"oob_score": (False, None), "min_samples_split": (1, 2, None), "max_leaf_nodes": (None,), "warm_start": (False, None)}
#: The deepest tree that Spark's forest grows.
_DEEPEST = 30


def classifier(config: dict) -> RandomForestClassifier:
    """A random forest from {'algorithm': 'RandomForest', 'RandomForest': {'init': {...}}}.

    Trees grow to depth 30, Spark's limit, unless ``max_depth`` is less.  A parameter that cannot be honoured gives a warning.
    """
    name = config.get("algorithm")
    if name != "RandomForest":
        raise UnknownAlgorithm(f"no classifier {name!r}")
    init = ((config.get(name) or {}).get("init")) or {}
    out = RandomForestClassifier(featuresCol="vector", labelCol="label", probabilityCol="probability", predictionCol="prediction", seed=0, maxDepth=_DEEPEST)
    for k, v in init.items():
        if k in _IGNORED:
            continue
        if k in _UNSUPPORTED:
            if v not in _UNSUPPORTED[k]:
                warnings.warn(f"{k}={v!r} of {name} has no effect here", stacklevel=2)
            continue
        if k not in _PARAMETERS:
            raise TypeError(f"unknown parameter {k!r} of {name}")
        if k == "max_features":
            v = {None: "all", "auto": "auto"}.get(v, str(v))
        if k == "max_depth":
            if v is not None and int(v) > _DEEPEST:
                warnings.warn(f"max_depth={v!r} of {name} is more than {_DEEPEST}, the deepest here", stacklevel=2)
            v = _DEEPEST if v is None else min(_DEEPEST, int(v))
        if v is not None:
            out = out._set(**{_PARAMETERS[k]: v})
    return out


def roi(labels: DataFrame, masked: list[int] | None) -> DataFrame:
    return labels.where(~F.col("label").isin(*masked)) if masked else labels


def training_table(labels: DataFrame, segments: DataFrame, start: int, end: int, masked: list[int] | None = None, slope: int | None = 1, centre: int = 0, check: bool = True) -> DataFrame:
    """py, px, label, features: each labelled pixel with the one segment that holds all of (start, end).

    Pixels without such a segment are left out.  More than one is an error, raised
    inside the job (``check``), so no separate pass is needed.
    """
    holding = segments.where((F.col("start") < start) & (F.col("end") > end))
    rows = roi(labels, masked).join(class_features(holding, slope, centre).select("py", "px", "features"), ["py", "px"])
    if check:
        # copies of a label row are not ambiguous; several segments of one label row are
        n = F.count("*").over(Window.partitionBy(*[c for c in labels.columns if c in rows.columns]))
        rows = rows.withColumn("_n", n).withColumn("label", F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one segment holds the training dates")).cast("int")).otherwise(F.col("label"))).drop("_n")
    return rows


def train(table: DataFrame, config: dict) -> RandomForestClassificationModel:
    """Fit a classifier; raises TrainingDataError without training rows."""
    rows = table.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    if rows.isEmpty():
        raise TrainingDataError("no labelled pixel has a segment")
    return classifier(config).fit(rows)


def classify(segments: DataFrame, model: RandomForestClassificationModel, slope: int | None = 1, centre: int = 0) -> DataFrame:
    """The segments with class and class_proba, in place of any that they had."""
    base = segments.drop("class", "class_proba")
    scored = model.transform(class_features(base, slope, centre).withColumn("vector", array_to_vector("features")))
    return scored.select(*base.columns, F.col("prediction").cast("int").alias("class"), vector_to_array("probability", "float32").alias("class_proba"))


def ranked(df: DataFrame, order: list[str], stratum: str | None = None) -> DataFrame:
    """Adds ``_rank``: each row's place, from 0, in the order, within its stratum if one is given.

    Rows are dealt to ranges of the order and numbered within each; only the ranges'
    counts are summed up, so no task sees all rows.
    """
    keys = [stratum] if stratum else []
    scratch = Scratch(df.sparkSession, "ranked")
    dealt = scratch.keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")  # written, so that ranges stay as they are
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias("_stratum") for c in keys), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    same = F.col("_range") == F.col("_at")
    if stratum:
        same &= F.col(stratum).eqNullSafe(F.col("_stratum"))
    own = Window.partitionBy(*keys, "_range").orderBy(*order)
    numbered = dealt.withColumn("_rank", F.row_number().over(own) - 1).join(starts, same)
    return numbered.select(*df.columns, (F.col("_rank") + F.col("_from")).alias("_rank"))


def kfold(df: DataFrame, k: int, order: list[str], stratify: str | None = None) -> DataFrame:
    """Adds ``fold``: rows dealt in order to k folds, within each stratum if given."""
    return ranked(df, order, stratify).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def components(labels: DataFrame) -> DataFrame:
    """Adds ``component``: the smallest py * 2^20 + px of the 4-connected pixels of one label.

    Pixels and their neighbours below and to the right are linked, and the links
    run through large-star and small-star steps until nothing changes, so a region
    may be of any length.  Each round's table is written to the shared folder.
    """
    scratch = Scratch(labels.sparkSession, "regions")
    at = F.col("py").cast("long") * (1 << 20) + F.col("px")
    # component goes first: the least pixel of a region by the struct's order has the least component
    now = scratch.keep(labels.where("label <> 0").select("py", "px", "label", F.struct(at.alias("component"), "py", "px", "label").alias("_p")), "pixels")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0))))
    ends = now.withColumn("_s", F.explode(steps)).select((F.col("py") + F.col("_s.a")).alias("py"), (F.col("px") + F.col("_s.b")).alias("px"), "label", F.col("_p").alias("a"))
    edges = ends.join(now.withColumnRenamed("_p", "b"), ["py", "px", "label"]).select("a", "b")
    roots = connected_components(edges, scratch).select(F.col("node").alias("_p"), F.col("root.component").alias("_c"))
    # pixels without a neighbour have no link and are their own region
    return now.join(roots, "_p", "left").select("py", "px", "label", F.coalesce("_c", "_p.component").alias("component"))


def spatial_folds(labels: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """Adds component and fold: whole components go to a fold, so neighbours never part."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    found = components(labels)
    order = F.xxhash64(F.lit(seed), F.col("component")) if seed is not None else F.col("component")
    parts = found.select("component").distinct().withColumn("_o", order)
    dealt = kfold(parts, k, ["_o", "component"]).drop("_o")
    return found.join(dealt, "component")


def fold_scores(table: DataFrame, config: dict, k: int) -> tuple[float, float]:
    """Mean and population deviation of the accuracy over folds (column ``fold``).

    A fold whose rest has no rows to learn from, or that has none itself, is left out; NaN if all are.
    """
    import numpy as np

    scores = []
    for f in range(k):
        try:
            model = train(table.where(F.col("fold") != f), config)
        except TrainingDataError:
            continue
        held = table.where(F.col("fold") == f).withColumn("vector", array_to_vector("features"))
        row = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()
        if row[0] is not None:
            scores.append(row[0])
    return (float(np.mean(scores)), float(np.std(scores))) if scores else (float("nan"), float("nan"))


def diagnostics(table: DataFrame, config: dict, k: int = 3, seed: int | None = None) -> DataFrame:
    """variant, mean, std of the accuracy over k folds of a training table (py, px, label, features).

    The folds are dealt in three ways: in order (kfold), within each label (stratified) and
    by whole regions of a label (spatial), whose score does not gain from neighbours that are
    alike.  NaN where a variant has no fold to score.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "diagnostics")
    rows = scratch.keep(table, "table")
    pixels = rows.select("py", "px", "label").distinct()
    ways = {"kfold": lambda: kfold(rows, k, ["py", "px"]), "stratified": lambda: kfold(rows, k, ["py", "px"], "label"), "spatial": lambda: rows.join(spatial_folds(pixels, k, seed).select("py", "px", "label", "fold"), ["py", "px", "label"])}
    out = [(name, *fold_scores(scratch.keep(dealt(), name), config, k)) for name, dealt in ways.items()]  # written, as every fold reads it again
    return spark.createDataFrame(out, "variant string, mean double, std double")


def feature_names(names: list[str], n_bands: int) -> list[str]:
    """Names of the features of ``maps.class_features``: each coefficient of all bands, then each band's RMSE."""
    return [f"B{b}_{n}" for n in names for b in range(1, n_bands + 1)] + [f"B{b}_RMSE" for b in range(1, n_bands + 1)]


def importances(model: RandomForestClassificationModel, names: list[str] | None = None) -> DataFrame:
    """feature, importance (their sum is 1), the most important first; ValueError if the names are not one a feature."""
    values = model.featureImportances.toArray().tolist()
    names = list(names) if names is not None else [str(k) for k in range(len(values))]
    if len(names) != len(values):
        raise ValueError(f"{len(names)} names for {len(values)} features")
    rows = sorted(zip(names, values, strict=True), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")
