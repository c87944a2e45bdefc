import math
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopix.config import expand, load, override, parse, without_keys
from chronopix.errors import UnknownAlgorithm
from chronopix.functions import columns as C
from chronopix.functions.formula import Design, select_bands, select_features, split_terms, without_categories
from chronopix.operators import changes, classify, incremental, maps, segmentation, windows
from chronopix.operators.prep import clear_observations, in_range
from chronopix.plans import jobs
from chronopix.sources import catalog, raster, results


def test_formula():
    d = Design("1 + x + harm(x, 1) + C(sensor, Treatment(reference='LT5'))", {"sensor": ["LE7", "LT5", "LC8"]}, columns=False)
    assert d.names == ["Intercept", "x", "harm(x, 1)[0]", "harm(x, 1)[1]", "C(sensor, Treatment(reference='LT5'))[T.LC8]", "C(sensor, Treatment(reference='LT5'))[T.LE7]"]
    m = d.matrix({"x": np.array([735688, 735689]), "sensor": np.array(["LT5", "LE7"])})
    w = 2 * np.pi / 365.25
    assert m[0, 2:] == pytest.approx([np.cos(w * 735688), np.sin(w * 735688), 0, 0]) and m[1, 5] == 1
    assert without_categories("1 + x + C(a) + harm(x, 2)") == "1 + x + harm(x, 2)" and len(split_terms("1 + harm(x, 1) - 1")) == 3
    assert select_features(d.names, "seasonality") == [2, 3] and select_features(d.names, "categorical") == [4, 5] and select_features(["intercept", "X"], "slope") == [1]
    assert select_bands("all", 3) == [0, 1, 2] and select_bands([1, 3], 3) == [0, 2]
    for bad in ([4], [0]):
        with pytest.raises(KeyError):
            select_bands(bad, 3)
    with pytest.raises(ValueError):
        Design("1 + nope(x, 1)", columns=False)
    with pytest.raises(KeyError):
        select_features(d.names, "nope")


def test_columns(spark):
    row = spark.range(1).select(
        C.to_ordinal(F.to_date(F.lit("2000-01-01"))).alias("o"), C.format_ordinal(F.lit(730120)).alias("f"), C.parse_ordinal(F.lit("2000001")).alias("p"), C.parse_ordinal(F.lit("x")).alias("n"),
        C.is_integer(F.lit("12")).alias("i"), C.is_integer(F.lit("1.5")).alias("j"), C.is_integer(F.lit(None).cast("string")).alias("k"), C.halfmax(F.array(*map(F.lit, (0.0, 4.0, 6.0, 10.0)))).alias("h"),
        C.parent_folder(F.lit("/a/LT5x/s.img")).alias("d"), C.season(F.lit(730120)).alias("s"), C.argmax(F.array(*map(F.lit, (1.0, 9.0, 9.0)))).alias("m"),
    ).first()
    assert tuple(row) == (730120, 2000001, 730120, None, True, False, False, 1, "LT5x", "winter", 1)
    assert C.spark_pattern("%Y%j") == "yyyyDDD" and C.amplitude_name("harm(x, 2)[0]") == "amplitude(x, 2)" and C.amplitude_name("x") is None
    with pytest.raises(ValueError):
        C.spark_pattern("%Q")


def test_halfmax_takes_time_in_step_with_the_array(spark):
    # the ends were computed again for every element: half a minute for this one
    start = time.perf_counter()
    rows = spark.createDataFrame([([float(v) for v in range(12001)],), ([1.0, math.nan, None, 3.0, 9.0],), ([2.0, 2.0],), ([],), (None,)], "v array<double>")
    assert [r["h"] for r in rows.select(C.halfmax(F.col("v")).alias("h")).collect()] == [6000, 3, None, None, None]
    assert time.perf_counter() - start < 10


def test_partitions_of_pixels_grow_with_the_files(spark, sf, monkeypatch):
    from chronopix.operators import prep

    obs = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("int(l_suppkey) AS py", "0 AS px")
    size = Path(f"{sf}/lineitem.parquet").stat().st_size
    assert prep.source_bytes(obs) == size and prep.source_bytes(spark.createDataFrame([(0, 0)], "py int, px int")) == 0
    assert prep.by_pixel(obs).rdd.getNumPartitions() == 4
    monkeypatch.setattr(prep, "PARTITION_BYTES", size // 20)
    assert prep.by_pixel(obs).rdd.getNumPartitions() in (20, 21) and prep.by_pixel(obs, 3).rdd.getNumPartitions() == 3


SEGMENTS = [  # py, px, seg_id, start, end, break, coef (2 features x 1 band), rmse, magnitude
    (0, 0, 0, 10, 20, 25, [[1.0], [2.0]], [0.5], [3.0]), (0, 0, 1, 25, 40, 50, [[3.0], [0.0]], [0.6], [4.0]), (0, 0, 2, 50, 60, 0, [[5.0], [0.0]], [0.7], [0.0]),
    (0, 1, 0, 10, 30, 0, [[7.0], [1.0]], [0.1], [0.0]), (1, 0, 0, 45, 60, 0, [[9.0], [0.0]], [0.2], [0.0]), (1, 1, 0, 1, 9, 12, [[1.0], [0.0]], [0.2], [1.0]),
]


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(SEGMENTS, segmentation.BASE_SCHEMA)


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(a, b) for a in range(2) for b in range(3)], "py int, px int")


def by_pixel(df, *columns):
    return {(r["py"], r["px"]): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_segment_at_a_date(segments):
    got = by_pixel(maps.at_date(segments, 35, after=True, before=True), "seg_id", "qa")
    assert got == {(0, 0): (1, 3), (0, 1): (0, 1), (1, 0): (0, 2)}
    assert by_pixel(maps.at_date(segments, 5, after=True), "seg_id", "qa") == {(0, 0): (0, 2), (0, 1): (0, 2), (1, 0): (0, 2), (1, 1): (0, 3)}
    assert maps.at_date(segments, 1000).count() == 0


def test_maps(segments, grid):
    got = by_pixel(maps.coefficient_map(segments, grid, 15, ["Intercept", "x"], 1), "B1_Intercept", "B1_x", "SegmentQAQC")
    assert got[0, 0] == (1 + 2 * 15, 2.0, 3) and got[0, 1] == (7 + 20, 1.0, 3) and got[1, 2] == (-9999.0, -9999.0, 0)
    assert by_pixel(maps.prediction_map(segments, grid, 15, "1 + x", 1), "Band_0") == {(0, 0): 31, (0, 1): 22, (0, 2): -9999, (1, 0): -9999, (1, 1): -9999, (1, 2): -9999}
    big = segments.withColumn("coef", F.expr("array(array(40000f), array(0f))"))
    assert by_pixel(maps.prediction_map(big, grid, 15, "1 + x", 1), "Band_0")[0, 0] == -9999
    with pytest.raises(ValueError):
        maps.class_map(segments, grid, 15)
    with pytest.raises(ValueError):
        maps.phenology_map(segments, grid, 15)


def test_change_maps(segments, grid):
    first = changes.change_date_map(segments, grid, 12, 50, first=True, out_format="ordinal", magnitude=[0])
    assert by_pixel(first, "change", "MagnitudeIndex0") == {(0, 0): (25, 3.0), (0, 1): (-9999, -9999.0), (0, 2): (-9999, -9999.0), (1, 0): (-9999, -9999.0), (1, 1): (12, 1.0), (1, 2): (-9999, -9999.0)}
    assert by_pixel(changes.change_date_map(segments, grid, 12, 50, out_format="ordinal"), "change")[0, 0] == 50
    assert by_pixel(changes.change_count_map(segments, grid, 12, 50), "n_changes")[0, 0] == 2
    assert changes.magnitude_bands(segments, 1) == [0] and changes.magnitude_bands(segments, 1, [5]) == [5]
    with pytest.raises(KeyError):
        changes.magnitude_bands(segments.drop("magnitude"), 1)


def test_training_table(spark, segments):
    labels = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (1, 0, 3), (1, 1, 0)], "py int, px int, label int")
    got = by_pixel(classify.training_table(labels, segments, 12, 18, [0]), "label", "features")
    assert {k: v[0] for k, v in got.items()} == {(0, 0): 2, (0, 1): 1} and list(got[0, 0][1]) == pytest.approx([31, 2, 0.5])
    double = segments.unionByName(segments.withColumn("seg_id", F.col("seg_id") + 10))
    with pytest.raises(Exception, match="more than one segment"):
        classify.training_table(labels, double, 12, 18, [0]).collect()


def test_classifier_configuration():
    c = classify.classifier({"algorithm": "RandomForest", "RandomForest": {"init": {"n_estimators": 7, "max_depth": None, "n_jobs": -1}}})
    assert c.getNumTrees() == 7 and c.getMaxDepth() == 30
    with pytest.raises(UnknownAlgorithm):
        classify.classifier({"algorithm": "Boost"})
    with pytest.raises(TypeError):
        classify.classifier({"algorithm": "RandomForest", "RandomForest": {"init": {"trees": 7}}})


def test_classifier_tells_what_it_cannot_honour(spark):
    import warnings

    forest = lambda **init: classify.classifier({"algorithm": "RandomForest", "RandomForest": {"init": init}})
    for init in ({"min_samples_split": 10}, {"max_leaf_nodes": 5}, {"oob_score": True}, {"warm_start": True}, {"max_depth": 40}):
        with pytest.warns(UserWarning, match=next(iter(init))):
            assert forest(**init).getMaxDepth() == 30
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert forest(min_samples_split=2, oob_score=False, max_leaf_nodes=None, n_jobs=-1).getMaxDepth() == 30 and forest(max_depth=6).getMaxDepth() == 6


def test_spatial_folds_keep_patches_together(spark):
    image = ["110022", "100002", "003300", "303000"]
    rows = [(y, x, int(v)) for y, line in enumerate(image) for x, v in enumerate(line)]
    got = classify.spatial_folds(spark.createDataFrame(rows, "py int, px int, label int"), 2).collect()
    patches = {}
    for r in got:
        patches.setdefault(r["component"], set()).add((r["py"], r["px"]))
    assert sorted(map(len, patches.values())) == [1, 3, 3, 3]
    assert all(len({r["fold"] for r in got if r["component"] == c}) == 1 for c in patches) and {r["fold"] for r in got} == {0, 1}
    with pytest.raises(ValueError):
        classify.spatial_folds(spark.createDataFrame(rows, "py int, px int, label int"), 1)


def test_regions_of_any_length_stay_whole(spark):
    # a strip of 150 pixels, a winding path of 419 in 20 x 40, and one pixel that no other of its label touches
    path = [(y, x) for y in range(2, 42) for x in (range(20) if y % 2 == 0 else [19 if y % 4 == 3 else 0])][:419]
    rows = [(0, x, 1) for x in range(150)] + [(y, x, 2) for y, x in path] + [(100, 100, 1), (100, 101, 3), (0, 150, 0)]
    labels = spark.createDataFrame(rows, "py int, px int, label int")
    got = classify.components(labels).collect()
    assert {(r["py"], r["px"], r["label"]) for r in got} == {r for r in rows if r[2]} and len(got) == len(rows) - 1
    wanted = {(0, 1): 0, (2, 2): 2 << 20, (100, 1): (100 << 20) + 100, (100, 3): (100 << 20) + 101}
    assert all(r["component"] == wanted[min(r["py"], 2) if r["py"] < 100 else 100, r["label"]] for r in got)
    folds = classify.spatial_folds(labels, 3).collect()
    assert len(folds) == len(got) and len({(r["component"], r["fold"]) for r in folds}) == 4


def test_result_with_an_unreadable_file_is_not_rewritten(spark, tmp_path, monkeypatch):
    from chronopix.plans import jobs
    from chronopix.sources import results

    rows = spark.createDataFrame([(0, 0, 0, 5), (100, 0, 0, 6)], "py int, px int, seg_id int, start int")
    results.write_segments(rows, str(tmp_path), {"design": {"x": 1}})
    bad = next((tmp_path / "segments/py_bucket=1").glob("*.parquet"))
    bad.write_bytes(b"PAR1" + bytes(200) + b"PAR1")
    bad.with_name(f".{bad.name}.crc").unlink()
    monkeypatch.setattr(jobs.classify, "classify", lambda segments, model, slope: segments.selectExpr("*", "1 AS class"))
    with pytest.raises(Exception, match="(?i)parquet"):
        jobs.classify_result(spark, str(tmp_path), None)
    assert bad.exists() and results.read_segments(spark, str(tmp_path), skip_corrupt=True).count() == 1
    with pytest.raises(Exception, match="(?i)parquet"):
        results.read_segments(spark, str(tmp_path)).count()


def test_a_broken_off_replacement_is_recovered(spark, tmp_path):
    from chronopix.sources import results

    rows = spark.createDataFrame([(0, 0, 0, 5), (100, 0, 0, 6)], "py int, px int, seg_id int, start int")
    results.write_segments(rows, str(tmp_path), {"design": {"x": 1}})
    results.replace_segments(results.read_segments(spark, str(tmp_path)).withColumn("class", F.lit(1)), str(tmp_path))
    assert results.read_segments(spark, str(tmp_path)).where("class = 1").count() == 2
    assert not (tmp_path / "segments-old").exists() and not (tmp_path / "segments-new").exists()
    (tmp_path / "segments").rename(tmp_path / "segments-old")
    assert results.read_segments(spark, str(tmp_path)).count() == 2 and results.finished_rows(spark, str(tmp_path)).count() == 2


def test_predicates_and_jobs(spark):
    df = spark.createDataFrame([(0, 0, 1, 5, 0), (0, 1, 1, 50, 0), (0, 2, 1, 5, 4)], "py int, px int, ordinal int, b1 int, m int")
    assert clear_observations(df, ["b1"], 0, 10, "m", [4]).columns == ["py", "px", "ordinal", "b1"]
    assert clear_observations(df, ["b1"], 0, 10, "m", [4]).count() == 1 and clear_observations(df, ["b1"], None, 10).count() == 3
    with pytest.raises(ValueError):
        in_range(["b1"], [0, 1], [2, 3])
    for total, n in ((93, 13), (70, 1), (9, 9), (3, 5)):
        runs = [[r["py"] for r in windows.job_rows(spark.range(total).select(F.col("id").cast("int").alias("py")), k, n, total=total).collect()] for k in range(n)]
        assert [k for r in runs for k in sorted(r)] == list(range(total)) and max(map(len, runs)) - min(map(len, runs)) <= 1
    lines = spark.range(100).select(F.col("id").cast("int").alias("py"))
    assert sum(windows.job_rows(lines, k, 7).count() for k in range(7)) == 100
    with pytest.raises(ValueError):
        windows.job_rows(lines, 7, 7)


def test_scaling_and_periods(spark):
    rows = [(0, 0, 0, k, float(v)) for k, v in enumerate(np.linspace(0, 1, 11))]
    got = windows.scale_by_period(spark.createDataFrame(rows, "py int, px int, period int, k int, v double"), "v").collect()
    assert sorted(r["scaled"] for r in got) == pytest.approx(((np.linspace(0, 1, 11) - 0.1) / 0.8).tolist())
    years = spark.createDataFrame([(0, 0, y) for y in range(1984, 1994)], "py int, px int, year int")
    assert [r["period"] for r in windows.group_years(years).orderBy("year").collect()] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_incremental(spark):
    old, want = spark.createDataFrame([(i,) for i in "abc"], "image_id string"), spark.createDataFrame([(i,) for i in "bcd"], "image_id string")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(incremental.retained(old, want)) == ["b", "c"] and ids(incremental.missing(want, old)) == ["d"]
    assert ids(incremental.update(old, want, want)) == ["b", "c", "d"] and not incremental.same_images(old, want) and incremental.same_images(old, old)
    with pytest.raises(ValueError):
        incremental.update(old, want.where("image_id = 'z'"), want)


def test_catalogue_files(spark, tmp_path):
    for name in ("LT50350321984001xx", "LE70350322000032xx"):
        (tmp_path / "stack" / name).mkdir(parents=True)
        (tmp_path / "stack" / name / f"{name}_stack").write_bytes(b"x")
    found = catalog.find_images(spark, f"file://{tmp_path}/stack")
    assert [(r["ordinal"], r["image_id"][:3]) for r in found.collect()] == [(724276, "LT5"), (730151, "LE7")]
    catalog.write_catalog(found, f"file://{tmp_path}/csv")
    back = catalog.read_catalog(spark, f"file://{tmp_path}/csv").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in back] == [724276, 730151] and back[0]["image_id"] == "LT50350321984001xx" and back[0]["sensor"] == "LT5"
    (tmp_path / "no.csv").write_text("a,b\n1,2\n")
    with pytest.raises(KeyError):
        catalog.read_catalog(spark, f"file://{tmp_path}/no.csv")


def test_rasters(spark, tmp_path):
    data = np.random.default_rng(1).integers(-5, 3000, (5, 4, 3)).astype("int16")
    data.tofile(tmp_path / "a.bip")
    df = raster.read_bip(spark, [str(tmp_path / "a.bip")], 5, 4, 3)
    assert df.count() == 20 and all(data[r["py"], r["px"]].tolist() == [r["b1"], r["b2"], r["b3"]] for r in df.collect())
    part = raster.read_bip(spark, [str(tmp_path / "a.bip")], 5, 4, 3, bands=[2], rows=(1, 3))
    assert part.columns == ["filename", "py", "px", "b2"] and {r["py"] for r in part.collect()} == {1, 2}
    with pytest.raises(OSError):
        raster.read_bip(spark, [], 5, 4, 3, bands=[4])
    cat = spark.createDataFrame([(str(tmp_path / "a.bip"), 730120)], "filename string, ordinal int")
    raster.ingest(df, cat, f"{tmp_path}/obs", 2)
    assert raster.read_line(spark, f"{tmp_path}/obs", 3, 2).count() == 4 and raster.read_pixel(spark, f"{tmp_path}/obs", 2, 3, 2).first()["b1"] == data[3, 2, 0]
    assert raster.attributes(df)[:2] == (5, 4) and (raster.to_array(df, "b2", 5, 4, -1) == data[:, :, 1]).all()


@pytest.mark.parametrize("interleave", ["bip", "bil", "bsq"])
def test_rasters_with_headers(spark, tmp_path, interleave, monkeypatch):
    data = np.random.default_rng(2).integers(0, 60000, (7, 4, 3)).astype(">u2")
    order = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}[interleave]
    (tmp_path / "a.img").write_bytes(b"head" + np.ascontiguousarray(data.transpose(order)).tobytes())
    (tmp_path / "a.hdr").write_text(f"ENVI\nsamples = 4\nlines=7\nbands = 3\nheader offset = 4\ndata type = 12\ninterleave = {interleave.upper()}\nbyte order = 1\nband names = {{red,\n nir, swir}}\n")
    assert raster.read_header(f"{tmp_path}/a.img")["names"] == ["red", "nir", "swir"]
    for path in (f"{tmp_path}/a.img", f"file://{tmp_path}/a.img", f"file:{tmp_path}/a.img"):
        got = raster.read_envi(spark, [path]).collect()
        assert len(got) == 28 and all(data[r["py"], r["px"]].tolist() == [r["b1"], r["b2"], r["b3"]] for r in got)
    part = raster.read_envi(spark, [f"{tmp_path}/a.img"], [3], (2, 4)).collect()
    assert sorted((r["py"], r["px"], r["b3"]) for r in part) == [(y, x, data[y, x, 2]) for y in (2, 3) for x in range(4)]
    monkeypatch.setattr(raster, "_HELD", 1)  # one row of pixels after the other
    options = {"nrow": 7, "ncol": 4, "nband": 3, "dtype": "uint16", "order": ">", "offset": 4, "interleave": interleave}
    runs = list(raster._Reader(options, raster.read_envi(spark, [f"{tmp_path}/a.img"]).schema).read(raster._Rows(f"{tmp_path}/a.img", 1, 6)))
    assert [b.num_rows for b in runs] == [4] * 5 and runs[0]["b2"].to_pylist() == data[1, :, 1].tolist()


def test_headers_that_do_not_fit(spark, tmp_path):
    for name, lines in (("a", 2), ("b", 3)):
        (tmp_path / name).write_bytes(bytes(2 * lines))
        (tmp_path / f"{name}.hdr").write_text(f"ENVI\nsamples = 2\nlines = {lines}\nbands = 1\ndata type = 1\ninterleave = bip\n")
    assert raster.read_envi(spark, [f"{tmp_path}/a"]).count() == 4
    with pytest.raises(Exception, match="is not of 2 rows"):
        raster.read_envi(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()
    (tmp_path / "c").write_bytes(b"")
    with pytest.raises(OSError):
        raster.read_header(f"{tmp_path}/c")
    (tmp_path / "c.hdr").write_text("ENVI\nsamples = 2\nlines = 1\nbands = 1\ndata type = 99\ninterleave = bip\n")
    with pytest.raises(OSError):
        raster.read_header(f"{tmp_path}/c")
    with pytest.raises(OSError):
        raster.read_envi(spark, [])


def test_maps_as_rasters(spark, tmp_path):
    rows = [(0, 1, 5.5, None), (3, 0, float("nan"), 7), (3, 2, -1.0, 8), (9, 0, 1.0, 1), (-1, 0, 1.0, 1), (1, 3, 1.0, 1)]
    values = spark.createDataFrame(rows, "py int, px int, a double, b int")
    path = f"{tmp_path}/map"
    raster.write_raster(values, path, ["a", "b"], 5, 3, -9999, names=["A, first", "B"], georeference={"map info": "UTM, 1, 1"})
    h = raster.read_header(path)
    assert h["names"] == ["A; first", "B"] and h["ndv"] == -9999 and h["georeference"] == {"map info": "UTM, 1, 1"} and (h["nrow"], h["ncol"]) == (5, 3)
    expected = np.full((5, 3, 2), -9999, "<f4")
    expected[0, 1, 0], expected[3, 0, 1], expected[3, 2] = 5.5, 7, (-1, 8)
    assert (np.fromfile(path, "<f4").reshape(5, 3, 2) == expected).all()
    assert {(r["py"], r["px"]): r["b2"] for r in raster.read_envi(spark, [path]).collect()}[3, 2] == 8
    raster.write_raster(values.where("a > 100"), f"{tmp_path}/none", ["a"], 2, 2, 0, "int16")
    assert (np.fromfile(f"{tmp_path}/none", "<i2") == np.zeros(4)).all()
    with pytest.raises(ValueError):
        raster.write_raster(values, path, ["a", "b"], 5, 3, -9999, names=["A"])


def test_archive_is_read_through(spark, tmp_path):
    path, asked = f"{tmp_path}/obs", []
    images = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "image_id string, ordinal int")

    def source(wanted):
        asked.append(sorted(r["image_id"] for r in wanted.collect()))
        return wanted.crossJoin(spark.range(2).selectExpr("cast(id as int) as py", "0 as px")).withColumn("b1", F.col("ordinal") * 10)

    for wanted, new in (("a b", ["a", "b"]), ("a b", None), ("b c", ["c"]), ("b", [])):
        asked.clear()
        found = raster.read_through(spark, images.where(F.col("image_id").isin(*wanted.split())), source, path)
        assert sorted((r["image_id"], r["py"]) for r in found.collect()) == [(i, y) for i in wanted.split() for y in (0, 1)]
        assert asked == ([new] if new else [])
    with pytest.raises(ValueError):
        raster.read_through(spark, images.limit(0), source, path)


def test_access_and_times(spark, tmp_path):
    from chronopix.sources import files

    assert files.access(spark, f"{tmp_path}/new") == (True, True) and not list((tmp_path / "new").iterdir())
    (tmp_path / "file").write_text("x")
    assert files.access(spark, f"{tmp_path}/file/below")[1] is False
    assert files.modified(spark, f"{tmp_path}/none") is None and files.modified(spark, f"{tmp_path}/new") is None and files.modified(spark, f"{tmp_path}/file") > 0


def test_classes_are_added_to_what_a_resumed_job_appended(spark, tmp_path, monkeypatch):
    from chronopix.sources import results

    seen = []

    def classed(segments, model, slope):
        seen.append(sorted(r["py"] for r in segments.collect()))
        return segments.drop("class", "class_proba").selectExpr("*", "7 AS class", "array(float(1)) AS class_proba")

    monkeypatch.setattr(jobs.classify, "classify", classed)
    rows = lambda *py: spark.createDataFrame([(y, 0, 0, 5) for y in py], "py int, px int, seg_id int, start int")
    results.write_segments(rows(0, 1), str(tmp_path), {"design": {"x": 1}})
    jobs.classify_result(spark, str(tmp_path), None)
    jobs.classify_result(spark, str(tmp_path), None, resume=True)  # nothing is left to do
    results.write_segments(rows(2, 70), str(tmp_path), {"design": {"x": 1}}, mode="append")
    jobs.classify_result(spark, str(tmp_path), None, resume=True)
    assert seen == [[0, 1], [2, 70]] and results.read_segments(spark, str(tmp_path)).where("class = 7").count() == 4


CONFIG = {
    "dataset": {"n_bands": 3, "mask_band": 3, "mask_values": [4], "min_values": 0, "max_values": [20000, 20000, 5]},
    "model": {"algorithm": "CCDC", "prediction": "lasso1", "design_matrix": "1 + x + harm(x, 1)", "commission_alpha": 0.01, "refit": {"prefix": ["ols"], "prediction": ["ols"]}},
    "CCDC": {"init": {"threshold": 4.0, "min_rmse": 50.0, "screening_crit": 5000.0, "green_band": 0, "swir1_band": 1, "consecutive": 4}},
    "lasso1": {"type": "lasso20", "init": {"alpha": 1.0}},
    "classification": {"training_start": "2000-06-01", "training_end": "2001-06-01", "roi_mask_values": [0]},
}


def test_configuration(tmp_path, monkeypatch):
    c = parse(CONFIG)
    assert c.dataset.min_values == [0, 0, 0] and c.estimator.alpha == 1.0 and c.refits[0].stay_regularized is True and jobs.bands_of(c) == (["b1", "b2"], "b3")
    monkeypatch.setenv("ROOT_X", "/r")
    assert expand({"a": ["$ROOT_X/b", {"c": "$UNSET_X"}]}) == {"a": ["/r/b", {"c": "$UNSET_X"}]}
    assert without_keys({"a": 1, "b": {"a": 2, "c": 3}}, "a") == {"b": {"c": 3}} and override({"a": 1, "b": {"a": 2}}, {"a": 9}) == {"a": 9, "b": {"a": 9}}
    import yaml

    (tmp_path / "c.yaml").write_text(yaml.safe_dump(CONFIG))
    assert load(tmp_path / "c.yaml").algorithm == "CCDC"
    for broken in ({"dataset": {}}, {**CONFIG, "CCDC": None}, {**CONFIG, "model": {"algorithm": "CCDC"}}, {**CONFIG, "lasso1": {}}, {**CONFIG, "model": {**CONFIG["model"], "refit": {"prefix": ["a"], "prediction": []}}}):
        with pytest.raises(KeyError):
            parse(broken)
    with pytest.raises(ValueError):
        parse({**CONFIG, "dataset": {**CONFIG["dataset"], "max_values": [1]}})


def test_jobs_end_to_end(spark, tmp_path):
    r, rows = np.random.default_rng(5), []
    for py in range(2):
        for px in range(3):
            for k in range(160):
                o = 729700 + 16 * k
                step = 4000 if px == 0 and k >= 110 else 0
                s = 500 * np.cos(2 * np.pi / 365.25 * o)
                rows.append((py, px, o, int(3000 + 900 * px + s + step + r.normal() * 40), int(5000 + s + step + r.normal() * 40), 4 if k % 29 == 7 else 0))
    obs = spark.createDataFrame(rows, "py int, px int, ordinal int, b1 int, b2 int, b3 int")
    c, path = parse(CONFIG), f"{tmp_path}/result"
    jobs.line(spark, obs, c, path, 0, 2)
    assert {r[0] for r in results.finished_rows(spark, path).collect()} == {0}
    jobs.line(spark, obs, c, path, resume=True)
    found = results.read_segments(spark, path)
    n = by_pixel(found.groupBy("py", "px").count(), "count")
    assert n == {(py, px): 2 if px == 0 else 1 for py in range(2) for px in range(3)}
    grid = obs.select("py", "px").distinct()
    change = by_pixel(jobs.change_map(spark, "first", "2003-01-01", "2007-01-01", path, grid, out_format="ordinal", magnitude=True), "change")
    assert all(abs(v - (729700 + 16 * 110)) <= 16 if k[1] == 0 else v == -9999 for k, v in change.items())
    assert by_pixel(jobs.change_map(spark, "num", "2003-01-01", "2007-01-01", path, grid), "n_changes")[1, 0] == 1
    predicted = by_pixel(jobs.map_at(spark, "predict", "2000-07-01", path, grid, after=True, before=True), "Band_1")
    assert all(4000 < v < 6500 for v in predicted.values())
    assert "B1_x" in jobs.map_at(spark, "coef", "2000-07-01", path, grid, prefix="ols").columns
    one, curves = jobs.pixel(obs, c, 0, 1)
    assert one.count() == 1 and 0 < curves.count() == one.selectExpr("end - start").first()[0]
    labels = spark.createDataFrame([(py, px, px + 1) for py in range(2) for px in range(3)], "py int, px int, label int")
    model = jobs.train(labels, found, c, {"algorithm": "RandomForest", "RandomForest": {"init": {"n_estimators": 5}}}, path=f"{tmp_path}/model")
    with pytest.raises(Exception, match="exist"):
        model.write().save(f"{tmp_path}/model")
    jobs.classify_result(spark, path, model)
    classes = by_pixel(jobs.map_at(spark, "class", "2000-12-01", path, grid, proba=True), "Classification")
    assert sum(v == k[1] + 1 for k, v in classes.items()) >= 5
    with pytest.raises(ValueError):
        jobs.map_at(spark, "nope", "2000-07-01", path, grid)


def test_segments_do_not_depend_on_partitions(spark, sf):
    from chronopix.plans import adapters as A
    from chronopix.plans import queries as Q

    rows = Q._daily(spark, sf, ("b0", "b1"))
    a, b = (sorted(segmentation.segment_pixels(rows, ["b0", "b1"], Q.FORMULA, Q.PARAMETERS, centre=A.CENTRE, levels={}, partitions=n).collect()) for n in (1, 7))
    assert a == b and a


def test_components_of_a_long_winding_region_settle_in_few_rounds(spark):
    from chronopix.operators import classify, components

    # a serpentine of over 1000 pixels: rows joined at alternating ends
    cells = [(y, x) for y in range(0, 60, 2) for x in range(33)] + [(y, 32 if y % 4 == 1 else 0) for y in range(1, 59, 2)]
    labels = spark.createDataFrame([(y, x, 1) for y, x in cells] + [(70, 70, 1), (70, 71, 2)], "py int, px int, label int")
    rounds, settled = [], components._settled
    components._settled = lambda df: rounds.append(1) or settled(df)
    try:
        found = {(r["py"], r["px"]): r["component"] for r in classify.components(labels).collect()}
    finally:
        components._settled = settled
    assert len(cells) > 1000 and {found[c] for c in cells} == {0} and len(set(found.values())) == 3 and len(rounds) < 20


def test_very_many_edges_do_not_overflow(spark):
    from pyspark.sql import functions as F

    from chronopix.operators import components

    star = spark.range(1, 20_000_000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert components._settled(star)
    edges = lambda *e: spark.createDataFrame(e, "a long, b long")
    assert components._settled(edges((2, 1), (3, 1), (9, 4))) and not components._settled(edges((2, 1), (3, 2))) and not components._settled(edges((3, 1), (3, 2)))


def test_frequent_keys_are_joined_in_parts(spark):
    from pyspark.sql import functions as F

    from chronopix.operators.components import join_spread

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r["id"]: r["v"] for r in join_spread(rows, table, "k", "id").collect()}
    assert got == {i: 2 * (0 if i % 3 == 0 else i) for i in range(5000) if i % 3 == 0 or i % 2 == 0}
