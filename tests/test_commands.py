"""The command line, from raw rasters to maps."""

from __future__ import annotations

import argparse
from datetime import date, timedelta

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from chronopix import __main__ as cli

CONFIG = {
    "dataset": {"n_bands": 3, "mask_band": 3, "mask_values": [4], "min_values": 0, "max_values": [20000, 20000, 5]},
    "model": {"algorithm": "CCDC", "prediction": "lasso1", "design_matrix": "1 + x + harm(x, 1)"},
    "CCDC": {"init": {"threshold": 4.0, "min_rmse": 50.0, "screening_crit": 5000.0, "green_band": 0, "swir1_band": 1, "consecutive": 4}},
    "lasso1": {"type": "lasso20", "init": {"alpha": 1.0}},
    "classification": {"training_start": "2000-06-01", "training_end": "2001-06-01"},
}


@pytest.fixture(scope="module")
def stack(tmp_path_factory):
    """A catalogue and raw images of 2 x 2 pixels; column 0 changes at image 110."""
    root, r, lines = tmp_path_factory.mktemp("stack"), np.random.default_rng(5), ["date,sensor,filename"]
    for k in range(150):
        o = 729700 + 16 * k
        day = date.fromordinal(o)
        folder = root / f"LT5012031{day:%Y%j}"
        folder.mkdir()
        data = np.zeros((2, 2, 3), "<i2")
        wave = 500 * np.cos(2 * np.pi / 365.25 * o)
        for px in range(2):
            step = 4000 if px == 0 and k >= 110 else 0
            data[:, px, 0] = 3000 + 900 * px + wave + step + r.normal(size=2) * 40
            data[:, px, 1] = 5000 + wave + step + r.normal(size=2) * 40
        (folder / f"L{k}stack").write_bytes(data.tobytes())
        lines.append(f"{day:%Y%j},LT5,{folder}/L{k}stack")
    (root / "images.csv").write_text("\n".join(lines) + "\n")
    (root / "fewer.csv").write_text("\n".join(lines[:-10]) + "\n")
    for name in ("images", "fewer"):
        (root / f"{name}.yaml").write_text(yaml.safe_dump(CONFIG | {"dataset": CONFIG["dataset"] | {"input_file": f"{root}/{name}.csv"}}))
    return root


def test_commands_end_to_end(spark, stack):
    s, size = str(stack), ["--nrow", "2", "--ncol", "2"]
    cli.main(["catalog", s, f"{s}/listed"])
    assert spark.read.csv(f"{s}/listed", header=True).count() == 150
    cli.main(["cache", f"{s}/fewer.yaml", f"{s}/old", *size])
    cli.main(["cache", f"{s}/images.yaml", f"{s}/obs", *size, "--update", f"{s}/old"])
    cli.main(["cache", f"{s}/images.yaml", f"{s}/whole", *size])
    obs, whole = (spark.read.parquet(f"{s}/{n}") for n in ("obs", "whole"))
    assert spark.read.parquet(f"{s}/old").count() == 140 * 4 and obs.count() == 600
    assert sorted(obs.columns) == sorted(whole.columns) and obs.select(sorted(obs.columns)).exceptAll(whole.select(sorted(obs.columns))).isEmpty()
    for job in ("1", "2"):
        cli.main(["line", f"{s}/images.yaml", f"{s}/obs", f"{s}/result", "--job", job, "--jobs", "2"])
    cli.main(["pixel", f"{s}/images.yaml", f"{s}/obs", "0", "1", "--set", "threshold=5.0", "--curves", f"{s}/curves", "--observations", f"{s}/pixel"])
    assert spark.read.parquet(f"{s}/curves").count() > 1000
    assert spark.read.parquet(f"{s}/pixel").count() == 150 and set(spark.read.parquet(f"{s}/pixel").columns) == {"ordinal", "year", "doy", "season", "b1", "b2"}
    between = [(date.fromordinal(729700) + timedelta(days=d)).isoformat() for d in (1600, 1900)]
    cli.main(["changemap", "num", *between, f"{s}/result", f"{s}/obs", f"{s}/changes", "--ndv", "-1"])
    assert {(r["py"], r["px"]): r["n_changes"] for r in spark.read.parquet(f"{s}/changes").collect()} == {(0, 0): 1, (1, 0): 1, (0, 1): -1, (1, 1): -1}
    spark.range(4).select((F.col("id") % 2).cast("int").alias("py"), F.expr("int(id div 2)").alias("px"), F.expr("int(id div 2) + 1").alias("label")).write.parquet(f"{s}/labels")
    (stack / "forest.yaml").write_text(yaml.safe_dump({"algorithm": "RandomForest", "RandomForest": {"init": {"n_estimators": 5}}}))
    cli.main(["train", f"{s}/images.yaml", f"{s}/forest.yaml", f"{s}/labels", f"{s}/result", f"{s}/model", "--cache", f"{s}/rows", "--diagnose", f"{s}/report", "--folds", "2"])
    assert spark.read.parquet(f"{s}/report/scores").count() == 3 and spark.read.parquet(f"{s}/report/importances").where("feature = 'B2_RMSE'").count() == 1
    written = max(p.stat().st_mtime_ns for p in (stack / "rows").glob("*.parquet"))
    cli.main(["-q", "train", f"{s}/images.yaml", f"{s}/forest.yaml", f"{s}/labels", f"{s}/result", f"{s}/model", "--overwrite", "--cache", f"{s}/rows"])
    assert written == max(p.stat().st_mtime_ns for p in (stack / "rows").glob("*.parquet"))
    cli.main(["classify", f"{s}/model", f"{s}/result"])
    cli.main(["map", "class", "2000-12-01", f"{s}/result", f"{s}/obs", f"{s}/classes", "--format", "csv"])
    assert {r["Classification"] for r in spark.read.csv(f"{s}/classes", header=True).collect()} <= {"1", "2"}
    cli.main(["map", "predict", "2000-12-01", f"{s}/result", f"{s}/obs", f"{s}/predicted", "--bands", "2", "--qa"])
    assert {"Band_1", "SegmentQAQC"} <= set(spark.read.parquet(f"{s}/predicted").columns)
    (stack / "like.hdr").write_text("ENVI\nsamples = 2\nlines = 2\nbands = 1\ndata type = 4\ninterleave = bip\nmap info = {UTM, 1, 1, 500000, 4000000, 30, 30}\n")
    cli.main(["map", "class", "2000-12-01", f"{s}/result", f"{s}/obs", f"{s}/classes.img", "--format", "envi", "--like", f"{s}/like"])
    assert set(np.fromfile(f"{s}/classes.img", "<f4")) <= {1, 2} and "map info = {UTM" in (stack / "classes.img.hdr").read_text()


def test_an_archive_that_is_kept(spark, stack):
    s, size = str(stack), ["--nrow", "2", "--ncol", "2"]
    cli.main(["cache", f"{s}/fewer.yaml", f"{s}/kept", *size, "--keep"])
    before = sorted(p.name for p in (stack / "kept").rglob("*.parquet"))
    cli.main(["cache", f"{s}/fewer.yaml", f"{s}/kept", *size, "--keep"])
    assert before == sorted(p.name for p in (stack / "kept").rglob("*.parquet")) and spark.read.parquet(f"{s}/kept").count() == 140 * 4
    cli.main(["cache", f"{s}/images.yaml", f"{s}/kept", *size, "--keep"])
    assert spark.read.parquet(f"{s}/kept").count() == 600 and not (stack / "kept-old").exists()


def test_commands_of_other_packages(spark, monkeypatch):
    ran = []

    class Plugin:
        name = "more"

        @staticmethod
        def load():
            def add(commands):
                commands.add_parser("more").set_defaults(run=lambda spark, a: ran.append(a.command))

            return add

    class Broken(Plugin):
        name = "broken"

        @staticmethod
        def load():
            raise ImportError("no such module")

    monkeypatch.setattr(cli, "entry_points", lambda group: [Broken, Plugin])
    cli.main(["more"])
    assert ran == ["more"]
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_arguments_are_checked(spark):
    with pytest.raises(argparse.ArgumentTypeError):
        cli.positive("0")
    with pytest.raises(argparse.ArgumentTypeError):
        cli.setting("threshold")
    assert cli.setting("test=[1, 2]") == ("test", [1, 2]) and cli.band_list("1,3") == [1, 3] and cli.band_list("all") == "all"
    with pytest.raises(SystemExit):
        cli.main(["map", "nothing"])
    with pytest.raises(ValueError):
        cli.main(["line", "none.yaml", "none", "none", "--job", "3", "--jobs", "2"])
