import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from chronopix.llm import langid, quality_crf
from chronopix.llm.simhash import table_fingerprints
from test_simhash import brute_components


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_filters_keep_columns_and_what_their_models_keep(spark, sf, stages):
    before, after = stages["language"]
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not model.predict(r["text"])[2])
    before, after = stages["quality"]
    docs = spark.createDataFrame(before)
    model = quality_crf.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if model.score(r["text"]) >= 0.3)
    assert set(after[0].asDict()) == set(before[0].asDict())


def test_one_of_each_class_stays(stages):
    before, after = stages["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in sorted(before, key=lambda r: r["doc_id"])}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    # classes of any of three tables, by a join of each table's classes
    prints = {i: table_fingerprints(t, tables=3) for i, t in texts.items()}
    for t in range(3):
        for i, least in brute_components({i: p[t] for i, p in prints.items()}).items():
            a, b = sorted((find(i), find(least)))
            root[b] = a
    assert sorted(r["doc_id"] for r in after) == sorted({find(i) for i in texts}) and len(after) < len(before)


def test_test_items_go(spark, sf, stages):
    before, after = stages["decontamination"]
    split = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [split(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r["doc_id"] for r in before if any(f" {x} " in f" {split(r['text'])} " for x in items)}
    assert dirty and {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == dirty


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert len({(r["sequence_id"], r["offset"]) for r in after}) == len(after)


def test_odd_rows_go_through(spark, sf, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.count()
    assert corpus_pipeline.packed(spark, odd, sf).select(F.sum((F.col("piece") == 0).cast("int"))).first()[0] == 13
