"""The queries of the corpus operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopix.llm import decontaminate, html_extract, langid, licenses, packing, quality_crf, quality_rules, simhash, toxicity, warc
from chronopix.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    kept = pages.select(F.struct("page_id", "url").alias("key"), "html")
    got = html_extract.extract(kept, "key")
    text = F.array_join("blocks", "\n\n")
    return got.select(F.col("id.page_id").alias("page_id"), F.col("id.url").alias("url"), text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path)
    return got.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    got = toxicity.score(documents, model)
    return got.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(fold("doc_id", 4) != 2))
    got = langid.identify(documents, model)
    return got.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "tiles", "longest")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality_crf.fit(documents, _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    got = quality_crf.score(documents, model)
    return got.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(_table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",")
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op9_quality_rules": quality_rules.oracle_sql()}
