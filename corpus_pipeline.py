"""The corpus pipeline: from documents to packed training sequences.

Five stages, each one of the operators of ``chronopix.llm``; ``run`` applies them
to a documents table, writing every stage's result as Parquet in the shared
folder and reading it again as the next one's input.

Every filtering stage returns the columns it was given, whatever they are named
or hold; long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopix.llm import decontaminate, langid, packing, quality_crf, simhash
from chronopix.llm.common import Scratch
from chronopix.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject.

    Null texts and texts without a letter go; so does every text if none with a language could be learnt from.
    Rows that repeat are judged alike.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain does not reject.

    A null text is judged as an empty line; without labels of both kinds all rows get one score.  Rows that repeat are judged alike.
    """
    return quality_crf.keep_good(docs, quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class.

    The smallest id stays (rows without one come last), of rows that repeat one; null and wordless texts are one class.
    Rows that share an id with different texts go by their own text.
    """
    return simhash.keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay; rows that repeat are judged alike; items that are null or empty match nothing.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their place in sequences of 1024 tokens.

    A null text is an empty one and gives the end token; rows that repeat are packed each by itself.
    """
    got = packing.pack(docs, tokenizer_path)
    return got.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Models, fingerprints and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
