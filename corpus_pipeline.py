"""From raw documents to packed sequences: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import langid, packing, pii, similar_text, toxicity
from lexigrain.llm.common import table
from lexigrain.llm.queries import vocabulary
from lexigrain.storage import delete, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return langid.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five words, similarity 0.8."""
    return similar_text.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: The classifiers and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:  # the stage after has its own copy
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
