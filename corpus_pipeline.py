"""The training-data pipeline: low quality out, near duplicates out, benchmark passages out,
personal data masked, documents packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, near_dup, packing, pii, quality
from cohortlens.llm.common import fresh, table
from cohortlens.llm.queries import quality_rows, tokenizer_file
from cohortlens.session import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; the model learns from the labelled ones of `docs`."""
    model = quality.fit(quality_rows(docs, spark, sf_dir))
    name = fresh(docs, "quality_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the passages of benchmark items cut out of their texts."""
    return recount(docs, decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it masked in their texts."""
    return recount(docs, pii.sanitise(docs))


def recount(before: DataFrame, after: DataFrame) -> DataFrame:
    """The number of characters follows the changed text, where the table has it."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces (with their ids) and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is a written table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
