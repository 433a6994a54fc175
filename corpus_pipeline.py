"""From raw documents to a training mix, in five stages.

Rejected documents go, boilerplate lines go, one document of each group of near
copies stays, documents that hold benchmark passages go, and sources are mixed to
their target weights. Each stage works on all that its predecessor kept. All but
the last return the columns of ``documents``; the last adds ``size``,
``source_size``, ``target`` and ``taken`` (the words the mix takes of the document,
repeats counted) and leaves out documents of which it takes none.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import classifier, decontaminate, lines, mixing, near, simhash
from gleaner.llm.storage import in_stages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text."""
    cleaned = lines.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles that agree to 0.8 or more."""
    return simhash.keep_one(docs, similarity=near.SIMILARITY)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, and how many."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing to target weights", mixture),
]

# The classifier's training and the fingerprints have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return in_stages(docs, [partial(_stage, spark, stage, sf_dir) for _, stage in STAGES])


def _stage(spark: SparkSession, stage, sf_dir: str, docs: DataFrame) -> DataFrame:
    return stage(spark, docs, sf_dir)
