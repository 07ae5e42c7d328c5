"""From raw documents to packed token rows: clean, deduplicate, decontaminate, mix, pack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from trialmart.llm.decontaminate import remove_benchmark
from trialmart.llm.mixing import mixed_documents
from trialmart.llm.packing import packed_rows
from trialmart.llm.rules import keep_good
from trialmart.llm.scratch import saved, ship_package
from trialmart.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail; ``n_chars`` follows the text."""
    ship_package(spark)
    length = "n_chars" if "n_chars" in docs.columns else None
    return keep_good(docs, length_column=length)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    ship_package(spark)
    return remove_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of the queue."""
    ship_package(spark)
    return mixed_documents(docs)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    ship_package(spark)
    return packed_rows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_rows),
]

# Fingerprints, components and token ids are beyond SQL; a test runs the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written once and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *early, (_, last) = STAGES
    kept = reduce(lambda rows, stage: saved(stage[1](spark, rows, sf_dir)), early, docs)
    return last(spark, kept, sf_dir)
