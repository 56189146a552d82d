"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, then the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitloom.llm import decontam, lines, mixing, quality, simhash
from transitloom.session import store_and_reload


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.judged(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the boilerplate of their source; n_chars follows the text."""
    cleaned = lines.drop_boilerplate(docs)
    own = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return cleaned.select(*docs.columns).withColumns(own) if own else cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs, store_and_reload)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.taken(docs, store_and_reload)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

# The SimHash of near_dedup has no SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store_and_reload(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
