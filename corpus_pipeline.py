"""A corpus pipeline of five stages, each calling one operator on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termforge.llm import decontamination, line_dedup, mixing, ngram_join, toxicity
from termforge.llm.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-duplicates of lines go; a document that loses all its lines goes with them."""
    out = line_dedup.dedup_lines(docs)
    left = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return ngram_join.keep_one_of_each(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=10).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents in proportion to the tempered weights, with epoch and block."""
    return mixing.mix_sources(docs, entropy_share=0.95, repetition_limit=4.0, keep=("text", "lang"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: The models and the bisection have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
