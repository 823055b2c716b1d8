"""One query for each operator, over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, fill_in_middle, filter_audit, html_extraction, line_dedup, mixing, ngram_join, packing, quality, token_counts, topk_search, toxicity, url_filter

RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), entropy_share=0.95, repetition_limit=4.0)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.benchmark_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.drop("items")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("text").alias("text"), "n_lines", "n_removed")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), k=5, similarity=75)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES).drop("component")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(_table(spark, sf_dir, "pages"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_scores(_table(spark, sf_dir, "documents"), trusted)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"), seed=1)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_source_mixing": op1,
        "op2_token_counts": op2,
        "op3_topk_search": op3,
        "op4_toxicity": op4,
        "op5_decontamination": op5,
        "op6_line_dedup": op6,
        "op7_ngram_join": op7,
        "op8_url_filter": op8,
        "op9_html_extraction": op9,
        "op10_quality": op10,
        "op11_packing": op11,
        "op12_fill_in_middle": op12,
        "op13_filter_audit": op13,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
