"""Readers and writers: JSONL, Parquet, CSV, word lists, lexicons, mapped inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "source", "domain", "title", "abstract", "published", "updated", "url")] + [T.StructField("categories", T.ArrayType(T.StringType()))])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; a missing file is empty, bad JSON fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema)
    raise ValueError(f"neither .parquet nor .jsonl: {path}")


def read_many(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with different columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_mapped(spark: SparkSession, mapping: dict[str, str], schema: T.StructType = RAW) -> DataFrame:
    """path to domain: the label is added only to files without one."""
    parts = []
    for path, domain in mapping.items():
        f = read_corpus(spark, path, schema)
        parts.append(f.withColumn("domain", F.coalesce("domain", F.lit(domain)) if "domain" in f.columns else F.lit(domain)))
    return read_many(parts)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, lower-cased; lines from # on are comments."""
    return spark.read.text(path).select(F.trim(F.lower(F.regexp_replace("value", "#.*", ""))).alias("word")).where("word <> ''").distinct()


def read_term_stats(spark: SparkSession, path: str) -> DataFrame:
    """Term statistics from CSV: z falls back to log_odds, bad numbers to 0."""
    raw = spark.read.option("header", True).csv(path)
    for c in ("z", "log_odds", "delta", "ngram_len"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    num = lambda c: F.expr(f"try_cast({c} as double)")
    return raw.select("domain", "term", F.coalesce(num("z"), num("log_odds"), F.lit(0.0)).alias("z"), F.coalesce(num("delta"), F.lit(0.0)).alias("delta"), F.coalesce(F.expr("try_cast(ngram_len as int)"), F.size(F.split("term", " "))).alias("ngram_len"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("domain").parquet(path)


def write_term_stats(df: DataFrame, path: str) -> None:
    df.orderBy("domain", F.desc("log_odds"), "term").write.mode("overwrite").option("header", True).csv(path)
