"""An evaluation log of the driver's tables: four events make a case with four candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluation import CANDIDATE


def evaluation_log(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    i = F.col("event_id")
    mod = lambda a, m: (i * a) % m
    rows = e.select(
        F.expr("event_id div 4").alias("case_id"),
        (i % 4).cast("int").alias("cand"),
        (F.col("user_id") % 4).alias("src"),
        (F.col("user_id") % 3).alias("tgt"),
        "event_type",
        F.struct(
            F.concat_ws(" ", "event_type", F.when(i % 11 == 0, "(native=0.00)").otherwise("text"), F.concat(F.lit("w"), (i % 5).cast("string"))).alias("text"),
            F.round(mod(37, 101) / 101, 6).alias("domain"),
            F.round(0.5 + mod(53, 97) / 194, 6).alias("semantic"),
            F.round((k % 50) / 20, 6).alias("lex"),
            F.round(mod(29, 89) / 89, 6).alias("copy"),
            F.round((i % 8) * 0.05, 6).alias("penalty"),
        ).cast(CANDIDATE).alias("c"),
        F.when(i % 13 == 0, "the of").when(i % 17 == 0, "debug run12").otherwise(F.col("event_type")).alias("term"),
    )
    packed = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("cand", "src", "tgt", "event_type", "c", "term"))).alias("a"))
    first = F.get("a", F.lit(0))
    failed = first["event_type"] == "error"
    return packed.select(
        "case_id", first["src"].alias("src"), first["tgt"].alias("tgt"),
        (~failed).alias("ok"), F.when(failed, 500).otherwise(200).alias("status"),
        (F.col("case_id") % 6 == 0).alias("used_fallback"), (F.col("case_id") % 5 == 0).alias("warned"),
        F.transform("a", lambda x: x["term"]).alias("terms"),
        F.transform("a", lambda x: x["c"]).alias("candidates"),
        first["c"].alias("best"),
    )


#: The same for DuckDB: ``cand`` has a row for each candidate, ``cases`` one for each case.
SQL = """
WITH cand AS (
  SELECT event_id // 4 AS case_id, CAST(event_id % 4 AS INTEGER) AS cand, user_id % 4 AS src, user_id % 3 AS tgt, event_type,
         event_type || ' ' || CASE WHEN event_id % 11 = 0 THEN '(native=0.00)' ELSE 'text' END || ' w' || CAST(event_id % 5 AS VARCHAR) AS text,
         round(((event_id * 37) % 101) / 101.0::DOUBLE, 6) AS domain, round(0.5::DOUBLE + ((event_id * 53) % 97) / 194.0::DOUBLE, 6) AS semantic,
         round((CAST(json_extract_string(props, '$.k') AS BIGINT) % 50) / 20.0::DOUBLE, 6) AS lex, round(((event_id * 29) % 89) / 89.0::DOUBLE, 6) AS copy,
         round((event_id % 8) * 0.05::DOUBLE, 6) AS penalty,
         CASE WHEN event_id % 13 = 0 THEN 'the of' WHEN event_id % 17 = 0 THEN 'debug run12' ELSE event_type END AS term
  FROM events
), cases AS (
  SELECT case_id, src, tgt, event_type <> 'error' AS ok, case_id % 6 = 0 AS used_fallback, case_id % 5 = 0 AS warned, text, domain, semantic, lex, copy, penalty
  FROM cand QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY cand) = 1
), good AS (SELECT * FROM cases WHERE ok),
leaky AS (SELECT case_id, cand, regexp_matches(text, '(?i)\\(domain-specific concept\\)|\\(native=|\\[updatedgpt|native=0\\.00') AS leak FROM cand)
"""
