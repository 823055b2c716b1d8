"""Domain lexicons: sections of mined terms, as a table, as JSON and back, and the gates that artifacts must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T
from . import mining

# Sections in the order in which they are merged, the older names last; sections of the overlap gate; marks of debug rows.
MERGED = ("bigrams", "trigrams", "style", "top_bigrams", "top_trigrams", "top_terms")
GATED = ("style", "bigrams", "trigrams")
DEBUG_ROWS = r"(?i)updatedgpt|native=|domain-specific concept"


def sections(stats: DataFrame, n: int = 300) -> DataFrame:
    """(domain, section, rank, term): the n first of each section of statistics (domain, term, z, combined).

    style: longest phrases first, then by z; topic: by combined; bigrams and trigrams: those of all style terms, in
    the order of style.  Ties go to the smaller term.  A term is one row with its place in each section; only the
    first n of a section and domain leave the window.
    """
    t = stats.select("domain", "term", "z", "combined", mining.kind_of("term").alias("kind"), T.ngram_len("term").alias("words"))
    style, topic = t.where("kind = 'style'"), t.where("kind = 'topic'")
    named = [
        style.select("domain", F.lit("style").alias("section"), "term", F.col("words").cast("double").alias("a"), F.col("z").alias("b")),
        topic.select("domain", F.lit("topic").alias("section"), "term", F.col("combined").alias("a"), F.lit(0.0).alias("b")),
        style.where("words in (2, 3)").select("domain", F.when(F.col("words") == 2, "bigrams").otherwise("trigrams").alias("section"), "term", F.col("z").alias("a"), F.lit(0.0).alias("b")),
    ]
    rows = named[0].unionByName(named[1]).unionByName(named[2])
    w = Window.partitionBy("domain", "section").orderBy(F.desc("a"), F.desc("b"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("domain", "section", "rank", "term")


def merged(lexicon: DataFrame, order: tuple[str, ...] = MERGED) -> DataFrame:
    """(domain, rank, term): a domain's terms, section after section, each once whatever its case; the first way of writing stays.

    Rows of a plain list have a null section and come first.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("section")), F.lit(0))
    rows = lexicon.where(F.col("section").isNull() | F.col("section").isin(*order)).select("domain", place.alias("p"), "rank", F.trim("term").alias("term")).where("term <> ''")
    first = rows.groupBy("domain", F.lower("term").alias("low")).agg(F.min(F.struct("p", "rank", "term")).alias("x"))
    w = Window.partitionBy("domain").orderBy("x.p", "x.rank", "low")
    return first.select("domain", F.row_number().over(w).alias("rank"), F.col("x.term").alias("term"))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """JSON lines of {domain, sections: {section: [term, ..]}}: a line a domain, its terms in order."""
    lists = lexicon.groupBy("domain", "section").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("a"))
    one = lists.select("domain", F.struct("section", F.transform("a", lambda x: x["term"]).alias("terms")).alias("s")).groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list("s"))).alias("sections"))
    one.write.mode("overwrite").json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(domain, section, rank, term) of what :func:`write_lexicon` wrote, or of JSON documents that map a domain to a plain
    list or to its sections; what has another shape is passed over."""
    text = spark.read.text(path, wholetext=False) if _lines(spark, path) else spark.read.text(path, wholetext=True)
    parsed = text.select(F.try_parse_json("value").alias("v")).where("v is not null")
    return spark.sql(
        """
        WITH one AS (SELECT coalesce(try_variant_get(v, '$.domain', 'string'), '') AS name, v FROM {parsed}),
        node AS (
          SELECT name AS domain, variant_get(v, '$.sections') AS body FROM one WHERE name <> '' AND schema_of_variant(v) LIKE 'OBJECT%'
          UNION ALL
          SELECT d.key, d.value FROM one, LATERAL variant_explode(CASE WHEN name = '' AND schema_of_variant(v) LIKE 'OBJECT%' THEN v END) AS d),
        list AS (
          SELECT domain, CAST(NULL AS STRING) AS section, body AS terms FROM node WHERE schema_of_variant(body) LIKE 'ARRAY%'
          UNION ALL
          SELECT domain, s.key, s.value FROM node, LATERAL variant_explode(CASE WHEN schema_of_variant(body) LIKE 'OBJECT%' THEN body END) AS s WHERE schema_of_variant(s.value) LIKE 'ARRAY%')
        SELECT domain, section, CAST(t.pos + 1 AS INT) AS rank, try_variant_get(t.value, '$', 'string') AS term FROM list, LATERAL variant_explode(terms) AS t
        """,
        parsed=parsed,
    )


def _lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a whole JSON object with a domain."""
    head = spark.read.text(path).limit(1).collect()
    return bool(head) and head[0]["value"].lstrip().startswith('{"domain"')


def debug_rows(stats: DataFrame) -> DataFrame:
    """Term statistics whose term is a debug marker's."""
    return stats.where(F.col("term").rlike(DEBUG_ROWS))


def gates(lexicon: DataFrame, stats: DataFrame, metrics: DataFrame, *, least_style: int = 30, least_by_domain: dict[str, int] | None = None, most_overlap: float = 0.25, least_f1: float = 0.75, top: int = 200) -> DataFrame:
    """(gate, subject, value, limit, passed): banned terms, style terms and overlaps of a lexicon (domain, section, rank,
    term), debug rows of the statistics, macro_f1 of the metrics.

    Banned terms and overlaps are those of the first ``top`` of style, bigrams and trigrams, in that order.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, GATED)), F.col("section")), F.lit(0))
    w = Window.partitionBy("domain").orderBy("p", "rank", "term")
    rows = lexicon.where(F.col("section").isNull() | F.col("section").isin(*GATED)).withColumn("p", place)
    tops = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("domain", F.lower("term").alias("term")).distinct()
    least = F.lit(least_style)
    for d, n in (least_by_domain or {}).items():
        least = F.when(F.col("domain") == d, n).otherwise(least)
    num = lambda c: c.cast("double")
    banned = tops.groupBy("domain").agg(F.count_if(F.col("term").isin(*config.BANNED_TERMS)).alias("n")).select(F.lit("banned").alias("gate"), F.col("domain").alias("subject"), num(F.col("n")).alias("value"), F.lit(0.0).alias("limit"), (F.col("n") == 0).alias("passed"))
    style = lexicon.groupBy("domain").agg(F.count_if(F.col("section").isNull() | (F.col("section") == "style")).alias("n")).select(F.lit("style").alias("gate"), F.col("domain").alias("subject"), num(F.col("n")).alias("value"), num(least).alias("limit"), (F.col("n") >= least).alias("passed"))
    # At most ``top`` terms a domain: the pairs meet by term.
    size = tops.groupBy("domain").agg(F.count("*").alias("n"))
    shared = tops.select(F.col("domain").alias("a"), "term").join(tops.select(F.col("domain").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = size.select(F.col("domain").alias("a"), F.col("n").alias("na")).join(size.select(F.col("domain").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    share = F.col("both") / F.greatest(F.col("na") + F.col("nb") - F.col("both"), F.lit(1))
    overlap = pairs.select(F.lit("overlap").alias("gate"), F.concat_ws("-", "a", "b").alias("subject"), share.alias("value"), F.lit(most_overlap).alias("limit"), (share <= most_overlap).alias("passed"))
    debug = debug_rows(stats).groupBy().agg(F.count("*").alias("n")).select(F.lit("debug_rows").alias("gate"), F.lit("").alias("subject"), num(F.col("n")).alias("value"), F.lit(0.0).alias("limit"), (F.col("n") == 0).alias("passed"))
    f1 = metrics.groupBy().agg(F.coalesce(F.max("macro_f1"), F.lit(0.0)).alias("v")).select(F.lit("macro_f1").alias("gate"), F.lit("").alias("subject"), F.col("v").alias("value"), F.lit(least_f1).alias("limit"), (F.col("v") >= least_f1).alias("passed"))
    return banned.unionByName(style).unionByName(overlap).unionByName(debug).unionByName(f1)
