"""Evidence of terms: an index of irregular JSON as a table dealt by key, and its look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HIT = "struct<snippet:string,doc_id:string,source:string>"


def evidence_index(documents: DataFrame, column: str = "value") -> DataFrame:
    """(key, pos, hit) of JSON documents that map a key to a list of entries.

    Tolerant: a text that is no JSON, or no object, gives nothing, as does a value that is no list; an entry that is no
    object is passed over and takes no place; a field that is missing is empty.  Keys are trimmed and in lower case; of
    a key that comes more than once the entries follow each other.
    """
    parsed = documents.select(F.try_parse_json(column).alias("v"))
    return parsed.sparkSession.sql(
        f"""
        WITH node AS (SELECT n.key AS name, n.value AS list FROM {{parsed}} AS d, LATERAL variant_explode(CASE WHEN schema_of_variant(d.v) LIKE 'OBJECT%' THEN d.v END) AS n),
        entry AS (SELECT lower(trim(name)) AS key, name, e.pos AS at, e.value AS x FROM node, LATERAL variant_explode(CASE WHEN schema_of_variant(list) LIKE 'ARRAY%' THEN list END) AS e)
        SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY name, at) - 1 AS INT) AS pos,
               named_struct('snippet', coalesce(try_variant_get(x, '$.snippet', 'string'), ''), 'doc_id', coalesce(try_variant_get(x, '$.doc_id', 'string'), ''), 'source', coalesce(try_variant_get(x, '$.source', 'string'), '')) AS hit
        FROM entry WHERE schema_of_variant(x) LIKE 'OBJECT%'
        """,
        parsed=parsed,
    )


def read_evidence(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """The index of files, each one JSON document, or one a line; no path is an empty index."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"key string, pos int, hit {HIT}")
    return evidence_index(spark.read.text(path, wholetext=not lines))
