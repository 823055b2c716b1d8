"""Distributed connected components by alternating large-star and small-star steps.

Every step is two aggregations by minimum (combined before the shuffle) and a
join whose hot keys the engine can split; nothing is gathered per node.  Each
round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    hop = down.join(least, down["a"] == least["u"]).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hop.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, *, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    ``edges`` has columns a and b of one orderable type.  Self-loops and edges
    with a null end are left out, repeated edges count once.  Without edges the
    result is empty.
    """
    now = scratch.save(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        new = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if new["n"] == 0 or (new["n"], new["x"]) == mark:
            break
        mark = new["n"], new["x"]
        after = scratch.save(_small_star(_large_star(now)))
        scratch.discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
