"""Exact top-k inner-product search by term-at-a-time accumulation.

A vector is a sparse row of integer weights.  Candidates are dealt into blocks
of a bounded number of rows; a block is turned into postings by dimension.  A
query's row scatters weight times posting into a dense array of the block's
scores, the k best are taken by partition selection, and the blocks' winners
are merged.  Queries come in blocks too, so a task holds one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def weights(vector: str = "embedding", scale: float = 256.0):
    """floor(scale * x) of each component; null for vectors null or holding null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)), F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("long")))


def _rows(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = table.column("w").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return ids[order], [values[offsets[i] : offsets[i + 1]] for i in order]


def _postings(rows: list[np.ndarray]) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """By dimension: the positions with a weight, and the weights."""
    width = max((len(r) for r in rows), default=0)
    dense = np.zeros((width, len(rows)), np.int64)
    for i, r in enumerate(rows):
        dense[: len(r), i] = r
    out = []
    for column in dense:
        at = np.flatnonzero(column)
        out.append((slice(None), column) if len(at) * 2 > len(column) else (at, column[at]))
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller position."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    level = np.flatnonzero(scores == least)[: k - len(above)]
    at = np.concatenate([above, level])
    return at[np.lexsort((at, -scores[at]))]


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates but itself.

    Scores are exact integer inner products of floor(scale * x); ties go to the
    smaller vec_id.  Of vectors of different lengths the shorter counts as zero
    beyond its end.  Rows with a null id or an unusable vector take no part, on
    either side.  Repeated candidate rows each take a rank; repeated query ids
    are searched once, by the smallest of their vectors.  With fewer than k candidates all are returned; empty
    tables give no rows.  Other columns are ignored.  Sums must fit 64 bits.
    """
    q = queries.select(F.col(id_col).cast("long").alias("vec_id"), weights(vector, scale).alias("w")).where("vec_id is not null and w is not null").groupBy("vec_id").agg(F.min("w").alias("w"))
    c = candidates.select(F.col(id_col).cast("long").alias("vec_id"), weights(vector, scale).alias("w")).where("vec_id is not null and w is not null")
    n_c, n_q = candidates.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n_c // block_rows)), max(1, -(-n_q // query_rows))
    # Position in the block comes from a hash of the whole row, so repeated ids and vectors spread too.
    c = c.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(c_blocks)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(q_blocks)))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q_rows = _rows(left)
        c_ids, c_rows = _rows(right)
        found: list[tuple[int, int, int]] = []
        if len(q_ids) and len(c_ids):
            postings = _postings(c_rows)
            for qid, row in zip(q_ids.tolist(), q_rows):
                scores = np.zeros(len(c_ids), np.int64)
                for term in np.flatnonzero(row[: len(postings)]):
                    at, weight = postings[term]
                    scores[at] += row[term] * weight
                own = np.searchsorted(c_ids, [qid, qid + 1])
                ids = c_ids
                if own[0] < own[1]:
                    scores, ids = np.delete(scores, np.s_[own[0] : own[1]]), np.delete(c_ids, np.s_[own[0] : own[1]])
                for i in best(scores, k):
                    found.append((qid, int(ids[i]), int(scores[i])))
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    part = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
