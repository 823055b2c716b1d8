"""Lexicons, term scores, analogs, evidence, strategy, reranking, evaluation, bandit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T
from . import evaluation


def term_scores(stats: DataFrame, lexicon: DataFrame, src: str, tgt: str, p: config.Scoring = config.Scoring()) -> DataFrame:
    """Familiarity in the target, distinctiveness of the source, flag and reason, for every term of ``stats`` (domain, term, z).

    An absent z is 0; a term of the lexicon counts as .6 familiar, or .8 distinctive, where its z is 0.
    """
    per = stats.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("domain") == tgt, F.col("z"))), F.lit(0.0)).alias("tz"), F.coalesce(F.max(F.when(F.col("domain") == src, F.col("z"))), F.lit(0.0)).alias("sz"), F.max(F.when(F.col("domain") != src, F.col("z"))).alias("oz"))
    # A domain without the term has z = 0 in the maximum over the others.
    others = stats.where(F.col("domain") != src).agg(F.countDistinct("domain").alias("n_other"))
    has = stats.where(F.col("domain") != src).groupBy("term").agg(F.countDistinct("domain").alias("n_has"))
    per = per.join(has, "term", "left").join(F.broadcast(others), how="cross").withColumn("oz", F.when(F.coalesce("n_has", F.lit(0)) < F.col("n_other"), F.greatest(F.coalesce("oz", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("oz")))
    in_lex = lexicon.groupBy("term").agg(F.max(F.col("domain") == tgt).alias("in_t"), F.max(F.col("domain") == src).alias("in_s"))
    j = per.join(in_lex, "term", "left")
    in_t, in_s = F.coalesce("in_t", F.lit(False)), F.coalesce("in_s", F.lit(False))
    fam = F.when(F.col("tz") != 0, T.sigmoid(F.col("tz") / 2)).when(in_t, F.lit(0.6)).otherwise(F.lit(0.1))
    own = F.when((F.col("sz") == 0) & in_s, F.lit(0.8)).otherwise(F.col("sz"))
    dist = T.sigmoid((own - F.coalesce("oz", F.lit(0.0))) / 2)
    j = j.select("term", F.round(fam, 4).alias("familiarity"), F.round(dist, 4).alias("distinctiveness"), fam.alias("_fam"), dist.alias("_dist"))
    low, high = F.col("_fam") <= p.tgt_threshold, F.col("_dist") >= p.src_threshold
    reason = F.concat_ws("+", F.when(high, "src_distinctive"), F.when(low, "low_tgt_familiarity"))
    return j.withColumns({"flagged": low & high, "reason": F.when(reason == "", "not_flagged").otherwise(reason)}).drop("_fam", "_dist")


def analog_pairs(terms: DataFrame, pool: DataFrame, least: float, k: int) -> DataFrame:
    """(term, candidate, score, rank): the k pool phrases of highest token Jaccard, by shared tokens only."""
    left = terms.select("term", F.array_distinct(F.split("term", " ")).alias("ts"))
    right = pool.select(F.col("term").alias("candidate"), F.array_distinct(F.split("term", " ")).alias("cs"))
    a = left.select("term", F.size("ts").alias("na"), F.explode("ts").alias("tok"))
    b = right.select("candidate", F.size("cs").alias("nb"), F.explode("cs").alias("tok"))
    both = a.join(b, "tok").where("term <> candidate").groupBy("term", "candidate", "na", "nb").agg(F.count("*").alias("o"))
    scored = both.withColumn("score", F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).where(F.col("score") >= least)
    w = Window.partitionBy("term").orderBy(F.desc("score"), "candidate")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("term", "candidate", "score", "rank")


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """(probe, vec_id, cosine, rank): each query's k vectors of highest cosine to 6 places but itself, ties to the smaller vec_id.

    Both sides (vec_id, embedding) are dealt into blocks; a task holds one block of each.  Rows with a null id or without
    a cosine (null or non-finite components, all zero) take no part; the shorter of two vectors counts as zero beyond its end.
    """
    def usable(df: DataFrame) -> DataFrame:
        e = F.transform("embedding", lambda x: x.cast("double"))
        fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & fine)

    q, c = usable(queries).dropDuplicates(["vec_id"]), usable(vectors)
    q_blocks, c_blocks = max(1, -(-queries.count() // query_rows)), max(1, -(-vectors.count() // block_rows))
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(q_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))))
    c = c.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(c_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def rows(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        ids, lists = t.column("vec_id").to_numpy(), t.column("e").to_pylist()
        order = np.argsort(ids, kind="stable")
        return ids[order], [np.array(lists[i]) for i in order]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        (q_ids, q_rows), (c_ids, c_rows) = rows(left), rows(right)
        dims = np.zeros((max((len(r) for r in c_rows), default=0), len(c_ids)))
        for i, r in enumerate(c_rows):
            dims[: len(r), i] = r
        square = np.zeros(len(c_ids))
        for d in dims:  # summed in the order of the dimensions
            square += d * d
        out: list[tuple[int, int, float]] = []
        for qid, row in zip(q_ids.tolist(), q_rows):
            dot, own = np.zeros(len(c_ids)), 0.0
            for x in row.tolist():
                own += x * x
            for x, d in zip(row.tolist(), dims):
                dot += x * d
            cosine = np.round(dot / (np.sqrt(square) * np.sqrt(own)), 6)
            cosine[(c_ids == qid) | np.isnan(cosine)] = -np.inf
            near = cosine >= (np.partition(cosine, len(cosine) - k)[len(cosine) - k] if len(cosine) > k else -1.0)
            at = np.flatnonzero(near & (cosine > -np.inf))  # by vec_id
            out += [(qid, int(c_ids[i]), float(cosine[i])) for i in at[np.argsort(-cosine[at], kind="stable")[:k]]]
        probe, vec_id, cosine = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(probe, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(cosine, pa.float64())], names=["probe", "vec_id", "cosine"])

    part = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(search, "probe long, vec_id long, cosine double")
    w = Window.partitionBy("probe").orderBy(F.desc("cosine"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("probe", "vec_id", "cosine", "rank")


def native_score(in_lexicon: Column, is_acronym: Column, delta: Column, shares_token: Column) -> Column:
    return F.when(in_lexicon, 1.0).when(is_acronym, 0.8).when(delta.isNotNull(), T.sigmoid(delta)).when(shares_token, 0.25).otherwise(0.0)


def strategy_class(native: Column, neighbor: Column, formal: Column, symbols: Column) -> Column:
    return F.when(native >= 0.6, "equivalent").when(neighbor >= 0.35, "analogous").when(formal | (symbols > 0.2), "intranslatable").otherwise("unique")


def strategy_penalty(kind: Column, neighbor_used: Column) -> Column:
    """Aggregate: unique .08, analogous without its neighbour .04, intranslatable .10, at most .35."""
    one = F.when(kind == "unique", 0.08).when((kind == "analogous") & ~neighbor_used, 0.04).when(kind == "intranslatable", 0.10).otherwise(0.0)
    return F.least(F.lit(0.35), F.sum(one))


def evidence_score(z: Column, n: Column, p: config.Reward = config.Reward()) -> Column:
    """Aggregate: clamped z weighted by n-gram length, clamped."""
    w = F.when(n == 1, 0.25).when(n == 2, 0.7).otherwise(1.0)
    return F.least(F.lit(p.lex_clamp), F.sum(F.least(F.lit(p.z_clamp), F.greatest(F.lit(0.0), z)) * w))


def reward(domain: Column, lexical: Column, copy: Column, semantic: Column, penalty: Column, p: config.Reward = config.Reward()) -> Column:
    total = domain + p.lex_weight * lexical - p.copy_weight * F.greatest(F.lit(0.0), copy - p.copy_limit) - p.strategy_weight * penalty
    return F.when(semantic >= p.semantic_floor, total).otherwise(F.lit(-1e9))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, source, candidate): each user turn with the assistant turn after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ahead = conversations.withColumns({"nrole": F.lead("role").over(w), "candidate": F.lead("text").over(w)})
    return ahead.where("role = 'user' and nrole = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "candidate")


def rouge_l(source: str, candidate: str) -> Column:
    """F1 of the longest common token subsequence, in Arrow batches."""
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            x, y = (list(v) if v is not None else [] for v in (x, y))
            if not x or not y:
                return 0.0
            at: dict[str, int] = {}
            for i, w in enumerate(y):
                at[w] = at.get(w, 0) | 1 << i
            row = 0
            for w in x:  # bit-parallel longest common subsequence
                m = row | at.get(w, 0)
                row = m & ~(m - (row << 1 | 1))
            n = bin(row & (1 << len(y)) - 1).count("1")
            return 2.0 * n / (len(x) + len(y)) if n else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return score(T.tokens(source), T.tokens(candidate))


def arm_stats(events: DataFrame) -> DataFrame:
    """(route, action): pulls, total and mean reward."""
    return events.groupBy(F.col("user_id").alias("route"), F.col("event_type").alias("action")).agg(F.count("*").alias("pulls"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def confusion(pred: DataFrame, label: str = "label", guess: str = "prediction") -> DataFrame:
    return pred.groupBy(label, guess).count()


def class_metrics(pred: DataFrame, label: str = "label", guess: str = "prediction") -> DataFrame:
    """(label, support, precision, recall, f1) of every label that is true or predicted."""
    return evaluation.accuracy_and_macro_f1(pred, label, guess)[1]
