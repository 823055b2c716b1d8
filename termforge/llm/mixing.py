"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent and normalised.  The
exponent is bisected to meet a target entropy or a limit of repetition.  The
weights times the budget are each source's tokens.  A source is dealt into
blocks; every epoch is a permutation of its blocks.  Whole epochs take all
blocks; the last takes blocks in order while they fit, and of the block at the
edge the documents in their order while they fit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import Scratch

#: Sources up to this number are weighed on the driver, more by the cluster.
DRIVER_SOURCES = 100_000


def weights_at(exponent: float, shares: np.ndarray) -> np.ndarray:
    w = np.where(shares > 0, np.power(np.maximum(shares, 1e-300), exponent), 0.0)
    return w / max(w.sum(), 1e-300)


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def bisect_exponent(measure, *, target_entropy: float | None, repetition_limit: float | None, budget_ratio: float, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] that meets the limits.

    ``measure(exponent)`` gives (entropy, largest weight over share).  Entropy
    falls and repetition falls as the exponent grows: the target entropy asks
    for an exponent at most so large, the limit for one at least so large, and
    the limit wins.
    """
    low = 0.0

    def search(fits) -> float:
        a, b = 0.0, 1.0
        if fits(a):
            return a
        if not fits(b):
            return b
        for _ in range(steps):
            m = (a + b) / 2
            a, b = (a, m) if fits(m) else (m, b)
        return b

    if target_entropy is not None:
        low = search(lambda e: measure(e)[0] <= target_entropy)
    if repetition_limit is not None:
        low = max(low, search(lambda e: measure(e)[1] * budget_ratio <= repetition_limit))
    return low


def _source_weights(sources: DataFrame, total: int, budget: float, target_entropy, repetition_limit) -> tuple[DataFrame, float]:
    spark = sources.sparkSession
    ratio = budget / max(total, 1)
    if sources.count() <= DRIVER_SOURCES:
        rows = sources.toPandas().sort_values("source", na_position="first")
        p = rows["tokens"].to_numpy(float) / max(total, 1)

        def measure(e: float) -> tuple[float, float]:
            w = weights_at(e, p)
            return entropy(w), float((w[p > 0] / p[p > 0]).max(initial=0.0))

        e = bisect_exponent(measure, target_entropy=target_entropy, repetition_limit=repetition_limit, budget_ratio=ratio)
        rows["weight"] = weights_at(e, p)
        data = [(None if s is None or s != s else s, int(t), float(w)) for s, t, w in zip(rows["source"], rows["tokens"], rows["weight"])]
        return spark.createDataFrame(data, "source string, tokens long, weight double"), e
    p = F.col("tokens") / F.lit(float(total))

    def measured(e: float) -> tuple[float, float, float]:
        z = F.pow(p, F.lit(e))
        r = sources.where("tokens > 0").agg(F.sum(z).alias("z"), F.sum(z * F.log(z)).alias("l"), F.max(z / p).alias("m")).first()
        return math.log(r["z"]) - r["l"] / r["z"], r["m"] / r["z"], r["z"]

    e = bisect_exponent(lambda x: measured(x)[:2], target_entropy=target_entropy, repetition_limit=repetition_limit, budget_ratio=ratio)
    z = measured(e)[2]
    return sources.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(p, F.lit(e)) / z).otherwise(0.0)), e


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = None, repetition_limit: float | None = None, entropy_share: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """The mixture's rows: doc_id, source, n_tokens, epoch (from 0), block, position, weight and columns of ``keep``.

    An epoch's blocks come in the order of position, another one in every epoch.
    Columns of ``keep`` with the name of one of these are left out; all other
    columns of ``docs`` are ignored.

    Tokens are runs without white space.  ``budget`` is the mixture's size in
    tokens, by default that of all documents.  ``entropy_share`` sets the target
    entropy as a share of the log of the number of sources.  Every source's
    tokens come within one document of weight times budget.  Null sources are
    one source.  Documents without tokens, null texts too, go with their block;
    a source without any tokens has no weight and gives no rows.  Repeated rows
    are rows of their own.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keep = tuple(c for c in keep if c.lower() not in ("doc_id", "source", "n_tokens", "epoch", "block", "position", "weight"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"), *[F.col(c).alias("keep_" + c) for c in keep])
    slim = own if keep else scratch.save(own)
    base = slim.select("doc_id", "source", "n_tokens")
    sources = scratch.save(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    many = sources.where("tokens > 0").count()
    budget = total if budget is None else budget
    if entropy_share is not None and many > 1:
        target_entropy = entropy_share * math.log(many)
    weighed, _ = _source_weights(sources, total, budget, target_entropy, repetition_limit)
    quota = F.col("weight") * F.lit(float(budget))
    weighed = weighed.where("tokens > 0").withColumns({"epochs": F.floor(quota / F.col("tokens")), "blocks": F.ceil(F.col("tokens") / F.lit(block_tokens))})
    weighed = scratch.save(weighed.withColumn("rest", quota - F.col("epochs") * F.col("tokens")).select(F.col("source").alias("s"), "weight", "epochs", "blocks", "rest"))

    met = weighed["s"].eqNullSafe(F.col("source"))
    # A source's line has a few numbers; with a bounded number of sources it goes to all tasks.
    line = F.broadcast(weighed) if many <= DRIVER_SOURCES else weighed

    def blocked(d: DataFrame) -> DataFrame:
        return d.join(line, met).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "n_tokens"), F.col("blocks")))

    sized = scratch.save(blocked(base).groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest")))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "epochs", "block"), "block")
    ranked = sized.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    inside = F.col("before") + F.col("size") <= F.col("rest")
    edge = (F.col("before") < F.col("rest")) & ~inside
    part = scratch.save(ranked.where(inside | edge).select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), inside.alias("whole"), (F.col("rest") - F.col("before")).alias("room")))
    # One block of a source at most is at the edge; its documents are a bounded number of tokens.
    b = part.select("b_source", "b_block", "whole", "room")
    tagged = blocked(slim).join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")), "left")
    out_cols = ["doc_id", "source", "n_tokens", "epochs", "block", "weight", "whole", *["keep_" + c for c in keep]]
    sure = tagged.where("whole is null or whole").select(*out_cols)
    at_edge = tagged.where("not whole")
    w = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = at_edge.withColumn("whole", F.sum("n_tokens").over(w) <= F.col("room")).select(*out_cols)
    rows = sure.unionByName(cut)
    times = F.col("epochs") + F.coalesce(F.col("whole").cast("int"), F.lit(0))
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    position = F.xxhash64(F.lit(seed), "source", "epoch", "block").alias("position")
    return rows.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", position, "weight", *[F.col("keep_" + c).alias(c) for c in keep])
