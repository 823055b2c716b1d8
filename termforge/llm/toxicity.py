"""Toxicity by class-conditional Kneser-Ney models.

Two byte models of order 6 over lower-cased words, one of toxic and one of
ordinary training texts.  Orders 4 to 6 are a class's own; they back off to
orders 1 to 3 that both share, built from the distinct grams of both classes, so
an expression that is rare in one class falls back to the same counts in both.
A document's score compares the two log-likelihoods divided by length, over the
whole text and over the 16 bytes in a row where they differ most; a logistic
curve fitted on training rows outside the counts turns that into a probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .gram_scores import ORDER, Level, count_grams, low_probability, lower_levels, score_documents, shards_for, short_counts, text_bytes, words_only
from .storage import Scratch, free_name

#: Rows to fit the three numbers of the logistic curve on, at most.
CALIBRATION_ROWS = 20_000
#: Labels are broadcast up to this number of rows, else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: The highest order that both classes share.
SHARED = 3


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids are in no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5))


def log_ratio(short: np.ndarray, order: int = ORDER):
    """evaluate() for score_documents: log P(toxic) - log P(ordinary) of a gram's last byte."""

    def last(wanted: np.ndarray, k: int) -> np.ndarray:
        return wanted & np.uint64((1 << 8 * k) - 1)

    def evaluate(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        shared = low_probability(wanted, short)
        for k, level in enumerate(lower_levels(keys, order)[: SHARED - 2], 3):
            shared = level.blend(last(wanted, k), shared)
        logs = []
        for c in (1, 0):
            own = np.flatnonzero(counts[:, c])
            p = shared
            for k, level in enumerate(lower_levels(keys[own], order, SHARED + 1), SHARED + 1):
                p = level.blend(last(wanted, k), p)
            logs.append(np.log(np.maximum(Level(keys[own], counts[own, c]).blend(wanted, p), 1e-12)))
        return logs[0] - logs[1]

    return evaluate


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve (bias first) by Newton's steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    small = labels.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(labels) if small else labels, "doc_id")


def _features() -> list[Column]:
    return [F.col("total") / F.greatest(F.col("n_grams"), F.lit(1)), F.col("peak")]


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio) of every document row.

    Labels are learnt only from rows outside fold 0: folds 1 to 3 give the
    counts, all of them; fold 4 gives the logistic curve.  Ids with several
    labels are toxic if one says so; null labels and null ids teach nothing.
    Null and empty texts score as a text of no words.  Without toxic or without
    ordinary training rows every score is the share of toxic labels, or 0.
    Repeated rows score alike; other columns are ignored.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("cls")).where("doc_id is not null and cls is not null").groupBy("doc_id").agg(F.max("cls").alias("cls"))
    marks = marks.withColumn("fold", fold_of("doc_id")).where("fold > 0 and cls in (0, 1)")
    held = F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out")
    share = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("cls"), F.lit(0)).alias("t")).first()
    scratch = Scratch(docs.sparkSession)
    marks = scratch.save(marks)
    train = _with_labels(d, marks.where("fold < 4")).select("text", "cls")
    if not 0 < share["t"] < share["n"]:
        p = float(share["t"]) / share["n"] if share["n"] else 0.0
        return d.select("doc_id", held, F.lit(p).alias("score"), F.lit(int(p >= 0.5)).alias("predicted"), F.lit(0.0).alias("log_ratio"))
    n_bytes = text_bytes(d)
    shards = shards_for(n_bytes)
    model = scratch.save(count_grams(train, 2, words_only, shards))
    scored = scratch.save(score_documents(d, model, log_ratio(short_counts(model)), 2, words_only, shards, n_bytes))
    scratch.discard(model)
    names = ["f0", "f1"]
    rows = _with_labels(scored, marks.where("fold = 4")).select("doc_id", "cls", *[c.alias(x) for c, x in zip(_features(), names)]).orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(CALIBRATION_ROWS).toPandas()
    x, y = rows[names].to_numpy(float), rows["cls"].to_numpy(float)
    if 0 < y.sum() < len(y):
        middle, wide = x.mean(0), x.std(0) + 1e-9
        w = fit_logistic((x - middle) / wide, y)
    else:
        middle, wide, w = np.zeros(2), np.ones(2), np.array([0.0, 50.0, 0.0])
    z = F.lit(float(w[0] - (w[1:] * middle / wide).sum()))
    for c, v, s in zip(_features(), w[1:], wide):
        z = z + F.lit(float(v / s)) * c
    score = 1 / (1 + F.exp(-z))
    return scored.select("doc_id", held, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), (F.col("total") / F.col("n_grams")).alias("log_ratio"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their own columns.

    Rows of one id are judged together: all go if one is toxic.  Rows with a
    null id stay unless one of them is toxic.  Other columns, whatever their
    names, are kept as they are; an empty table gives no rows.
    """
    bad = toxicity_scores(docs, labels, doc_id=doc_id, text=text).where("predicted = 1").select(F.col("doc_id").alias(free := free_name(docs, "bad"))).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(F.col(free)), "left_anti")
