"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is a byte model of order 6 trained on trusted text.  Its counts are
sharded; a block of documents sends its distinct grams to the shards, joins the
counts there, and gets log-probabilities back.  A document passes when its
perplexity is at most a quantile of the perplexities of trusted documents of its
language that the counts don't hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .gram_scores import ORDER, Level, count_grams, low_probability, lower_levels, plain, score_documents, shards_for, short_counts, text_bytes
from .storage import Scratch
from .toxicity import _with_labels, fold_of


def log_probability(short: np.ndarray, order: int = ORDER):
    """evaluate() for score_documents: log P of a gram's last byte."""

    def evaluate(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        p = low_probability(wanted, short)
        for k, level in enumerate(lower_levels(keys, order), 3):
            p = level.blend(wanted & np.uint64((1 << 8 * k) - 1), p)
        return np.log(np.maximum(Level(keys, counts[:, 0]).blend(wanted, p), 1e-12))

    return evaluate


def quality_scores(docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = 0.99, slack: float = 1.25, least: int = 20) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of every document row.

    ``trusted`` has the doc_id of every trusted document.  Of these, the rows of
    fold 0 (crc32 of the id as text, modulo 5) set the thresholds, the others
    the counts.  A language's threshold is ``slack`` times the ``quantile`` of
    its trusted perplexities; languages with fewer than ``least`` of them, null
    among them, take that of all languages.  Without trusted rows all documents
    pass.  Null and empty texts have the perplexity of an end of text and pass.
    Repeated rows score alike; an empty table gives no rows; other columns are
    ignored.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession)
    marks = scratch.save(trusted.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct().withColumn("fold", fold_of("doc_id")))
    n_bytes = text_bytes(d)
    shards = shards_for(n_bytes)
    model = scratch.save(count_grams(_with_labels(d, marks.where("fold > 0")).select("text", F.lit(0).alias("cls")), 1, plain, shards))
    if model.isEmpty():
        return d.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    short = short_counts(model)
    scored = scratch.save(score_documents(d, model, log_probability(short), 1, plain, shards, n_bytes))
    scratch.discard(model)
    scored = scored.withColumn("perplexity", F.exp(-F.col("total") / F.col("n_grams")))
    held = _with_labels(scored, marks.where("fold = 0"))
    limit = (slack * F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))).alias("own")
    by_lang = held.where("lang is not null").groupBy(F.col("lang").alias("l")).agg(limit, F.count("*").alias("n")).where(F.col("n") >= least).select("l", "own")
    overall = held.agg(limit).first()["own"]
    out = scored.join(by_lang, F.col("lang") == F.col("l"), "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    keep = (F.col("n_grams") <= 1) | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    return out.select("doc_id", "lang", "perplexity", "threshold", keep.alias("keep"))
