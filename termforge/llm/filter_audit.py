"""Audit of how filters interact, by a Walsh-Hadamard transform of their failures.

A document's mask has a bit for each filter that it fails.  One aggregation
gives, for each part and label, the 2^k signed parity sums of the masks: the
sum over documents of -1 to the number of shared bits with each subset.  The
transform is its own inverse but for the factor 2^k, so the sums give the exact
number of documents of every mask.  From those cells all k! orders of the
filters are evaluated, and the Shapley value in closed form: a document that
fails c filters is removed by each of them in k! / c orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, functions as F

from .storage import Scratch

#: Fixed white space of words: space, tab, line feed, vertical tab, form feed, carriage return.
_BLANK = " \t\n\u000b\f\r"


def text_conditions(docs: DataFrame, text: str, *, least_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 2, odd: str = "[#$%&*|]") -> DataFrame:
    """``docs`` with ``mask``: bits 0 to 3 for few words, few distinct ones, many capitals, an odd character."""
    trimmed = docs.withColumn("trimmed", F.btrim(F.col(text), F.lit(_BLANK))).withColumn("words", F.split("trimmed", r"[\x20\x09-\x0D]+"))
    n = F.when(F.col("trimmed") == "", 0).otherwise(F.size("words"))
    distinct = F.when(F.col("trimmed") == "", 0).otherwise(F.size(F.array_distinct("words")))
    counted = trimmed.select("*", n.alias("n_words"), distinct.alias("n_distinct")).drop("words", "trimmed")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [F.col("n_words") < least_words, 100 * F.col("n_distinct").cast("long") < distinct_percent * F.col("n_words").cast("long"), 100 * capitals > capitals_percent * F.length(text).cast("long"), F.col(text).rlike(odd)]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails[1:], 1)), fails[0].cast("int"))
    return counted.withColumn("mask", mask).drop("n_words", "n_distinct")


def document_masks(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """part, mask, good and toxic of every document; bit 4 is for a text that a smaller id has too.

    Null texts are empty ones and null parts the empty string.  A document whose
    id is null fails no duplicate test and makes no other fail it.  Of rows with
    one id and one text none is the other's duplicate.  Labels of one id count
    together: good if any says so, toxic likewise.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    # Texts are read once; what is joined and counted has a hash of each.
    slim = scratch.save(text_conditions(own, "x").select("d", "part", "mask", F.unhex(F.sha2("x", 256)).alias("h")))
    first = slim.where("d is not null").groupBy("h").agg(F.min("d").alias("f_d")).select("f_d", F.col("h").alias("f_h"))
    known = labels.groupBy(F.col(doc_id).alias("l_d")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # By the id, which no group of copies shares: a document is the first of its text if its id is the least.
    met = slim.join(first, (F.col("d") == F.col("f_d")) & (F.col("h") == F.col("f_h")), "left").join(known, F.col("d") == F.col("l_d"), "left")
    again = F.col("d").isNotNull() & F.col("f_d").isNull()
    return met.select("part", (F.col("mask") + 16 * again.cast("int")).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def parity_sums(masks: DataFrame, filters: int) -> DataFrame:
    """part, good, toxic and w: the signed parity sums of all subsets."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    sums = [F.sum(sign(s).cast("long")).alias(f"w{s}") for s in range(1 << filters)]
    out = masks.groupBy("part", "good", "toxic").agg(*sums)
    return out.select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(1 << filters)]).alias("w"))


def cells(sums: DataFrame, filters: int) -> DataFrame:
    """part, all_docs, good_docs, toxic_docs: arrays of the number of documents of every mask."""
    size = 1 << filters
    inverse = f"transform(sequence(0, {size - 1}), m -> aggregate(sequence(0, {size - 1}), 0L, (a, s) -> a + w[s] * (1 - 2 * (bit_count(m & s) % 2))) div {size})"
    # The transform is linear: a part's labels are added as cells.
    each = sums.select("part", "good", "toxic", F.posexplode(F.expr(inverse)).alias("m", "n"))
    total = each.groupBy("part", "m").agg(F.sum("n").alias("a"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"))
    by_mask = F.array_sort(F.collect_list(F.struct("m", "a", "g", "t")))
    rows = total.groupBy("part").agg(by_mask.alias("c"))
    return rows.select("part", F.col("c.a").alias("all_docs"), F.col("c.g").alias("good_docs"), F.col("c.t").alias("toxic_docs"))


def evaluate_orders(counted: DataFrame, letters: str) -> DataFrame:
    """The report of every part, order and step, from the cells."""
    k = len(letters)
    orders = F.lit(["".join(p) for p in permutations(letters)])
    steps = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bits = F.expr(f"transform(sequence(1, {k}), i -> shiftleft(1, instr('{letters}', substring(filter_order, i, 1)) - 1))")
    steps = steps.withColumn("bits", bits).withColumn("bit", F.expr("bits[step - 1]")).withColumn("earlier", F.expr("aggregate(slice(bits, 1, step - 1), 0, (a, b) -> a | b)"))

    def over(docs: str, where: str, weight: str = "1L"):
        return F.expr(f"aggregate(filter(sequence(0, {(1 << k) - 1}), m -> {where}), 0L, (a, m) -> a + {weight} * {docs}[m])")

    here = "(m & bit) <> 0 and (m & earlier) = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        over("all_docs", "(m & (earlier | bit)) = 0").alias("kept"),
        over("all_docs", here).alias("removed"),
        over("all_docs", "(m & bit) <> 0 and (m & earlier) <> 0").alias("redundant"),
        over("all_docs", "m = bit").alias("unique_fails"),
        over("good_docs", here).alias("good_lost"),
        over("toxic_docs", here).alias("toxic_lost"),
        over("all_docs", "(m & bit) <> 0", f"({factorial(k)}L div bit_count(m))").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters A to E and step: what it keeps, removes and costs.

    A: few words.  B: few distinct words.  C: many capitals.  D: an odd
    character.  E: a text that a smaller id of the table has too.  ``kept``,
    ``removed`` and ``redundant`` tell what the step leaves, takes, and would
    have taken had no step before it done so; ``unique_fails`` what fails only
    this filter; ``good_lost`` and ``toxic_lost`` the labelled documents it
    takes; ``shapley`` its ``removed`` summed over all orders.

    Nulls, repeats and labels are taken as :func:`document_masks` says.  Empty
    texts have no words.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    sums = parity_sums(document_masks(docs, labels, doc_id=doc_id, text=text, part=part, scratch=scratch), 5)
    return evaluate_orders(cells(scratch.save(sums), 5), "ABCDE")
