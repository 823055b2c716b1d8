"""Domain term mining: counts, vocabulary, log-odds, class TF-IDF, style and topic lists."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T
from ..llm.storage import Scratch
from . import term_counts


_PARTS, _WORD = re.compile(r"[a-z][a-z0-9\-_/()]*|[^a-z]+"), re.compile(r"[a-z][a-z0-9\-_/]*")
_NEVER = frozenset(config.ACADEMIC + config.VERB_LIKE + config.CONNECTORS)
_UNFIT = frozenset(config.ACADEMIC + config.VERB_LIKE)
#: Phrases that a task counts before it passes the counts on.
COUNTED_AT_ONCE = 1 << 19


def text_terms(low: str) -> set[str]:
    """Tokens of a lower-case text, and its bigrams and trigrams of adjacent_ngrams without a connecting word."""
    p = _PARTS.findall(low)  # words and gaps in turn
    if p and not "a" <= p[0][0] <= "z":
        del p[0]
    words, gaps = p[::2], p[1::2]
    out = set(words)
    for w in [w for w in out if "(" in w or ")" in w]:
        out.discard(w)
        out.update(_WORD.findall(w))
    w0 = left = ""
    for w, gap in zip(words, ["  ", *gaps]):  # left: the bigram that ends before w
        if w in _NEVER:
            w0 = left = ""
            continue
        if len(gap) != 1:
            left = ""
        elif w0:
            pair = w0 + " " + w
            out.add(pair)
            if left:
                out.add(left + " " + w)
            left = pair
        w0 = w
    return out


def doc_terms(docs: DataFrame, domain: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, domain, term), a term once a document: tokens and phrases, not yet held against valid_phrase."""
    def terms(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [text_terms(t) for t in part.column(2).to_pylist()]
                at = pa.array([k for k, s in enumerate(sets) for _ in range(len(s))], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([t for s in sets for t in s], pa.string())], names=["doc_id", "domain", "term"])

    d = docs.where(F.col(text).isNotNull() & F.col(domain).isNotNull()).select("doc_id", F.col(domain).alias("domain"), F.lower(text).alias("low"))
    return d.mapInArrow(terms, "doc_id long, domain string, term string")


def frequent(docs: DataFrame, p: config.Mining = config.Mining()) -> DataFrame:
    """(term, total, by) of the valid terms in min_df documents or more; ``by`` has (domain, c) of every domain (a class label, so there are few), 0 where absent."""
    own = docs.where("text is not null and lang is not null").select(F.lower("text").alias("low"), F.col("lang").alias("domain"))
    domains = sorted(r[0] for r in own.select("domain").distinct().collect())
    g = term_counts.frequent_counts(own, domains, p.min_df)
    by = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"c{i}").alias("c")) for i, d in enumerate(domains)]).cast("array<struct<domain:string,c:bigint>>")
    # Mined once, whatever is made of it: the sums and every section read the table.
    return Scratch(docs.sparkSession).save(g.where(T.valid_phrase("term", True)).select("term", "total", by.alias("by")))


def counted(docs: DataFrame) -> DataFrame:
    """The one row with n_docs."""
    return docs.where("text is not null and lang is not null").agg(F.count("*").alias("n_docs"))


def log_odds(grid: DataFrame, p: config.Mining = config.Mining()) -> DataFrame:
    """Adds delta, z (log-odds with a Dirichlet prior), ctfidf and combined."""
    sums = grid.groupBy("domain").agg(F.sum("c").alias("nd"), F.sum("total").alias("nt")).withColumnRenamed("domain", "sum_domain")
    g = grid.join(F.broadcast(sums), F.col("domain") == F.col("sum_domain")).drop("sum_domain")
    prior = F.col("total") / F.col("nt") * F.lit(p.prior_mass)
    g = g.withColumns({"yd": F.col("c") + prior, "yo": F.col("total") - F.col("c") + prior})

    def odds(y: str, n: Column) -> Column:
        return F.log(F.col(y) / F.greatest(n + F.lit(p.prior_mass) - F.col(y), F.lit(1e-9)))

    delta = odds("yd", F.col("nd")) - odds("yo", F.col("nt") - F.col("nd"))
    g = g.withColumn("delta", delta)
    g = g.withColumn("z", F.col("delta") / F.sqrt(1 / F.greatest("yd", F.lit(1e-12)) + 1 / F.greatest("yo", F.lit(1e-12))))
    tf = F.col("c") / F.greatest(F.col("nd").cast("double"), F.lit(1e-12))
    g = g.withColumn("ctfidf", tf * F.log(1 + F.col("nt") / F.greatest(F.col("total"), F.lit(1))))
    return g.withColumn("combined", F.lit(p.z_weight) * F.col("z") + F.lit(1 - p.z_weight) * F.log1p(F.greatest("ctfidf", F.lit(0.0))))


def mined(docs: DataFrame, p: config.Mining = config.Mining()) -> DataFrame:
    """The statistics of every term of the vocabulary (neither too rare nor too frequent) for every domain."""
    vocab = frequent(docs, p).join(F.broadcast(counted(docs)), F.col("total") <= F.floor(F.col("n_docs") * p.max_df))
    return log_odds(vocab.select("term", "total", F.inline("by")), p)


def style(stats: DataFrame, n: int) -> DataFrame:
    """A domain's n style terms, the longest phrases first, then by z."""
    g = stats.where(kind_of("term") == "style").withColumn("words", T.ngram_len("term"))
    w = Window.partitionBy("domain").orderBy(F.desc("words"), F.desc("z"), "term")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("words")


def top_by(df: DataFrame, score: str, n: int, group: str = "domain", tie: str = "term") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def simple_tokens(docs: DataFrame) -> DataFrame:
    """Whitespace tokens, punctuation stripped at both ends, letters only, over 2 characters; repeats kept."""
    t = docs.select("doc_id", F.col("lang").alias("domain"), F.explode_outer(F.split(F.lower("text"), r"\s+")).alias("t"))
    t = t.withColumn("term", F.regexp_replace("t", r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", ""))
    return t.where(F.col("term").rlike(r"^\p{L}+$") & (F.length("term") > 2)).select("doc_id", "domain", "term")


def add_one_log_odds(tokens: DataFrame, least: int = 5) -> DataFrame:
    """(domain, term, c, log_odds) with add-one smoothing, domain against the rest."""
    c = tokens.groupBy("domain", "term").agg(F.count("*").alias("c"))
    total = c.groupBy("term").agg(F.sum("c").alias("ct"))
    nd = c.groupBy("domain").agg(F.sum("c").alias("nd"))
    n = total.agg(F.sum("ct").alias("nt"), F.count("*").alias("v"))
    g = c.join(total, "term").join(F.broadcast(nd), "domain").join(F.broadcast(n), how="cross")
    inside = (F.col("c") + 1) / (F.col("nd") + F.col("v"))
    outside = (F.col("ct") - F.col("c") + 1) / (F.col("nt") - F.col("nd") + F.col("v"))
    return g.where(F.col("ct") >= least).select("domain", "term", "c", F.log(inside / outside).alias("log_odds"))


def mean_tfidf(docs: DataFrame, min_df: int = 2, stop=config.FUNCTION_WORDS, most_often: int = 1 << 17) -> DataFrame:
    """(domain, term, tfidf_mean): words of two characters or more that are no stop words, smooth idf, rows of unit length,
    mean over the domain's documents.  ``doc_id`` must be unique."""
    own = docs.where("text is not null")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words

    def counted_words(batches):
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                counts = [Counter(x) for x in part.column(2).to_pylist()]
                at = pa.array([i for i, c in enumerate(counts) for _ in range(len(c))], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["doc_id", "domain", "term", "tf"])

    tf = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain"), words.alias("words")).mapInArrow(counted_words, "doc_id long, domain string, term string, tf long")
    n = own.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).join(F.broadcast(n), how="cross")
    idf = Scratch(docs.sparkSession).save(df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    # Words of most documents go to all tasks; only rows of other words are shuffled to meet theirs.
    often = idf.orderBy("idf", "term").limit(most_often)
    seldom = idf.join(F.broadcast(often.select("term")), "term", "left_anti")
    met = tf.join(F.broadcast(often), "term").unionByName(tf.join(F.broadcast(often.select("term")), "term", "left_anti").join(seldom, "term"))
    w = met.withColumn("w", F.col("tf") * F.col("idf"))
    # A document's weights come together once, so its norm needs no join.
    row = w.groupBy("doc_id", "domain").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("x"))
    per = own.groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("docs"))
    s = row.select("domain", "norm", F.explode("x").alias("x")).groupBy("domain", F.col("x.term").alias("term")).agg(F.sum(F.col("x.w") / F.col("norm")).alias("s"))
    return s.join(F.broadcast(per), "domain").select("domain", "term", (F.col("s") / F.col("docs")).alias("tfidf_mean"))


def simple_lexicon(log_odds_df: DataFrame, tfidf: DataFrame, n: int = 20) -> DataFrame:
    """Union of the two pools of 3n terms, log-odds first, each term once, n a domain."""
    a = top_by(log_odds_df.withColumn("s", F.round("log_odds", 6)), "s", 3 * n).select("domain", "term", F.lit(0).alias("pool"), "rank", F.col("s").alias("log_odds"))
    b = top_by(tfidf.withColumn("s", F.round("tfidf_mean", 6)), "s", 3 * n).select("domain", "term", F.lit(1).alias("pool"), "rank", F.lit(0.0).alias("log_odds"))
    first = Window.partitionBy("domain", "term").orderBy("pool", "rank")
    u = a.unionByName(b).withColumn("k", F.row_number().over(first)).where("k = 1")
    w = Window.partitionBy("domain").orderBy("pool", "rank")
    return u.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select("domain", "pos", "term", "log_odds")


def kind_of(term: str | Column) -> Column:
    """style or topic: one word is topic if generic or academic, more words if two are generic nouns."""
    words = F.split(T.col(term), " ")
    generic = F.array(*map(F.lit, config.GENERIC_SCIENCE))
    single = T.col(term).isin(*(config.GENERIC_SCIENCE + config.ACADEMIC))
    many = F.size(F.filter(words, lambda w: F.array_contains(generic, w))) >= 2
    return F.when(F.when(F.size(words) == 1, single).otherwise(many), "topic").otherwise("style")


def adjacent_ngrams(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, phrase, n): bigrams and trigrams of adjacent tokens one character apart, no stop or verb-like token.

    A token's followers are taken from the array of its text, so nothing is shuffled before the result is made distinct.
    """
    bad = config.ACADEMIC + config.VERB_LIKE
    parts = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z0-9\-_/()]*|[^a-z]+"), F.lit(0))
    base = docs.where("text is not null").select("doc_id", F.col("lang").alias("domain"), parts.alias("p"))
    each = F.transform("p", lambda w, i: F.struct(w.alias("w"), *[F.get("p", i + k).alias(f"a{k}") for k in (1, 2, 3, 4)]))
    ahead = base.select("doc_id", "domain", F.explode_outer(each).alias("x")).select("doc_id", "domain", "x.*")
    is_word = lambda c: F.col(c).rlike("^[a-z]") & ~F.col(c).isin(*bad)
    gap = lambda c: (F.length(c) == 1) & ~F.col(c).rlike("^[a-z]")
    two = is_word("w") & gap("a1") & is_word("a2")
    pair = F.when(two, F.struct(F.concat_ws(" ", "w", "a2").alias("phrase"), F.lit(2).alias("n")))
    triple = F.when(two & gap("a3") & is_word("a4"), F.struct(F.concat_ws(" ", "w", "a2", "a4").alias("phrase"), F.lit(3).alias("n")))
    out = ahead.where(two).select("doc_id", "domain", F.explode_outer(F.filter(F.array(pair, triple), lambda x: x.isNotNull())).alias("g"))
    return out.select("doc_id", "domain", "g.phrase", "g.n").distinct()


def adjacent_phrases(low: str) -> tuple[set[str], set[str]]:
    """(bigrams, trigrams) of adjacent tokens of a lower-case text one character apart, no stop or verb-like token."""
    p = _PARTS.findall(low)  # words and gaps in turn
    if p and not "a" <= p[0][0] <= "z":
        del p[0]
    words, gaps = p[::2], p[1::2]
    near = [len(g) == 1 and a not in _UNFIT and b not in _UNFIT for a, b, g in zip(words, words[1:], gaps)]
    two = {f"{a} {b}" for a, b, ok in zip(words, words[1:], near) if ok}
    three = {f"{a} {b} {c}" for a, b, c, ok, more in zip(words, words[1:], words[2:], near, near[1:]) if ok and more}
    return two, three


def adjacent_counts(docs: DataFrame) -> DataFrame:
    """(domain, phrase, n, df): the phrases of :func:`adjacent_ngrams`, and in how many documents they are.

    A text's phrases are made distinct where it is, and counted in each task before they are shuffled; only where ids
    repeat do rows of one id and domain meet first.
    """
    own = docs.where("text is not null").select("doc_id", F.col("lang").alias("domain"), F.lower("text").alias("low"))
    repeated = not own.groupBy("doc_id").count().where("count > 1").isEmpty()

    def run(batches):
        met: dict = {}

        def out():
            for (key, domain, n), counts in met.items():
                for first in range(0, len(phrases := list(counts)), 1 << 15):
                    part = phrases[first : first + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array([domain] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([n] * len(part), pa.int32()), pa.array([counts[x] for x in part], pa.int64())], names=["key", "domain", "phrase", "n", "df"])
            met.clear()

        held = 0
        for batch in batches:
            for key, domain, low in zip(*(batch.column(c) for c in ("key", "domain", "low"))):
                for n, phrases in enumerate(adjacent_phrases(low.as_py()), 2):
                    held += len(phrases)
                    met.setdefault((key.as_py(), domain.as_py(), n), Counter()).update(phrases)
                if held > COUNTED_AT_ONCE:
                    yield from out()
                    held = 0
        yield from out()

    key = F.col("doc_id").cast("string") if repeated else F.lit(None).cast("string")
    # A file of few blocks would leave most cores without work.
    spark = docs.sparkSession
    d = own.repartition(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = d.select(key.alias("key"), "domain", "low").mapInArrow(run, "key string, domain string, phrase string, n int, df long")
    if repeated:
        each = each.select("key", "domain", "phrase", "n").distinct().withColumn("df", F.lit(1))
    return each.groupBy("domain", "phrase", "n").agg(F.sum("df").alias("df"))
