"""The library's queries over the driver's tables; ``documents`` is the corpus, its language the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T
from ..operators import corpus, evaluation, mining, scoring
from ..streaming import state

QUERIES: dict = {}
P = config.Mining()


def query(f):
    QUERIES[f.__name__] = f
    return f


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "documents")


def r6(c):
    return F.round(T.col(c), 6)


def marked(spark, d):
    """Documents with debug markers put into every seventh."""
    return docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (native = 0.00) updatedgpt_noself_v2 [ updatedgpt x ]"))).otherwise(F.col("text")))


@query
def corpus_sanitize(spark, d):
    c = marked(spark, d)
    return c.select("doc_id", F.length(T.sanitize("text")).cast("long").alias("n_clean"), F.lower("text").rlike(r"updatedgpt|native\s*=").alias("had_marker"))


@query
def corpus_english_like(spark, d):
    return docs(spark, d).select("doc_id", r6(F.coalesce(T.letter_share("text"), F.lit(0.0))).alias("share"), T.english_like("text", 0.95).alias("english_like"))


@query
def corpus_filter_stages(spark, d):
    stage = corpus.drop_stage(min_chars=400, letters=0.95, keywords={"en": ["the and", "of the"]})
    return docs(spark, d).groupBy("lang", stage.alias("stage")).agg(F.count("*").alias("n"))


@query
def corpus_counts_rollup(spark, d):
    return corpus.rolled_counts(docs(spark, d)).select("domain", "src", "n", F.col("level").cast("long").alias("level"))


@query
def corpus_year_stats(spark, d):
    o = tab(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return o.groupBy("o_orderpriority").agg(F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.median("y").alias("y_median"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


@query
def corpus_balanced_size(spark, d):
    return corpus.balanced_size(docs(spark, d), 120).select(F.col("n").cast("long").alias("n"))


@query
def corpus_balanced_sample(spark, d):
    return corpus.balanced_sample(docs(spark, d), 60).select("doc_id", "lang")


@query
def corpus_below_minimum(spark, d):
    want = spark.createDataFrame([("en", 300), ("fr", 140), ("de", 140), ("es", 140), ("it", 10)], "domain string, least int")
    have = docs(spark, d).groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("n"))
    return want.join(have, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"), "least").where("n < least")


@query
def corpus_length_stats(spark, d):
    return docs(spark, d).groupBy("lang").agg(r6(F.avg(F.length("text"))).alias("avg_len"), F.min(F.length("text")).alias("min_len"), F.max(F.length("text")).alias("max_len"), F.median(F.length("text")).alias("median_len"))


@query
def mine_token_counts(spark, d):
    return mining.simple_tokens(docs(spark, d)).groupBy("domain", "term").agg(F.count("*").alias("c"))


@query
def mine_addone_logodds(spark, d):
    return mining.add_one_log_odds(mining.simple_tokens(docs(spark, d)), 5).select("domain", "term", "c", r6("log_odds").alias("log_odds"))


@query
def mine_tfidf_mean(spark, d):
    return mining.mean_tfidf(docs(spark, d)).select("domain", "term", r6("tfidf_mean").alias("tfidf_mean"))


@query
def mine_simple_lexicon(spark, d):
    c = docs(spark, d)
    return mining.simple_lexicon(mining.add_one_log_odds(mining.simple_tokens(c), 5), mining.mean_tfidf(c), P.simple_top_n)


@query
def mine_dirichlet_logodds(spark, d):
    """Every term of the vocabulary for every domain; rank 1 is the highest z."""
    g = mining.mined(docs(spark, d), P).select("domain", "term", "c", "total", r6("delta").alias("delta"), r6("z").alias("z"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("z"), "term")))


@query
def mine_ctfidf(spark, d):
    return mining.mined(docs(spark, d), P).where("c > 0").select("domain", "term", "c", r6("ctfidf").alias("ctfidf"))


@query
def mine_combined_topk(spark, d):
    g = mining.mined(docs(spark, d), P).select("domain", "term", r6("combined").alias("combined"))
    return mining.top_by(g, "combined", 50)


@query
def mine_vocab_removed(spark, d):
    c = docs(spark, d)
    return mining.frequent(c, P).join(F.broadcast(mining.counted(c)), F.col("total") > F.floor(F.col("n_docs") * P.max_df)).select("term", "total")


@query
def phrase_ngrams(spark, d):
    ph = mining.adjacent_counts(docs(spark, d))
    return ph.groupBy("domain", "n").agg(F.sum("df").alias("occurrences"), F.count("*").alias("phrases"))


@query
def phrase_style_topic(spark, d):
    ph = mining.adjacent_counts(docs(spark, d)).where("df >= 3")
    kinds = ph.withColumn("kind", mining.kind_of("phrase"))
    return mining.top_by(kinds.withColumn("s", F.col("n") * 1000000 + F.col("df")), "s", 30, tie="phrase").select("domain", "phrase", "n", "df", "kind")


@query
def phrase_valid(spark, d):
    b = tab(spark, d, "benchmark").select("item_id", T.tokens("text").alias("toks")).select("item_id", F.explode_outer(T.ngrams("toks", 2)).alias("p")).where("p is not null")
    return b.select("item_id", T.normalize_phrase("p").alias("phrase"), T.valid_phrase(T.normalize_phrase("p"), True).alias("ok")).distinct()


@query
def phrase_tech_patterns(spark, d):
    """Technical forms of annotation and special terms of strategies, with some put into every fifth document."""
    c = docs(spark, d).select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("A SE(3)-equivariant and SO(2)-equivariant-net k-space DFT inverse Fourier transform x-space "), "text")).otherwise(F.col("text")).alias("t"))
    found = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    both = [c.select(F.lit(kind).alias("kind"), F.explode(found(pattern)).alias("m")) for kind, pattern in (("technical", T.TECH), ("special", T.SPECIAL))]
    return both[0].unionByName(both[1]).groupBy("kind", "m").agg(F.count("*").alias("n"))


def _trigrams(spark, d):
    """Lexicon phrases: the benchmark's trigrams."""
    return tab(spark, d, "benchmark").select("item_id", T.tokens("text").alias("toks")).select("item_id", F.explode_outer(T.ngrams("toks", 3)).alias("term")).where("term is not null").distinct()


def _style(spark, d):
    return mining.style(mining.mined(docs(spark, d), P).select("domain", "term", r6("z").alias("z")), P.top_n)


@query
def lexicon_overlap(spark, d):
    """Token Jaccard of the domains' style lists; the lists are mined once, and terms meet by themselves."""
    held = _style(spark, d).groupBy("term").agg(F.array_sort(F.collect_set("domain")).alias("s"))
    both = held.select(F.explode("s").alias("a"), "s").select("a", F.explode(F.filter("s", lambda x: x >= F.col("a"))).alias("b"))
    # A number for each pair of domains, a domain with itself too: one small row.
    counts = both.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "a", "b"), "n"))).alias("n"))
    names = F.array_sort(F.transform(F.filter(F.map_keys("n"), lambda k: F.split_part(k, F.lit("|"), F.lit(1)) == F.split_part(k, F.lit("|"), F.lit(2))), lambda k: F.split_part(k, F.lit("|"), F.lit(1))))
    pairs = counts.select("n", names.alias("d")).select("n", "d", F.explode("d").alias("a")).select("n", "a", F.explode(F.filter("d", lambda x: x > F.col("a"))).alias("b"))
    of = lambda x, y: F.coalesce(F.element_at("n", F.concat_ws("|", x, y)), F.lit(0))
    shared = of("a", "b")
    return pairs.select("a", "b", r6(shared / F.greatest(of("a", "a") + of("b", "b") - shared, F.lit(1))).alias("jaccard"))


@query
def lexicon_gate(spark, d):
    s = _style(spark, d)
    return s.groupBy("domain").agg(F.count("*").alias("n_style"), F.count_if(F.col("term").isin(*config.BANNED_TERMS)).alias("n_banned")).withColumn("pass", (F.col("n_style") >= 30) & (F.col("n_banned") == 0))


@query
def lexicon_keep_first(spark, d):
    t = tab(spark, d, "benchmark").select("item_id", T.tokens("text").alias("toks")).select("item_id", F.posexplode_outer(T.ngrams("toks", 2)).alias("pos", "term")).where("term is not null")
    w = Window.partitionBy("term").orderBy("item_id", "pos")
    return t.withColumn("k", F.row_number().over(w)).where("k = 1").select("item_id", "pos", "term")


@query
def term_score_flags(spark, d):
    stats = mining.mined(docs(spark, d), P).select("domain", "term", r6("z").alias("z"))
    lex = mining.top_by(stats, "z", 50).select("domain", "term")
    s = scoring.term_scores(stats, lex, "en", "fr")
    return s.orderBy(F.desc("flagged"), F.desc("distinctiveness"), "familiarity", "term").limit(200)


@query
def term_strategy_class(spark, d):
    stats = mining.mined(docs(spark, d), P).where("domain = 'fr'").select("term", r6("delta").alias("delta"))
    k = stats.withColumns({"native": r6(scoring.native_score(F.lit(False), F.length("term") <= 2, F.col("delta"), F.lit(False))), "symbols": r6(T.symbol_ratio("term"))})
    kind = scoring.strategy_class(F.col("native"), F.lit(0.0), F.col("term").rlike("tion$"), F.col("symbols"))
    return k.select("term", "native", "symbols", kind.alias("kind"))


@query
def strategy_penalty(spark, d):
    k = term_strategy_class(spark, d)
    hit = mining.doc_terms(docs(spark, d)).where("domain = 'fr'").join(k, "term")
    return hit.groupBy("doc_id").agg(r6(scoring.strategy_penalty(F.col("kind"), F.lit(False))).alias("penalty"))


@query
def analog_jaccard_topk(spark, d):
    t = _trigrams(spark, d).select("term").distinct()
    return scoring.analog_pairs(t, t, 0.2, 5).withColumn("score", r6("score"))


@query
def analog_cosine_topk(spark, d):
    """Nearest vectors by cosine; the queries are all rows whose id is divisible by 50."""
    v = tab(spark, d, "embeddings")
    return scoring.cosine_top_k(v.where("vec_id % 50 = 0"), v, 5)


@query
def evidence_snippets(spark, d):
    probes = _trigrams(spark, d).select("term").distinct()
    toks = docs(spark, d).select("doc_id", "lang", T.tokens("text").alias("toks"))
    grams = toks.select("doc_id", "lang", F.explode_outer(F.array_distinct(T.ngrams("toks", 3))).alias("term"))
    found = grams.join(probes, "term").select("doc_id", "lang", "term")
    # The phrase is verified in the text only for the documents that have its tokens.
    body = docs(spark, d).select("doc_id", F.lower(T.collapse("text")).alias("body"))
    hit = found.join(body, "doc_id").where(F.contains("body", F.col("term")))
    w = Window.partitionBy("lang", "term").orderBy("doc_id")
    top = hit.withColumn("k", F.row_number().over(w)).where("k <= 2")
    return top.select("lang", "term", "doc_id", "k")


@query
def pair_jaccard(spark, d):
    p = scoring.turn_pairs(tab(spark, d, "conversations"))
    return p.select("conv_id", "turn", r6(T.jaccard(T.token_set("source"), T.token_set("candidate"))).alias("jaccard"))


@query
def pair_rouge_l(spark, d):
    p = scoring.turn_pairs(tab(spark, d, "conversations"))
    return p.select("conv_id", "turn", r6(scoring.rouge_l("source", "candidate")).alias("rouge_l"))


def _evidence(spark, d):
    lex = mining.mined(docs(spark, d), P).where("domain = 'en' and z > 0").select("term", r6("z").alias("z"))
    p = scoring.turn_pairs(tab(spark, d, "conversations"))
    toks = p.select("conv_id", "turn", T.tokens("candidate").alias("toks"))
    terms = toks.select("conv_id", "turn", F.explode_outer(T.ngram_set("toks")).alias("term"))
    return p, terms.join(lex, "term").withColumn("n", T.ngram_len("term"))


@query
def lex_evidence(spark, d):
    p, hit = _evidence(spark, d)
    e = hit.groupBy("conv_id", "turn").agg(r6(scoring.evidence_score(F.col("z"), F.col("n"))).alias("evidence"), F.count("*").alias("hits"))
    return p.select("conv_id", "turn").join(e, ["conv_id", "turn"], "left").na.fill(0)


@query
def rerank_best(spark, d):
    """Of a conversation's candidates the one of highest reward; below the floor none counts."""
    p, hit = _evidence(spark, d)
    e = hit.groupBy("conv_id", "turn").agg(scoring.evidence_score(F.col("z"), F.col("n")).alias("ev"))
    sem = r6(T.jaccard(T.token_set("source"), T.token_set("candidate")))
    s = p.join(e, ["conv_id", "turn"], "left").select("conv_id", "turn", sem.alias("semantic"), r6(F.coalesce("ev", F.lit(0.0))).alias("evidence"))
    total = r6(scoring.reward(F.lit(0.5), F.col("evidence"), F.col("semantic"), F.col("semantic"), F.lit(0.0), config.Reward(semantic_floor=0.05)))
    w = Window.partitionBy("conv_id").orderBy(F.desc("total"), "turn")
    return s.withColumn("total", total).withColumn("k", F.row_number().over(w)).where("k = 1").select("conv_id", "turn", "semantic", "evidence", "total", (F.col("total") > -1e8).alias("eligible"))


@query
def autotune_grid(spark, d):
    """Mean score and fallback rate of each setting of floor and weights."""
    s = pair_jaccard(spark, d)
    grid = spark.createDataFrame([(f, w) for f in (0.0, 0.05, 0.1, 0.15) for w in (0.2, 0.35, 0.5, 0.8)], "min_sem double, weight double")
    x = s.join(F.broadcast(grid), how="cross")
    return x.groupBy("min_sem", "weight").agg(r6(F.avg(F.col("jaccard") * F.col("weight"))).alias("score"), r6(F.avg((F.col("jaccard") < F.col("min_sem")).cast("double"))).alias("fallback"))


@query
def eval_rates(spark, d):
    """Rates and medians over turns by role."""
    c = tab(spark, d, "conversations").withColumn("n", F.size(T.tokens("text")))
    return c.groupBy("role").agg(F.count("*").alias("turns"), r6(F.avg((F.col("n") < 20).cast("double"))).alias("short_rate"), r6(F.avg("n")).alias("avg_tokens"), r6(F.median("n")).alias("median_tokens"))


@query
def eval_diversity(spark, d):
    """Mean similarity of the pairs of assistant turns within a conversation."""
    c = tab(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.token_set("text").alias("s"))
    a, b = c.select("conv_id", F.col("turn").alias("i"), F.col("s").alias("x")), c.select("conv_id", F.col("turn").alias("j"), F.col("s").alias("y"))
    return a.join(b, "conv_id").where("i < j").groupBy("conv_id").agg(r6(F.avg(r6(T.jaccard("x", "y")))).alias("similarity"), F.count("*").alias("pairs"))


@query
def eval_route_matrix(spark, d):
    e = tab(spark, d, "events")
    return e.groupBy("event_type", (F.col("user_id") % 4).alias("route")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.avg("value"), 4).alias("avg_value"))


@query
def eval_failures_topk(spark, d):
    s = pair_jaccard(spark, d)
    return s.orderBy("jaccard", "conv_id", "turn").limit(10)


@query
def eval_leak_flags(spark, d):
    c = tab(spark, d, "conversations")
    return c.groupBy("role").agg(F.count_if(F.lower("text").rlike(r"as an ai|system prompt|ignore previous")).alias("leaks"), F.count_if(F.lower("text").rlike(r"updatedgpt|native\s*=")).alias("debug"), F.count("*").alias("n"))


@query
def source_ambiguity(spark, d):
    """Domain probabilities from hint words; arg max, gap to the second and the reason of doubt."""
    hints = {"en": ("the ", " of "), "fr": (" de ", " la "), "de": ("der ", "ein"), "es": ("ción", " el ")}
    c = docs(spark, d)
    total = sum((T.keyword_hits("text", w) for w in hints.values()), F.lit(0))
    # The arg max of four numbers is found in the row.
    order = F.array_sort(F.array(*[F.struct((-r6(F.when(total > 0, T.keyword_hits("text", w) / total).otherwise(F.lit(0.25)))).alias("m"), F.lit(k).alias("domain")) for k, w in hints.items()]))
    r = c.select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("words"), order.alias("x")).select("doc_id", "words", F.get("x", F.lit(0))["domain"].alias("domain"), (-F.get("x", F.lit(0))["m"]).alias("p"), (-F.get("x", F.lit(1))["m"]).alias("p2"))
    gap = r6(F.col("p") - F.col("p2"))
    reason = F.when(F.col("words") < 18, "too_short").when(F.col("p") < 0.55, "low_confidence").when(gap < 0.1, "small_gap").otherwise("ok")
    return r.select("doc_id", "domain", F.col("p").alias("confidence"), gap.alias("gap"), reason.alias("reason"))


@query
def source_warning(spark, d):
    s = source_ambiguity(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id")
    return s.select("doc_id", ((F.col("domain") != F.col("lang")) & (F.col("confidence") >= 0.65)).alias("warning"))


@query
def confidence_labels(spark, d):
    s = source_ambiguity(spark, d)
    return s.groupBy(F.when(F.col("confidence") >= 0.75, "High").when(F.col("confidence") >= 0.55, "Medium").otherwise("Low").alias("label")).agg(F.count("*").alias("n"))


@query
def clf_stratified_split(spark, d):
    return corpus.stratified_split(docs(spark, d).select("doc_id", "lang"), "lang", "doc_id")


@query
def clf_metrics(spark, d):
    pred = source_ambiguity(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id")
    m = scoring.class_metrics(pred, "lang", "domain")
    return m.select("label", "support", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query
def clf_confusion(spark, d):
    pred = source_ambiguity(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id")
    return scoring.confusion(pred, "lang", "domain").withColumnRenamed("count", "n")


@query
def resume_antijoin(spark, d):
    return corpus.unseen(docs(spark, d), tab(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query
def merge_keep_first(spark, d):
    c = docs(spark, d).select(F.md5("text").alias("key"), "doc_id")
    return corpus.merge_keep_first([c.where("doc_id % 2 = 1"), c.where("doc_id % 2 = 0")], "key", "doc_id").select("key", "doc_id", "file_idx")


@query
def sibling_reassign(spark, d):
    c = corpus.reassign(docs(spark, d), (F.col("lang") == "fr") & T.contains_any("text", ["tion"]), "lang", "fr_tion")
    return c.groupBy("lang").agg(F.count("*").alias("n"))


@query
def duplicate_counts(spark, d):
    return docs(spark, d).groupBy("source").agg((F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("duplicates"))


@query
def bandit_arms(spark, d):
    a = scoring.arm_stats(tab(spark, d, "events"))
    return a.select("route", "action", "pulls", r6("total").alias("total"), r6("mean").alias("mean"))


@query
def bandit_choice(spark, d):
    a = scoring.arm_stats(tab(spark, d, "events")).withColumn("mean", r6("mean"))
    w = Window.partitionBy("route").orderBy(F.desc("mean"), "action")
    return a.withColumn("k", F.row_number().over(w)).where("k = 1").select("route", "action", "mean")


@query
def bandit_running(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = tab(spark, d, "events")
    return e.select("event_id", F.count("*").over(w).alias("pulls"), F.round(F.sum("value").over(w), 3).alias("total"))


@query
def ttl_cache_hits(spark, d):
    return state.ttl_hits(tab(spark, d, "events"), 86_400)


@query
def feedback_upsert(spark, d):
    return corpus.upsert_latest(tab(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query
def stagnation_islands(spark, d):
    """Longest run of events without a high value, by user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = tab(spark, d, "events").withColumn("hi", (F.col("value") > 60).cast("int"))
    g = e.withColumn("g", F.sum("hi").over(w)).where("hi = 0").groupBy("user_id", "g").agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.max("n").alias("longest"))


@query
def time_slices(spark, d):
    e = tab(spark, d, "events").groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd").alias("slice"), "event_type", "n")


@query
def page_diagnostics(spark, d):
    """Preview and marks of a firewall of every page, taken for the answer of a service that gives JSON, and for one that gives pages."""
    p = tab(spark, d, "pages")
    low, body = F.lower("html"), T.preview("html")
    return p.select("page_id", F.length(body).cast("long").alias("n_preview"), low.startswith("<!doctype html").alias("is_html"), low.contains("nav").alias("has_nav"), evaluation.waf_block(body, F.lit("application/json")).alias("waf"), evaluation.waf_block(body, F.lit("text/html; charset=utf-8")).alias("waf_for_json"))


@query
def inverted_index_rebuild(spark, d):
    w = docs(spark, d).select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("position", "token"))
    return corpus.rebuild_from_index(w).select("doc_id", F.md5("text").alias("text_md5"))


@query
def json_props(spark, d):
    e = tab(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.countDistinct("k").alias("kinds"))


@query
def cache_keys(spark, d):
    return docs(spark, d).select("doc_id", T.cache_key("doc_id", "lang", F.lit("en"), F.lit(4)).alias("key"))


@query
def temperature_schedule(spark, d):
    """The temperature of every turn as a step of its conversation."""
    c = tab(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("total"))
    g = c.select("conv_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("step"))
    return g.select("conv_id", "total", "step", T.temperature("step", "total").alias("temperature"))


@query
def policy_guard(spark, d):
    c = tab(spark, d, "conversations")
    low = F.lower("text")
    banned, wanted = low.contains("this is"), low.contains("th")
    return c.groupBy(F.when(banned, "banned_phrase").when(~wanted, "no_marker").otherwise("ok").alias("verdict")).agg(F.count("*").alias("n"))


@query
def token_hits_by_nation(spark, d):
    """Configuration dimensions joined to facts, filters reaching the scans."""
    li = tab(spark, d, "lineitem").where("l_quantity > 30").select("l_suppkey", "l_extendedprice", "l_discount")
    s, n = tab(spark, d, "supplier"), tab(spark, d, "nation")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
