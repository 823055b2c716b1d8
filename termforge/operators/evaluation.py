"""Evaluation of logged candidates: rates, noise, diversity, routes, failure lists, and the search for settings.

A log has a row for each case: case_id, src, tgt, ok, status, used_fallback, warned, terms (array of strings),
candidates (array of (text, domain, semantic, lex, copy, penalty)) and best, one of the candidates.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import terms as S, text as T

# The four grids, in this order, and the limits of a reward that comes from the lexicon alone.
GRID = ((0.70, 0.75, 0.80, 0.85), (0.0, 0.1, 0.25, 0.5), (0.0, 0.1, 0.25), (0.5, 1.0, 2.0))
LEX_HACK, SEMANTIC_HACK = 1.0, 0.75
CANDIDATE = "struct<text:string,domain:double,semantic:double,lex:double,copy:double,penalty:double>"


def usable(log: DataFrame) -> DataFrame:
    """Cases that ended well; absent scores count as 0."""
    zero = lambda c: F.coalesce(F.col(f"best.{c}"), F.lit(0.0))
    fine = F.coalesce(F.col("ok") & (F.col("status") == 200), F.lit(False))
    return log.where(fine).select("*", *[zero(c).alias(c) for c in ("domain", "semantic", "lex", "copy")])


def hack(lex, semantic) -> Column:
    return (T.col(lex) > LEX_HACK) & (T.col(semantic) < SEMANTIC_HACK)


def case_similarity(log: DataFrame) -> DataFrame:
    """(case_id, similarity): mean Jaccard of the pairs of a case's candidates, within the row."""
    sets = log.select("case_id", F.transform(F.filter("candidates", lambda c: c["text"] != ""), lambda c: T.token_set(c["text"])).alias("s")).where(F.size("s") > 1)
    # One level: pairs (i, j) are numbers, so no lambda lies within another.
    n = F.size("s")
    pairs = F.filter(F.transform(F.sequence(F.lit(0), n * n - 1), lambda k: F.struct((k / n).cast("int").alias("i"), (k % n).alias("j"))), lambda p: p["i"] < p["j"])
    alike = F.transform(pairs, lambda p: T.jaccard(F.get("s", p["i"]), F.get("s", p["j"])))
    return sets.select("case_id", F.explode(alike).alias("x")).groupBy("case_id").agg(F.avg("x").alias("similarity"))


def summary(log: DataFrame) -> DataFrame:
    """One row: rates, means and medians, term noise, diversity and the flags of failure modes."""
    ok = usable(log)
    noise = lambda f: F.sum(F.size(F.filter("terms", f)))
    names = ("semantic", "copy", "domain", "lex")
    one = ok.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.col("used_fallback").cast("double")), F.lit(0.0)).alias("fallback_rate"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_avg") for c in names],
        *[F.coalesce(F.median(c), F.lit(0.0)).alias(f"{c}_median") for c in names],
        F.coalesce(F.avg(S.contains_leak("best.text").cast("double")), F.lit(0.0)).alias("leak_rate"),
        F.count_if(hack("lex", "semantic")).alias("hacks"),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n_terms"),
        F.coalesce(noise(lambda t: S.stopword_only(t)), F.lit(0)).alias("n_stop"),
        F.coalesce(noise(lambda t: S.debug_term(t)), F.lit(0)).alias("n_debug"),
    )
    alike = case_similarity(ok).agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("similarity"))
    out = one.join(alike, how="cross")  # one row each
    share = lambda c: F.when(F.col("n_terms") > 0, F.col(c) / F.col("n_terms")).otherwise(F.lit(0.0))
    flag = lambda c: F.when(c, "YES").otherwise("NO")
    return out.withColumns({
        "terms_avg": F.when(F.col("n") > 0, F.col("n_terms") / F.col("n")).otherwise(F.lit(0.0)), "stop_share": share("n_stop"), "debug_share": share("n_debug"),
        "flag_hacks": flag(F.col("hacks") > 0), "flag_leaks": flag(F.col("leak_rate") > 0), "flag_noise": flag(F.col("n_stop") + F.col("n_debug") > 0), "flag_alike": flag(F.col("similarity") > 0.7),
    })


def routes(log: DataFrame) -> DataFrame:
    """(src, tgt): cases, usable ones, rates and means over these, and the flags of a bad route."""
    ok = F.coalesce(F.col("ok") & (F.col("status") == 200), F.lit(False))
    mean = lambda c: F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0))
    g = log.groupBy("src", "tgt").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"),
        mean(F.col("used_fallback").cast("double")).alias("fallback"), mean(F.col("warned").cast("double")).alias("warned"),
        mean(F.coalesce("best.semantic", F.lit(0.0))).alias("semantic"), mean(F.coalesce("best.copy", F.lit(0.0))).alias("copy"),
    )
    return g.withColumn("problems", F.concat_ws(",", F.when(F.col("fallback") >= 0.5, "fallback"), F.when(F.col("copy") >= 0.9, "copy"), F.when(F.col("semantic") < 0.55, "semantic")))


def failures(log: DataFrame, k: int = 5) -> DataFrame:
    """(list, rank, case_id): the worst cases by five measures; ties by case_id."""
    ok = usable(log)
    noisy = ok.where(F.size("terms") > 0).select("case_id", (F.size(F.filter("terms", lambda t: S.stopword_only(t))) + F.size(F.filter("terms", lambda t: S.debug_term(t)))).alias("bad"), F.size("terms").alias("m")).select("case_id", (F.col("bad") / F.col("m")).alias("x"))
    lists = {
        "low_semantic": ok.select("case_id", F.col("semantic").alias("x")),
        "high_copy": ok.select("case_id", (-F.col("copy")).alias("x")),
        "low_diversity": case_similarity(ok).select("case_id", (-F.col("similarity")).alias("x")),
        "noise": noisy.withColumn("x", -F.col("x")),
        "hacks": ok.where(hack("lex", "semantic")).select("case_id", F.lit(0.0).alias("x")),
    }
    out = None
    for name, rows in lists.items():
        top = rows.orderBy("x", "case_id").limit(k).agg(F.array_sort(F.collect_list(F.struct("x", "case_id"))).alias("a"))
        one = top.select(F.lit(name).alias("list"), F.posexplode("a").alias("rank", "r")).select("list", (F.col("rank") + 1).cast("int").alias("rank"), "r.case_id")
        out = one if out is None else out.unionByName(one)
    return out


def simulated_pick(min_sem: Column, lex_weight: Column, copy_weight: Column, lex_clamp: Column) -> Column:
    """(pick, by_filter): the eligible candidate of highest score, else that of highest meaning; ties to the first."""
    def ranked(c, i):
        score = c["domain"] + lex_weight * F.least(c["lex"], lex_clamp) - copy_weight * c["copy"] - c["penalty"]
        fine = c["semantic"] >= min_sem
        return F.struct(fine.alias("fine"), F.when(fine, score).otherwise(c["semantic"]).alias("score"), (-i).alias("first"), c.alias("pick"))

    return F.array_max(F.transform("candidates", ranked))


def grid(spark: SparkSession) -> DataFrame:
    rows = [(i, *map(float, x)) for i, x in enumerate(product(*GRID))]
    return spark.createDataFrame(rows, "setting int, min_sem double, lex_weight double, copy_weight double, lex_clamp double")


def _objective() -> Column:
    return F.col("domain") - 1.6 * F.col("hacks") - 1.1 * F.col("leaks") - 0.8 * F.col("fallbacks") - 0.2 * F.col("copy")


def _metrics(picks: DataFrame, *by: str) -> DataFrame:
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    m = picks.groupBy(*by).agg(
        mean(F.col("pick.domain")).alias("domain"), mean(F.col("pick.semantic")).alias("semantic"), mean(F.col("pick.lex")).alias("lex"), mean(F.col("pick.copy")).alias("copy"),
        mean(S.contains_leak("pick.text").cast("double")).alias("leaks"), mean(hack("pick.lex", "pick.semantic").cast("double")).alias("hacks"), mean(F.col("by_filter").cast("double")).alias("fallbacks"),
    )
    return m.withColumn("objective", _objective())


def autotune(log: DataFrame) -> DataFrame:
    """Metrics of every setting of the grid (144 rows, broadcast), and whether it is the best and beats the logged picks.

    A case's pick is found within its row, so only partial means are shuffled.
    """
    ok = usable(log).select("case_id", "candidates", "best")
    base = _metrics(ok.select(F.col("best").alias("pick"), F.lit(False).alias("by_filter")))
    settings = grid(log.sparkSession)
    picked = ok.join(F.broadcast(settings), how="cross").withColumn("r", simulated_pick(*map(F.col, ("min_sem", "lex_weight", "copy_weight", "lex_clamp"))))
    m = _metrics(picked.select("setting", F.col("r.pick").alias("pick"), F.coalesce(~F.col("r.fine"), F.lit(True)).alias("by_filter")), "setting").join(F.broadcast(settings), "setting")
    best = m.agg(F.max(F.struct(F.round("objective", 9).alias("o"), (-F.col("setting")).alias("s"))).alias("b")).select((-F.col("b.s")).alias("best_setting"))
    return m.join(F.broadcast(best), how="cross").join(F.broadcast(base.select(F.col("objective").alias("baseline"))), how="cross").withColumn("is_best", (F.col("setting") == F.col("best_setting")) & (F.col("objective") > F.col("baseline"))).drop("best_setting")


def best_per_text(candidates: DataFrame, k: int) -> DataFrame:
    """(case_id, rank, text, score): each text's best score, then the k best texts of a case; ties by text."""
    best = candidates.groupBy("case_id", "text").agg(F.max("score").alias("score"))
    top = best.groupBy("case_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "text"))), 1, k).alias("a"))
    return top.select("case_id", F.posexplode("a").alias("rank", "x")).select("case_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.text", (-F.col("x.s")).alias("score"))


# What a diagnosis says, and words of a page that asks for a login.
CONCLUSIONS = (
    "Likely needs auth",
    "Likely WAF block",
    "Likely platform-side block or API access policy",
    "Endpoint reachable; likely client header/flow issue in failing mode",
    "Likely endpoint/param change (non-JSON API behavior)",
    "Inconclusive; check network/proxy and endpoint documentation",
)
AUTH_HINTS = ("unauthorized", "forbidden", "login", "authentication")
WAF_BODY = ("attention required", "cloudflare", "captcha", "challenge")


def waf_block(body, content_type, cf_ray: Column | None = None, cf_cache: Column | None = None, server: Column | None = None) -> Column:
    """Whether a response looks like a firewall's: its headers, words of its body, or HTML where JSON was asked for."""
    none = F.lit(None).cast("string")
    headers = (none if cf_ray is None else cf_ray).isNotNull() | (none if cf_cache is None else cf_cache).isNotNull() | F.coalesce(F.lower(none if server is None else server).contains("cloudflare"), F.lit(False))
    return headers | T.contains_any(body, WAF_BODY) | F.coalesce(F.lower(T.col(content_type)).contains("text/html"), F.lit(False))


def diagnosis(results: DataFrame, *by: str) -> DataFrame:
    """A row for each group: what connector results (status, waf, body, content_type, warm_up, cookies) say.

    In this order: a warm-up that got 200 and cookies, a 403 with a firewall's marks, a 401 or a page that asks for a
    login without them, a 403 without any 200, a 200, HTML.  Columns that are missing count as empty.
    """
    default = {"waf": F.lit(False), "body": F.lit(""), "content_type": F.lit(""), "warm_up": F.lit(False), "cookies": F.lit(0)}
    r = results.withColumns({c: v for c, v in default.items() if c not in results.columns})
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    waf = F.coalesce("waf", F.lit(False))
    seen = r.groupBy(*by).agg(
        has(F.col("status") == 200).alias("ok"),
        has(F.col("status") == 403).alias("forbidden"),
        has(F.col("status") == 401).alias("unauthorized"),
        has(waf).alias("waf"),
        has(T.contains_any("body", AUTH_HINTS) & ~waf).alias("asks_login"),
        has(F.col("warm_up") & (F.col("status") == 200) & (F.col("cookies") > 0)).alias("warm"),
        has(F.lower("content_type").contains("text/html")).alias("html"),
    )
    auth, firewall, policy, reachable, changed, unclear = map(F.lit, CONCLUSIONS)
    ok, forbidden = F.col("ok"), F.col("forbidden")
    said = F.when(F.col("warm"), auth).when(forbidden & F.col("waf"), firewall).when(F.col("unauthorized") | F.col("asks_login"), auth).when(forbidden & ~ok, policy).when(ok, reachable).when(F.col("html"), changed).otherwise(unclear)
    return seen.withColumn("conclusion", said)


def accuracy_and_macro_f1(pred: DataFrame, label: str = "label", guess: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """(one row of n, accuracy and macro_f1; a row for each label that is true or predicted)."""
    truth = pred.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(label) == F.col(guess)).alias("tp"))
    said = pred.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("said"))
    j = truth.join(said, "label", "full").na.fill(0, ["support", "tp", "said"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = j.select("label", "support", "tp", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return per.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")), per.drop("tp")
