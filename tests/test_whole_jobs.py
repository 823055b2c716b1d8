"""Queries over their whole inputs, against brute force."""

import math

from termforge.plans import registry


def run(spark, d, name):
    return registry.queries()[name](spark, str(d)).collect()


def write(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")


def test_cosine_queries_are_every_fiftieth_row(spark, tmp_path):
    vectors = {i: [math.sin(i * 7 + j) for j in range(6)] for i in range(230)}
    vectors[151], vectors[3], vectors[7] = list(vectors[150]), list(vectors[150]), [2 * x for x in vectors[150]]
    rows = [*vectors.items(), (400, None), (450, [0.0] * 6), (500, [1.0, None]), (None, [1.0] * 6)]
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    want = []
    for p in range(0, 230, 50):
        best = sorted((-round(cosine(e, vectors[p]), 6), i) for i, e in vectors.items() if i != p)[:5]
        want += [(p, i, -s, k) for k, (s, i) in enumerate(best, 1)]
    got = run(spark, tmp_path, "analog_cosine_topk")
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[3])) == want


def test_every_trigram_is_term_and_candidate(spark, tmp_path):
    texts = {1: "one two three four two one", 3: "two three four five", 2: "six one two three", 4: "six seven eight", 5: None}
    write(spark, tmp_path, "benchmark", list(texts.items()), "item_id long, text string")
    terms = sorted({" ".join(w[i : i + 3]) for t in texts.values() if t for w in [t.split()] for i in range(len(w) - 2)})
    want = set()
    for a in terms:
        x = set(a.split())
        scores = sorted((-len(x & set(b.split())) / len(x | set(b.split())), b) for b in terms if b != a)
        want |= {(a, b, round(-s, 6), k) for k, (s, b) in enumerate([r for r in scores if r[0] <= -0.2][:5], 1)}
    assert set(map(tuple, run(spark, tmp_path, "analog_jaccard_topk"))) == want


def corpus(spark, d):
    """Twelve documents of a and twelve of b, with a phrase of its own each."""
    texts = [("en", f"sparse graph laplacian with band gap w{i} x(y)") for i in range(12)] + [("fr", f"propose  sparse matrix, band  gap graph and laplacian w{i}") for i in range(12)] + [("en", None), ("fr", f"other words here for the run-1 debug run")]
    texts += [("de", f"filler number{i}") for i in range(20)]
    write(spark, d, "documents", [(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    return texts


def test_phrases_are_mined_and_filtered(spark, tmp_path):
    corpus(spark, tmp_path)
    got = {(r.domain, r.term): r.c for r in run(spark, tmp_path, "mine_ctfidf")}
    assert got["en", "sparse graph laplacian"] == got["en", "graph laplacian"] == got["en", "band gap"] == got["fr", "sparse matrix"] == 12
    assert ("fr", "band gap") not in got and ("fr", "graph laplacian") not in got and ("en", "laplacian with") not in got
    assert not {"with", "and", "propose", "x"} & {t for _, t in got}


def test_terms_of_a_text_are_its_tokens_and_adjacent_ngrams(spark):
    from termforge.operators import mining
    from termforge.functions import text as T
    from pyspark.sql import functions as F

    texts = ["se(3)-net k-space b-c (d) e", "été la réaction  de x y z", "use a b using c d e", "", "123", "a\nb c model d", "a for b c(and)d e f"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    phrases = mining.adjacent_ngrams(docs).select("doc_id", F.col("phrase").alias("term"))
    want = docs.select("doc_id", F.explode(T.token_set("text")).alias("term")).union(phrases)
    keep = T.valid_phrase("term", True)
    assert set(mining.doc_terms(docs).select("doc_id", "term").where(keep).collect()) == set(want.where(keep).collect())
    assert mining.doc_terms(docs).where("doc_id = 2").count() == len({"use", "a", "b", "using", "c", "d", "e", "a b", "c d", "d e", "c d e"})


def test_evidence_weighs_phrases_by_length(spark, tmp_path):
    corpus(spark, tmp_path)
    write(spark, tmp_path, "conversations", [(1, 0, "user", "q"), (1, 1, "assistant", "graph laplacian"), (2, 0, "user", "q"), (2, 1, "assistant", "nothing")], "conv_id long, turn int, role string, text string")
    z = {r.term: r.z for r in run(spark, tmp_path, "mine_dirichlet_logodds") if r.domain == "en"}
    got = {r.conv_id: (r.evidence, r.hits) for r in run(spark, tmp_path, "lex_evidence")}
    hits = [(t, w) for t, w in (("graph", 0.25), ("laplacian", 0.25), ("graph laplacian", 0.7)) if z.get(t, 0) > 0]
    assert ("graph laplacian", 0.7) in hits
    assert got[1] == (round(min(2.0, sum(min(6.0, z[t]) * w for t, w in hits)), 6), len(hits)) and got[2] == (0.0, 0)


def test_statistics_and_lexicons_are_not_cut_at_twenty(spark, tmp_path):
    words = [f"{a}{b}word" for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr"][:320]
    rows = [(i, ". ".join(words), lang) for i, lang in enumerate(["en"] * 6 + ["fr"] * 3)] + [(100 + i, "filler", "de") for i in range(20)]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    got = run(spark, tmp_path, "mine_dirichlet_logodds")
    assert {(r.domain, r.term) for r in got} == {(d, w) for d in ("en", "fr", "de") for w in words}
    assert sorted(r["rank"] for r in got if r.domain == "fr") == list(range(1, 321))
    lexicon = [r.pos for r in run(spark, tmp_path, "mine_simple_lexicon") if r.domain == "en"]
    assert sorted(lexicon) == list(range(1, 201))
    assert {r.domain: r.n_style for r in run(spark, tmp_path, "lexicon_gate")} == {"en": 300, "fr": 300, "de": 300}


def nearest(term, lexicon):
    """The lexicon term of highest token Jaccard, .15 more for a shared anchor, by all pairs."""
    from termforge.functions import terms as S

    x, found = set(term.split()), []
    for other in lexicon:
        y = set(other.split())
        if x & y:
            found.append((-round(len(x & y) / len(x | y) + (0.15 if x & y & set(S.ANCHORS) else 0), 9), other))
    s, other = min(found, default=(0.0, None))
    return (other, min(1.0, -s)) if s <= -0.25 else (None, 0.0)


def test_neighbours_of_strategies_are_those_of_all_pairs(spark):
    import random

    from termforge.operators import strategy

    r = random.Random(5)
    words = ["energy", "graph", *"abcdefghijk"]
    phrase = lambda: " ".join(r.choices(words, k=r.choice([1, 2, 2, 3, 3, 5, 6])))
    lex, terms = {(d, phrase()) for d in "xy" for _ in range(60)}, {(d, phrase()) for d in "xyz" for _ in range(120)}
    got = strategy.strategies(spark.createDataFrame(sorted(terms), "domain string, term string"), spark.createDataFrame(sorted(lex), "domain string, term string"), spark.createDataFrame([], "domain string, term string, delta double")).collect()
    assert {(g.domain, g.term) for g in got} == terms and len(got) == len(terms)
    for g in got:
        want = (None, 0.0) if (g.domain, g.term) in lex else nearest(g.term, [t for d, t in lex if d == g.domain])
        assert (g.neighbor, g.neighbor_score) == want, g


def test_every_mined_term_has_a_strategy_in_every_domain(spark, tmp_path):
    """More terms a domain than fifty, all of them candidates."""
    texts = [("en", [f"sparse w{chr(97 + i)}{chr(97 + j)}en" for i in range(9) for j in range(9)])] * 6 + [("fr", [f"sparse w{chr(97 + i)}{chr(97 + j)}fr" for i in range(9) for j in range(9)])] * 6
    rows = [(i, ". ".join(t), lang) for i, (lang, t) in enumerate(texts)] + [(100 + i, "filler", "de") for i in range(20)]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    got = run(spark, tmp_path, "strategy_all_domains")
    z = {(r.domain, r.term): r.z for r in run(spark, tmp_path, "mine_dirichlet_logodds")}
    assert len(got) == len({(g.domain, g.term) for g in got}) == len({t for _, t in z}) * 3 > 900
    for g in got:
        own = z[g.domain, g.term] > 0
        lex = [t for (d, t), s in z.items() if d == g.domain and s > 0]
        assert (g.native == 1.0) == own
        want = (None, 0.0) if g.native >= 0.6 else nearest(g.term, lex)
        assert (g.neighbor, g.neighbor_score) == (want[0], round(want[1], 6)), g
