import math

import pytest
from pyspark.sql import functions as F

from termforge import config
from termforge.functions import terms as S, text as T
from termforge.operators import classifier, corpus, evaluation, mining, scoring, strategy
from termforge.plans import registry
from termforge.sources import readers
from termforge.streaming import state


def values(df, c="x"):
    return [r[c] for r in df.select(c).collect()]


def test_sanitize_and_predicates(spark):
    d = spark.createDataFrame([("updatedgpt_noself_v2 proposes an approach (native=0.00) with ( domain-specific concept ).",), (None,)], "t string")
    assert values(d.select(T.sanitize("t").alias("x"))) == ["proposes an approach with .", None]
    e = spark.createDataFrame([("abc",), ("éèà",), ("12",)], "t string")
    assert values(e.select(T.english_like("t").alias("x"))) == [True, False, False]


def test_jaccard_is_symmetric_and_zero_on_empty(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert values(d.select(T.jaccard("a", "b").alias("x"))) == values(d.select(T.jaccard("b", "a").alias("x"))) == [1 / 3, 0.0]


def test_window_around(spark):
    d = spark.createDataFrame([("one two energy landscape three", "energy landscape"), ("no hit here", "zzz")], "t string, p string")
    assert values(d.select(T.window_around("t", "p").alias("x"))) == ["one two energy landscape three", "no hit here"]


def test_term_scores_flag(spark):
    stats = spark.createDataFrame([("CSM", "graph laplacian", 3.2), ("PM", "graph laplacian", -1.2), ("PM", "band gap", 2.0), ("CSM", "band gap", 0.4)], "domain string, term string, z double")
    lex = spark.createDataFrame([("CSM", "graph laplacian")], "domain string, term string")
    got = {r["term"]: r for r in scoring.term_scores(stats, lex, "CSM", "PM").collect()}
    assert got["graph laplacian"]["flagged"] and "low_tgt_familiarity" in got["graph laplacian"]["reason"]
    assert not got["band gap"]["flagged"]


def test_log_odds_antisymmetric_for_two_domains(spark):
    grid = spark.createDataFrame([("a", "x", 10, 3), ("b", "x", 10, 7), ("a", "y", 8, 6), ("b", "y", 8, 2)], "domain string, term string, total long, c long")
    z = {(r["domain"], r["term"]): r["z"] for r in mining.log_odds(grid).collect()}
    assert math.isclose(z["a", "x"], -z["b", "x"], rel_tol=1e-9)


def test_rouge_l_equals_the_table_method(spark):
    pairs = [("a b c d e", "b d e x"), ("", "a"), ("same words here", "same words here"), ("a a b", "b a a")]

    def slow(x, y):
        x, y = x.split(), y.split()
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        n = t[-1][-1]
        return 2 * n / (len(x) + len(y)) if n else 0.0

    got = values(spark.createDataFrame(pairs, "a string, b string").select(scoring.rouge_l("a", "b").alias("x")))
    assert got == pytest.approx([slow(*p) for p in pairs])


def test_overlap_suppression_keeps_the_longer_span(spark):
    d = spark.createDataFrame([(1, "sparse attention", 0, 16, "noun_chunk", 0), (1, "attention", 7, 16, "noun_chunk", 0), (1, "k-space", 20, 27, "entity", 1)], "doc_id long, term string, start long, end long, source string, technical int")
    assert sorted(values(strategy.suppress_overlaps(d), "term")) == ["k-space", "sparse attention"]


def test_penalty_is_capped(spark):
    d = spark.createDataFrame([("unique",)] * 9, "k string")
    assert values(d.agg(scoring.strategy_penalty(F.col("k"), F.lit(False)).alias("x"))) == [0.35]


def test_ttl_hit_does_not_renew(spark):
    d = spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:00', 1L, 'a'), (2L, timestamp'2024-01-01 00:00:50', 1L, 'a'), (3L, timestamp'2024-01-01 00:01:30', 1L, 'a') t(event_id, ts, user_id, event_type)")
    assert dict(state.ttl_hits(d, 60).collect()) == {1: False, 2: True, 3: False}


def test_readers(spark, tmp_path):
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.RAW).count() == 0
    with pytest.raises(ValueError):
        readers.read_corpus(spark, "x.txt")
    (tmp_path / "w.txt").write_text("The\n# note\nthe\nof # tail\n")
    assert sorted(values(readers.read_words(spark, str(tmp_path / "w.txt")), "word")) == ["of", "the"]


def test_merge_keeps_the_first_and_upsert_the_last(spark):
    a, b = spark.createDataFrame([("k", 2)], "key string, v int"), spark.createDataFrame([("k", 1), ("m", 1)], "key string, v int")
    assert sorted(values(corpus.merge_keep_first([a, b], "key", "v"), "v")) == [1, 2]
    assert values(corpus.upsert_latest(b.unionByName(a), ["key"], ["v"]).where("key = 'k'"), "v") == [2]


def test_every_query_with_sql_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()


def greedy(spans):
    """Overlap suppression by plain loops: (term, start, end, source, technical)."""
    rank = {"entity": 3, "noun_chunk": 2, "compound": 1, "yake": 0}
    kept = []
    for c in sorted(spans, key=lambda s: (-s[4], s[1] - s[2], -rank[s[3]], s[1], s[2], s[3], s[0])):
        rivals = [k for k in kept if 2 * (min(c[2], k[2]) - max(c[1], k[1])) > max(1, min(c[2] - c[1], k[2] - k[1]))]
        if not any(k[2] - k[1] >= c[2] - c[1] or c[3] != "yake" and rank[k[3]] >= rank[c[3]] for k in rivals):
            kept.append(c)
    return sorted({(s[1], s[2]) for s in kept})


def test_overlap_suppression_equals_plain_loops(spark):
    import random

    r, rows = random.Random(3), []
    for doc in range(12):
        for i in range(14):
            a = r.randrange(60)
            rows.append((doc, f"t{i}", a, a + r.randrange(1, 25), r.choice(["entity", "noun_chunk", "compound", "yake"]), r.randrange(2)))
    got = {}
    for x in strategy.suppress_overlaps(spark.createDataFrame(rows, "doc_id long, term string, start int, end int, source string, technical int")).collect():
        got.setdefault(x["doc_id"], set()).add((x["start"], x["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {d: greedy([x[1:] for x in rows if x[0] == d]) for d in range(12)}


def test_segments_cover_the_text_without_overlap(spark):
    t = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "xyz")], "id long, text string")
    s = spark.createDataFrame([(1, 2, 5), (1, 4, 8), (1, 8, 10), (3, 0, 3)], "id long, start int, end int")
    got = [tuple(r) for r in strategy.segments(t, s).orderBy("id", "pos").collect()]
    assert got == [(1, 0, 0, 2, False), (1, 1, 2, 5, True), (1, 2, 5, 8, False), (1, 3, 8, 10, True), (3, 0, 0, 3, True)]


def test_key_terms_and_spans(spark):
    t = spark.createDataFrame([(1, "The Graph Laplacian of DFT"), (2, ""), (3, None)], "id long, text string")
    lex = spark.createDataFrame([("graph laplacian",)], "term string")
    got = [tuple(r) for r in strategy.key_terms(t, lex, k=2).orderBy("rank").collect()]
    assert got[0] == (1, 1, "graph laplacian", 4, 19, 5.5) and len(got) == 2
    ph = spark.createDataFrame([("graph",), ("graph laplacian",), ("lap",)], "phrase string")
    assert {tuple(r) for r in strategy.phrase_spans(t, ph).collect()} == {(1, "graph", 4, 9), (1, "graph laplacian", 4, 19)}


def test_neighbors_and_strategies(spark):
    lex = spark.createDataFrame([("a", "reaction rate"), ("a", "density functional theory"), ("a", "band gap")], "domain string, term string")
    t = spark.createDataFrame([("a", "band gap"), ("a", "dft"), ("a", "reaction speed"), ("a", "zeta"), ("a", "hilbert space")], "domain string, term string")
    d = spark.createDataFrame([("a", "zeta", -2.0)], "domain string, term string, delta double")
    got = {r["term"]: r for r in strategy.strategies(t, lex, d).collect()}
    assert got["band gap"]["native"] == 1.0 and got["dft"]["native"] == 0.8 and got["reaction speed"]["native"] == 0.25
    assert got["reaction speed"]["neighbor"] == "reaction rate" and got["reaction speed"]["neighbor_score"] == pytest.approx(1 / 3 + 0.15) and got["reaction speed"]["kind"] == "analogous"
    assert got["hilbert space"]["kind"] == "intranslatable" and got["zeta"]["kind"] == "unique" and got["band gap"]["kind"] == "equivalent"
    alias = spark.createDataFrame([("Zeta", "zed")], "term string, alias string")
    assert [tuple(r) for r in strategy.concept_neighbors(t.where("term = 'zeta'"), lex, alias).collect()] == [("zeta", "zed", 0.95)]


def test_evidence_counts_and_falls_back(spark):
    hits = spark.createDataFrame([(1, "a b", 2, 9.0, 1.0), (1, "a", 1, 2.0, 1.0), (1, "c", 1, -1.0, -1.0), (2, "c", 1, -1.0, -1.0)], "id long, term string, n int, z double, delta double")
    cover = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, coverage double")
    assert sorted(map(tuple, strategy.evidence(hits, cover, ["id"]).collect())) == [(1, 2.0, "a b:4.20 a:0.50"), (2, 0.25, "")]


def test_rebuilt_text_takes_the_later_token(spark):
    p = spark.createDataFrame([(1, 0, "zz", 1), (1, 0, "aa", 2), (1, 1, "b", 3)], "doc_id long, position int, token string, nth int")
    assert values(corpus.rebuild_from_index(p, order="nth"), "text") == ["aa b"]


def test_an_index_is_shuffled_once(spark):
    """Before, a document's postings were shuffled by position first."""
    rows = [(1, 1, "b"), (1, 0, "a"), (1, 1, "c"), (1, 2, None), (1, 3, "d"), (1, 3, None), (2, 5, None), (1, None, "x"), (1, None, "y")]
    got = corpus.rebuild_from_index(spark.createDataFrame(rows, "doc_id long, position int, token string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "y a c d", 2: ""}


def test_metrics_keep_labels_that_are_only_predicted(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b")], "label string, prediction string")
    one, per = evaluation.accuracy_and_macro_f1(p)
    assert one.first()["accuracy"] == 0.5 and {r["label"] for r in per.collect()} == {"a", "b"} and one.first()["macro_f1"] == pytest.approx(1 / 3)


def test_other_domain_without_the_term_counts_as_zero(spark):
    stats = spark.createDataFrame([("A", "x", 1.0), ("B", "x", -3.0), ("C", "y", 1.0)], "domain string, term string, z double")
    lex = spark.createDataFrame([], "domain string, term string")
    got = {r["term"]: r["distinctiveness"] for r in scoring.term_scores(stats, lex, "A", "B").collect()}
    assert got["x"] == pytest.approx(round(1 / (1 + math.exp(-0.5)), 4))


def test_refined_spans_and_categories(spark):
    d = spark.createDataFrame([(["the", "band", "gap", "of"], '["x",{"name":"y"},{"title":"z"},{"q":1}]')], "t array<string>, c string")
    r = d.select(S.refine_span("t", ["the", "of"]).alias("s"), S.category_names("c").alias("c")).first()
    assert (r["s"]["first"], r["s"]["last"]) == (2, 3) and r["c"] == ["x", "y", "z"]


def test_classifier_learns_saves_and_calibrates(spark, tmp_path):
    import random

    r = random.Random(1)
    vocab = {"a": ["reactor", "column", "reflux"], "b": ["graph", "matrix", "kernel"], "c": ["ligand", "bond", "orbital"]}
    rows = [(i, " ".join(r.choices(vocab[k], k=8)), k) for i, k in enumerate("abc" * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = classifier.fit(d, min_df=1, max_iter=15)
    classifier.save(model, str(tmp_path / "m"))
    p = classifier.probabilities(classifier.load(str(tmp_path / "m")), d)
    assert p.select(classifier.best_label("probs")["label"].alias("x"), "label").where("x = label").count() == 90
    cal = classifier.calibrated(d, d, characters=False, min_df=1, max_iter=15)
    q = cal.select(F.aggregate(F.map_values("probs"), F.lit(0.0), lambda a, x: a + x).alias("x"), classifier.probability_of("probs", F.lit("none")).alias("y")).collect()
    assert len(q) == 90 and all(abs(x["x"] - 1) < 1e-9 and x["y"] == 0 for x in q)
