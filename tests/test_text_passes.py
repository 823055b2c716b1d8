"""Passes over whole texts: dealt to all cores, and no work for spans and distances that cannot matter."""

import random

from pyspark.sql import functions as F

from termforge.operators import keyphrases, mining, spans


def test_texts_of_one_block_are_dealt(spark):
    d = spark.createDataFrame([(i, f"spectral density estimators {i} of sparse matrices") for i in range(64)], "doc_id long, text string").coalesce(1)
    for found in (keyphrases.text_keyphrases(d), spans.extract_terms(d)):
        assert found.rdd.getNumPartitions() >= 8 and found.select("doc_id").distinct().count() == 64


def test_alike_is_a_bound_on_the_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choices("abc ", k=r.randrange(0, 34)))
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            b.insert(r.randrange(len(b) + 1), r.choice("abcd")) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        b = "".join(b)
        for like in (0.9, 0.75, 0.3):
            assert keyphrases.alike(a, b, like) == (keyphrases.edit_similarity(a, b) > like)


def test_terms_by_their_tokens_are_those_by_their_text():
    """Connecting words, markers over gaps, brackets and odd characters."""
    texts = ["heat for flow and mass", "native=x native = y big native=z", "a domain-specific concept is run-x debug", "SE(3)-equivariant foo(bar (x) AB CD-e k-space", "Cafés crème İstanbul ISTANBUL 3D x/y", "to use heat flow maps with data"]
    for text in texts:
        toks = [(m.start(), m.end(), m.group().lower()) for m in spans._TOKEN.finditer(text)]
        fine = [w not in spans._STOP and w not in spans._VERBS for _, _, w in toks]
        near = [fine[i] and fine[i + 1] and toks[i][1] + 1 == toks[i + 1][0] for i in range(len(toks) - 1)]
        raw = [(toks[i][0], toks[i + n][1]) for i in range(len(near)) for n in (1, 2) if all(near[i : i + n]) and i + n < len(toks)]
        want = {(s, e, spans.technical(text[s:e])) for s, e in (spans.refined(text, *x) for x in raw) if spans.valid(text[s:e])}
        assert set(spans.adjacent(text)) == want


def test_phrases_are_counted_before_they_are_shuffled(spark, monkeypatch):
    """Counts by task equal those of distinct phrases, with repeated and missing ids and domains too, and are dealt."""
    texts = ["Heat flow map, heat flow map x (y) model z", "heat flow\tmap use  of flow map", None, "", "é heat flow map-2 study flow map"]
    for ids in ([0, 1, 2, 3, 4], [0, 0, 2, None, None]):
        rows = [(i, t, k) for k in ("en", None) for i, t in zip(ids, texts)]
        if len(set(ids)) == 5:
            rows = [(i, t, k) for i, (_, t, k) in enumerate(rows)]
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
        want = mining.adjacent_ngrams(d).groupBy("domain", "phrase", "n").agg(F.count("*").alias("df"))
        for most in (1, 1 << 19):
            monkeypatch.setattr(mining, "COUNTED_AT_ONCE", most)
            got = mining.adjacent_counts(d)
            assert sorted(map(repr, got.select("domain", "phrase", "n", "df").collect())) == sorted(map(repr, want.select("domain", "phrase", "n", "df").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan
