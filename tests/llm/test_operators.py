"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and empty tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.llm import components, decontamination, gram_scores, html_extraction, line_dedup, mixing, ngram_join, quality, storage, textbytes, token_counts, topk_search, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, texts, **kw):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_word_hashes_do_not_join_rows():
    import pyarrow as pa

    data, off = textbytes.string_bytes(pa.array(["ab", "c ab", None, "", "é x"]))
    s, e, first = textbytes.word_bounds(data, off, textbytes.NONSPACE)
    h = textbytes.word_hashes(data, s, e)
    assert list(first) == [0, 1, 3, 3, 3, 5] and h[0] == h[2] and h[1] != h[0]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2)], "a long, b long")
    got = dict(components.connected_components(e, storage.Scratch(spark)).collect())
    assert got == {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 8: 8}


def test_ngram_join_equals_brute_force(spark):
    base, texts = words(60, 1), []
    for k in range(12):
        w = list(base)
        for i in random.Random(k).sample(range(60), k % 4):
            w[i] = f"x{k}{i}"
        texts.append(" ".join(w))
    texts += [" ".join(words(40, 50 + i)) for i in range(5)] + [texts[0], None, "", "one two", "One two", "three"]
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def test_line_dedup_equals_brute_force(spark):
    line = words(30, 3)
    near = [*line[:29], "other"]
    far = [w if i % 2 else f"y{i}" for i, w in enumerate(line)]
    texts = ["\n".join([" ".join(line), "", "short one"]), " ".join(near) + "\nnew " + " ".join(words(8, 9)), " ".join(far), None, "", "Short  one\n" + " ".join(line), "\t\n "]
    seen, want = [], []
    for t in texts:
        kept = []
        for ln in [] if t is None else t.split("\n"):
            s = shingles(ln)
            if not s or not any(100 * len(s & o) >= 75 * len(s | o) for o in seen):
                kept.append(ln)
            if s:
                seen.append(s)
        want.append(None if t is None else "\n".join(kept))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, block):
    item, short = words(14, 5), ["tiny", "item"]
    texts = ["pre " + " ".join(item[2:13]) + " post", " ".join(item[:9]), "a Tiny-item b", None, "", " ".join(words(20, 8))]
    bench = spark.createDataFrame([(10, " ".join(item)), (2, " ".join(short)), (3, None), (None, "pre")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.benchmark_overlap(docs(spark, texts), bench, block_bytes=block).collect()}
    assert got == {0: (13, 11, [10]), 1: (9, 0, []), 2: (4, 2, [2]), 3: (0, 0, []), 4: (0, 0, []), 5: (20, 0, [])}


def test_top_k_with_ties_nulls_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [3.0]), (None, [9.0, 9.0]), (6, [0.5, None])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(v.where("vec_id = 0"), v, k=2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 3 * 256 * 256), (0, 2, 1, 256 * 256)]
    assert topk_search.top_k(v.limit(0), v).count() == 0


def test_trie_counts_equal_plain_dynamic_programming():
    pieces = {"▁": -5.0, "a": -4.0, "b": -4.0, "▁a": -2.0, "ab": -1.5, "bab": -2.5, "▁ab": -3.0}
    v = token_counts.Vocabulary(pieces)

    def plain(w):
        best = [(0.0, 0)] + [None] * len(w)
        for e in range(1, len(w) + 1):
            options = [(best[s][0] + pieces[w[s:e]], best[s][1] + 1) for s in range(e) if w[s:e] in pieces]
            if w[e - 1] not in pieces:
                n = len(w[e - 1].encode())
                options.append((best[e - 1][0] + n * v.byte_score, best[e - 1][1] + n))
            best[e] = max(options, key=lambda o: o[0])
        return best[-1][1]

    some = sorted({"▁" + "".join(random.Random(i).choices("abé", k=i % 7)) for i in range(60)})
    assert v.count(some) == [plain(w) for w in some]


def test_gram_scores_sum_like_a_loop(spark):
    texts = ["hello world", None, "", "hello hello  again", "x" * 50]
    d = docs(spark, texts).select("doc_id", "text")
    model = gram_scores.count_grams(d.select("text", F.lit(0).alias("cls")), 1, gram_scores.plain, 64).cache()
    got = {r["doc_id"]: (r["total"], r["n_grams"]) for r in gram_scores.score_documents(d, model, lambda k, c, w: (w & 0xFF).astype(float), 1, gram_scores.plain, 64, gram_scores.text_bytes(d), block_bytes=16).collect()}
    for i, t in enumerate(texts):
        body = " ".join((t or "").split()).encode() + b" "
        body = body if (t or "").strip() else b" "
        assert got[i] == (pytest.approx(sum(body)), len(body))


def byte_rows(texts):
    """Each text's grams of six bytes, as plain bytes, oldest byte first."""
    out = []
    for t in texts:
        body = b" " * 5 + (" ".join((t or "").split()).encode() + b" ")
        out.append([body[i - 5 : i + 1] for i in range(5, len(body))])
    return out


def continuation(grams, k):
    """{gram of k bytes: number of distinct bytes before it}, from distinct grams of six bytes."""
    seen = {}
    for g in set(grams):
        seen.setdefault(g[-k:], set()).add(g[-k - 1 : -k])
    return {g: len(b) for g, b in seen.items()}


def blend(counts, g, lower):
    d = gram_scores.discounts(np.array(list(counts.values())))
    same = {x: c for x, c in counts.items() if x[:-1] == g[:-1]}
    if not same:
        return lower
    cut = {x: d[min(c, 3) - 1] for x, c in same.items()}
    return (same.get(g, 0) - cut.get(g, 0.0) + sum(cut.values()) * lower) / sum(same.values())


def low(grams, g):
    """Orders 1 and 2 from distinct grams of three bytes."""
    pairs = continuation(grams, 2)
    ones = {}
    for p in pairs:
        ones[p[-1:]] = ones.get(p[-1:], 0) + 1
    mass = [(max(ones.get(bytes([x]), 0) - 0.5, 0) + 0.5 * len(ones) / 256) / sum(ones.values()) for x in range(256)]
    one = mass[g[-1]] / sum(mass)
    total = sum(c for p, c in pairs.items() if p[:1] == g[-2:-1])
    if not total:
        return one
    kinds = sum(1 for p in pairs if p[:1] == g[-2:-1])
    return (max(pairs.get(g[-2:], 0) - 0.75, 0) + 0.75 * kinds * one) / total


def counts_of(grams):
    out = {}
    for g in grams:
        out[g] = out.get(g, 0) + 1
    return out


@pytest.fixture(scope="module")
def small_corpus():
    r = random.Random(5)
    syllables = ["ba", "lo", "ti", "é", "re", "nu"]
    return [" ".join("".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(r.randrange(5, 25))) for _ in range(14)]


def kernel_values(texts, classes, evaluate, wanted):
    import pyarrow as pa

    data, off = textbytes.string_bytes(pa.array(texts))
    keys, first = gram_scores.grams(data, off, gram_scores.plain)
    of = np.repeat(np.array(classes), np.diff(first))
    ks, cs = [], []
    for c in range(max(classes) + 1):
        u, m = gram_scores.counted(keys[of == c])
        ks.append(u)
        cs.append(np.eye(max(classes) + 1, dtype=np.int64)[c] * m[:, None])
    k, c = gram_scores.add_up(ks, cs)
    three = gram_scores.unique(k & np.uint64(0xFFFFFF))
    short = np.bincount(three & np.uint64(0xFFFF), minlength=1 << 16).reshape(256, 256)
    key = np.array([int.from_bytes(g, "big") for g in wanted], np.uint64)
    return evaluate(short)(k, c, key)


def test_kneser_ney_equals_plain_loops(small_corpus):
    rows = byte_rows(small_corpus[:10])
    all_grams = [g for r in rows for g in r]
    wanted = [g for r in byte_rows(small_corpus[10:]) for g in r][:120]
    got = kernel_values(small_corpus[:10], [0] * 10, quality.log_probability, wanted)
    for g, v in zip(wanted, got):
        p = low(all_grams, g)
        for k in (3, 4, 5):
            p = blend(continuation(all_grams, k), g[-k:], p)
        assert v == pytest.approx(math.log(max(blend(counts_of(all_grams), g, p), 1e-12)))


def test_class_models_equal_plain_loops(small_corpus):
    classes = [i % 2 for i in range(10)]
    rows = byte_rows(small_corpus[:10])
    own = [[g for r, c in zip(rows, classes) if c == k for g in r] for k in (0, 1)]
    wanted = [g for r in byte_rows(small_corpus[10:]) for g in r][:120]
    got = kernel_values(small_corpus[:10], classes, toxicity.log_ratio, wanted)
    for g, v in zip(wanted, got):
        shared = blend(continuation(own[0] + own[1], 3), g[-3:], low(own[0] + own[1], g))
        logs = []
        for grams in own:
            p = shared
            for k in (4, 5):
                p = blend(continuation(grams, k), g[-k:], p)
            logs.append(math.log(max(blend(counts_of(grams), g, p), 1e-12)))
        assert v == pytest.approx(logs[1] - logs[0])


def test_quality_thresholds_by_language(spark):
    """Held-out trusted rows set a quantile for each language; one with few of them takes that of all."""
    r = random.Random(2)
    word = {"en": ["the", "cat", "sat", "on", "mat"], "fr": ["le", "chat", "est", "sur", "lit"], "xx": ["lo", "ri", "um", "ta"]}
    rows = [(i, " ".join(r.choices(word[lang], k=30)), lang, "s") for i, lang in enumerate(["en"] * 200 + ["fr"] * 200 + ["xx"] * 10)]
    rows += [(1000 + i, " ".join(f"q{r.randrange(10**6)}" for _ in range(30)), lang, "s") for i, lang in enumerate(["en", "fr", "xx"])]
    rows += [(2000, None, "en", "s"), (2001, "", None, "s"), (None, "the cat", "en", "s"), (0, "the cat sat", "en", "s")]
    d = spark.createDataFrame(rows, DOCS)
    trusted = spark.createDataFrame([(i,) for i in range(410)], "doc_id long")
    out = quality.quality_scores(d, trusted).collect()
    assert len(out) == len(rows)
    held = {i for i in range(410) if zlib.crc32(str(i).encode()) % 5 == 0}
    by = {}
    for x in out:
        by.setdefault(x["doc_id"], []).append(x)
    limit = {}
    for lang in ("en", "fr", None):
        p = sorted(x["perplexity"] for x in out if x["doc_id"] in held and (lang is None or x["lang"] == lang))
        limit[lang] = 1.25 * p[math.ceil(0.99 * len(p)) - 1]
    for x in out:
        assert x["threshold"] == pytest.approx(limit["fr" if x["lang"] == "fr" else "en" if x["lang"] == "en" else None], rel=1e-6)
    assert not any(by[i][0]["keep"] for i in (1000, 1001, 1002)) and all(by[i][0]["keep"] for i in (2000, 2001, None))
    assert sum(x["keep"] for x in out if x["doc_id"] is not None and x["doc_id"] < 410) >= 0.97 * 411
    assert quality.quality_scores(d, trusted.limit(0)).where("keep").count() == len(rows)
    assert quality.quality_scores(d.limit(0), trusted).count() == 0


def test_toxicity_learns_and_handles_no_labels(spark):
    bad = ["you awful zzgrub thing", "zzgrub again and more"]
    texts = [f"{bad[i % 2]} {' '.join(words(6, i))}" if i % 4 == 0 else " ".join(words(10, i)) for i in range(200)]
    d = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(d, labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 200]
    assert held and sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity_scores(d, labels.limit(0)).where("score > 0").count() == 0


def test_mixing_meets_its_budgets(spark):
    rows = [(i, " ".join(["t"] * 10), "en", "big" if i < 300 else f"s{i % 3}") for i in range(400)] + [(999, None, "en", None)]
    d = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(d, entropy_share=0.98, repetition_limit=5.0, block_tokens=100)
    w = {r["source"]: (r["n"], r["weight"]) for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.first("weight").alias("weight")).collect()}
    assert math.isclose(sum(x[1] for x in w.values()), 1, rel_tol=1e-9)
    assert all(abs(n - 4000 * x) <= 10 for n, x in w.values())
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    rules = [url_filter.Rule("bad.net", "/", "block"), url_filter.Rule("org", "/", "allow")]
    link = '<link rel="canonical" href="http://bad.net/x">'
    rows = [(1, "http://a.com/1", link), (2, "http://Sub.BAD.net/q?z", None), (3, "https://b.org/", link), (4, None, None), (5, "nourl", ""), (6, "http://c.com", "<p>")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(p, rules).collect()}
    assert got == {1: ("a.com", "/1", None, "block"), 2: ("sub.bad.net", "/q", "bad.net/", "block"), 3: ("b.org", "/", "org/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("c.com", "", None, "allow")}


def test_html_extraction(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><div class="ad">buy</div><article><h1>Head &amp; all</h1><p><b>One  two.<br><p>Three</p><aside>no</aside></article><div id="comments"><p>hi</p></div><footer>&copy;</footer>'
    plain = "<body><div class='menu'>m</div><div class='body'><p>Long text one here {}.</p></div><footer>f</footer>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, "http://g/1", plain.format("a")), (4, "http://g/2", plain.format("b")), (5, None, "x & y")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "Head & all\nOne two.\nThree" and got[2] == ("", 0)
    assert got[3][0] == "Long text one here a." and got[4][0] == "Long text one here b." and got[5][0] == "x & y"
