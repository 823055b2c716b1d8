"""Keyphrases and term spans against plain loops of the published formulas, and the cases that annotation must get right."""

import math
import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from termforge import config
from termforge.functions import terms as S, text as T
from termforge.operators import evaluation, keyphrases, mining, spans, strategy

STOP = frozenset(config.FUNCTION_WORDS)
TEXT = "Graph networks learn energy. The graph energy landscape, as the NASA model of energy, is smooth! Energy of graph networks: state of the art methods. We use 3 graph2vec networks and the Energy landscape"


def plain_keyphrases(text, top):
    """The formulas as they are written down, word by word over all words."""
    toks, sentence, last = [], 0, None
    for m in re.finditer(r"[^\W_]+(?:['’\-/][^\W_]+)*", text):
        gap = text[last : m.start()] if last is not None else ""
        new_sentence = last is not None and any(c in ".!?…\n" for c in gap)
        sentence += new_sentence
        toks.append({"w": m.group(), "low": m.group().lower(), "s": sentence, "joined": last is not None and not gap.strip() and not new_sentence, "first": last is None or new_sentence, "at": (m.start(), m.end())})
        last = m.end()
    low = [t["low"] for t in toks]
    stop = lambda w: w in STOP or len(w) < 3
    follows = lambda a, b: sum(low[i - 1] == a and low[i] == b and toks[i]["joined"] for i in range(1, len(toks)))
    content = [low.count(w) for w in set(low) if not stop(w)]
    mean = sum(content) / len(content)
    sd = math.sqrt(sum((c - mean) ** 2 for c in content) / len(content))
    weight = {}
    for w in set(low):
        mine = [i for i, x in enumerate(low) if x == w]
        tf = len(mine)
        up = sum(toks[i]["w"][0].isupper() and not (len(toks[i]["w"]) > 1 and toks[i]["w"].isupper()) and not toks[i]["first"] and not any(c.isdigit() for c in w) for i in mine)
        acronym = sum(len(toks[i]["w"]) > 1 and toks[i]["w"].isupper() and not any(c.isdigit() for c in w) for i in mine)
        left = [low[i - 1] for i in mine if toks[i]["joined"]]
        right = [low[i + 1] for i in mine if i + 1 < len(toks) and toks[i + 1]["joined"]]
        rel = 1 + ((len(set(left)) / len(left) if left else 0) + (len(set(right)) / len(right) if right else 0)) * tf / max(low.count(x) for x in low)
        pos = math.log(math.log(3 + median(toks[i]["s"] for i in mine)))
        dif = len({toks[i]["s"] for i in mine}) / (sentence + 1)
        weight[w] = rel * pos / (max(up, acronym) / (1 + math.log(tf)) + tf / (mean + sd) / rel + dif / rel)
    grams = {}
    for i in range(len(toks)):
        for n in (1, 2, 3):
            part = toks[i : i + n]
            ws = [t["low"] for t in part]
            odd = any(any(c.isdigit() for c in w) for w in ws[1:]) or any(any(c.isdigit() for c in w) for w in ws[:1])
            if len(part) == n and all(t["joined"] for t in part[1:]) and not stop(ws[0]) and not stop(ws[-1]) and not odd:
                grams.setdefault(tuple(ws), []).append(part)
    scored = []
    for ws, places in grams.items():
        prod, total = 1.0, 0.0
        for k, w in enumerate(ws):
            if stop(w):
                p = follows(ws[k - 1], w) / low.count(ws[k - 1]) * follows(w, ws[k + 1]) / low.count(ws[k + 1])
                prod, total = prod * (2 - p), total - (1 - p)
            else:
                prod, total = prod * weight[w], total + weight[w]
        value = prod / (len(places) * (1 + total)) if total > -1 else prod
        scored.append((value, places[0][0]["at"][0], places[0][-1]["at"][1]))

    def distance(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    kept = []
    for value, s, e in sorted(scored):
        p = text[s:e]
        if all(1 - distance(p.lower(), q.lower()) / max(len(p), len(q)) <= 0.9 for q, _ in kept):
            kept.append((p, value))
    return kept[:top]


@pytest.mark.parametrize("seed", range(6))
def test_keyphrases_equal_the_formulas(seed):
    r = random.Random(seed)
    text = TEXT if seed == 0 else " ".join(r.choice(TEXT.split() + ["energy,", "graphs", "Networks.", "landscapes"]) for _ in range(120))
    got, want = keyphrases.keyphrases(text), plain_keyphrases(text, 20)
    assert [p for p, _ in got] == [p for p, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for (_, a), (_, b) in zip(got, want))


def test_keyphrases_of_odd_texts():
    assert keyphrases.keyphrases("") == keyphrases.keyphrases("  \n ?!") == keyphrases.keyphrases("of the a 3 42") == []
    assert keyphrases.keyphrases("entropy") and keyphrases.edit_similarity("", "") == 1.0
    assert keyphrases.occurrences("a cat, a catalogue, cat cat", "cat") == [(2, 5), (20, 23)]
    assert keyphrases.occurrences("xx", "  ") == []


def test_keyphrase_rows(spark):
    d = spark.createDataFrame([(1, "Sparse attention updatedgpt_x reduces memory. Sparse attention helps; sparse attention!"), (2, None), (3, ""), (1, "Sparse attention")], "doc_id long, text string").withColumn("key", F.lit(1))
    rows = keyphrases.text_keyphrases(d).collect()
    clean = "Sparse attention reduces memory. Sparse attention helps; sparse attention!"
    places = sorted((r["start"], r["end"]) for r in rows if r["doc_id"] == 1 and r["phrase"].lower() == "sparse attention")
    assert places == [(0, 16), (0, 16), (33, 49)] and clean[33:49] == "Sparse attention"
    assert {r["doc_id"] for r in rows} == {1} and not any("reduces" in r["phrase"] for r in rows)
    assert keyphrases.text_keyphrases(d.limit(0)).count() == 0


def test_filter_of_keyphrases_is_the_same_in_both_forms(spark):
    some = ["ab", "model methods", "graph model", "use graphs", "graph to art", "run-time debug", "x" * 3, "native=1 x", "(3) 42", "Results", "Data Sets", "k-space", "uses", ""]
    d = spark.createDataFrame([(x,) for x in some], "p string").withColumn("ok", keyphrases.good_phrase("p"))
    assert {r["p"]: r["ok"] for r in d.collect()} == {x: spans.good_keyphrase(x) for x in some}


@pytest.mark.parametrize(
    ("text", "wanted", "unwanted"),
    [
        ("Our transformer uses sparse attention to reduce memory while preserving long-range dependencies.", ["transformer", "sparse attention", "long-range dependencies"], ["reduce", "while"]),
        ("A SE(3)-equivariant architecture improves geometric robustness.", ["se(3)-equivariant"], []),
        ("A SO(2)-equivariant net.", ["so(2)-equivariant"], []),
        ("We optimize k-space sampling trajectories for MRI reconstruction.", ["k-space"], []),
        ("Sparse attention improves long-range dependencies.", ["long-range dependencies"], []),
        ("We evaluate the method while under strict constraints in the system.", ["strict constraints"], ["while", "under"]),
        ("updatedgpt_noself_v2 proposes an approach (native=0.00) with domain-specific concept.", [], ["updatedgpt", "native="]),
    ],
)
def test_terms_of_sentences(spark, text, wanted, unwanted):
    terms = [r["term"].lower() for r in spans.extract_terms(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    joined = " | ".join(terms)
    assert all(w in joined for w in wanted) and not any(u in terms or ("=" in u or "gpt" in u) and u in joined for u in unwanted)


def test_technical_forms(spark):
    """By hand: one to four letters and numbers in brackets, a hyphen, words; k-space and no other letter."""
    d = spark.createDataFrame([("SO(2)-equivariant, SE(3,1)-a-b, E(n)-net, x-space, K-Space, LONGER(3)-x",)], "t string")
    assert d.select(F.regexp_extract_all("t", F.lit(T.TECH), F.lit(0))).first()[0] == ["SO(2)-equivariant", "SE(3,1)-a-b", "K-Space"]
    assert d.select(F.regexp_extract_all(F.lit("an Inverse Fourier Transform, DFT, DFTs, se(3)"), F.lit(T.SPECIAL), F.lit(0))).first()[0] == ["Inverse Fourier Transform", "DFT", "se(3)"]


def plain_suppression(text, items):
    """All kept spans are looked at."""
    order = sorted(items, key=lambda x: (*spans.priority(text, x), x[1], x[2]))
    kept = []
    for s, e, kind in order:
        for ks, ke, kk in kept:
            inter = max(0, min(e, ke) - max(s, ks))
            if inter / max(1, min(e - s, ke - ks)) <= 0.5:
                continue
            if ke - ks >= e - s or (kind != "yake" and spans.SPAN_RANKS.get(kk, 0) >= spans.SPAN_RANKS.get(kind, 0)):
                break
        else:
            kept.append((s, e, kind))
    out = []
    for x in sorted(kept, key=lambda x: x[0]):
        if not any(spans.normalized(text[o[0] : o[1]]) == spans.normalized(text[x[0] : x[1]]) and o[:2] == x[:2] for o in out):
            out.append(x)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_suppression_by_cells_equals_all_pairs(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab-C (D") for _ in range(400))
    items = []
    for _ in range(120):
        s = r.randrange(390)
        items.append((s, min(400, s + r.choice([1, 2, 5, 20, 70, 150])), r.choice(["entity", "noun_chunk", "compound", "yake", "other"])))
    assert spans.kept_spans(text, items) == plain_suppression(text, items)


def test_a_provider_gives_spans(spark):
    def toy():
        import re

        return lambda text: [(m.start(), m.end(), "entity") for m in re.finditer(r"the [A-Z]\w+ Law", text)] + [(0, 10**6, "entity"), (5, 5, "entity")]

    d = spark.createDataFrame([(1, "We tested the Ohm Law today"), (2, "the Ohm Law")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["term"], r["source"]) for r in spans.extract_terms(d, provider=toy, most=1).collect())
    # One who gives no entity: the longest run of words wins.
    without = {r["doc_id"]: r["source"] for r in spans.extract_terms(d, most=1).collect()}
    assert (2, "the Ohm Law", "entity") in got and without[2] == "noun_chunk"
    made = []
    factory = lambda: made.append(1) or toy()
    assert spans.provider_of(factory) is spans.provider_of(factory) and made == [1] and spans.provider_of(None) is None


def test_refined_spans_lose_their_ends():
    text = "using the graph model"
    assert spans.refined(text, 0, 21) == (6, 15) and spans.refined("the use of", 4, 7) == (4, 7)


def test_annotation_is_one_transform(spark):
    texts = spark.createDataFrame([(1, "Energy landscape of sparse attention"), (2, None)], "id long, text string").withColumn("rank", F.lit(1))
    stats = spark.createDataFrame([("a", "sparse attention", 3.0), ("b", "sparse attention", -1.0), ("b", "free energy", 2.0)], "domain string, term string, z double")
    lex = spark.createDataFrame([("a", "Sparse Attention"), ("b", "energy barrier"), ("b", "attention map")], "domain string, term string")
    index = spark.createDataFrame([("b::attention map", i, {"snippet": f"s{i}"}) for i in range(3)], "key string, pos int, hit struct<snippet:string>")
    rows = {r["term"].lower(): r for r in strategy.annotate(texts.drop("rank"), lex, stats, "a", "b", evidence=index).collect()}
    r = rows["sparse attention"] if "sparse attention" in rows else rows["of sparse attention"]
    assert rows["energy landscape of"]["analogs"][0]["candidate"] == "energy barrier" if "energy landscape of" in rows else True
    assert all(x["explain_available"] == x["flagged"] for x in rows.values())
    best = min(rows.values(), key=lambda x: x["rank"])
    assert best["flagged"] and best["rank"] == 1 and r["id"] == 1
    hit = next((x for x in rows.values() if x["analogs"] and x["analogs"][0]["candidate"] == "attention map"), None)
    assert hit is not None and [e["snippet"] for e in hit["evidence"]] == ["s0", "s1"]


def test_diagnosis_by_hand(spark):
    """Order: warm-up, 403 with a firewall, 401 or a login page, 403 without 200, 200, HTML."""
    def said(*rows):
        d = spark.createDataFrame([(*r, *("", "", False, 0)[len(r) - 2 :]) for r in rows], "status int, waf boolean, body string, content_type string, warm_up boolean, cookies int")
        return evaluation.diagnosis(d).first()["conclusion"]

    assert said((200, False), (403, True), (401, False)) == "Likely WAF block"
    assert said((200, False), (403, False), (401, False)) == "Likely needs auth"
    assert said((200, False, "Please Login"), (500, False)) == "Likely needs auth"
    assert said((403, False), (500, False)) == "Likely platform-side block or API access policy"
    assert said((403, False), (200, False)) == "Endpoint reachable; likely client header/flow issue in failing mode"
    assert said((404, False, "", "Text/HTML")) == "Likely endpoint/param change (non-JSON API behavior)"
    assert said((500, False), (None, None)) == "Inconclusive; check network/proxy and endpoint documentation"
    assert said((403, True), (200, False, "", "", True, 2)) == "Likely needs auth"
    assert evaluation.diagnosis(spark.createDataFrame([(403, "login", True)], "status int, body string, waf boolean")).first()["conclusion"] == "Likely WAF block"


def test_provider_errors_by_hand(spark):
    d = spark.createDataFrame([("429 quota", True, "api_error"), ("RESOURCE_EXHAUSTED", True, "api_error"), ("Read Timeout", True, "timeout"), ("it timed out", True, "timeout"), ("bad gateway", True, "other"), (None, True, "other"), ("API_KEY is not set", False, "no_key"), ("model is Not Configured", False, "no_key"), ("no such thing", False, "api_error")], "m string, up boolean, want string")
    assert d.where(S.provider_error("m", F.col("up")) != F.col("want")).count() == 0
    reasons = d.groupBy().agg(F.collect_set(S.provider_error("m", F.col("up"))).alias("r"))
    assert reasons.select(S.fallback_reason("r")).first()[0] == "no_key"


def test_mean_tfidf_by_hand(spark):
    """Accents stay in their word, function words go, single letters too."""
    d = spark.createDataFrame([(1, "fr", "Le café café the x"), (2, "fr", "café noir"), (3, "en", "the noir"), (4, "en", None)], "doc_id long, lang string, text string")
    got = {(r["domain"], r["term"]): r["tfidf_mean"] for r in mining.mean_tfidf(d).collect()}
    cafe, noir = math.log(4 / 3) + 1, math.log(4 / 3) + 1
    assert set(got) == {("fr", "café"), ("fr", "noir"), ("en", "noir")}
    assert math.isclose(got["fr", "café"], (1 + cafe / math.hypot(cafe, noir)) / 2) and math.isclose(got["en", "noir"], 1.0)
    assert ("en", "the") in {(r["domain"], r["term"]) for r in mining.mean_tfidf(d, 1, ()).collect()}


def test_scores_are_flagged_at_the_thresholds(spark):
    from termforge.operators import scoring

    stats = spark.createDataFrame([("CSM", "graph Laplacian", 3.2), ("PM", "graph Laplacian", -1.2), ("PM", "band gap", 2.0), ("CSM", "band gap", 0.4)], "domain string, term string, z double")
    lex = spark.createDataFrame([("CSM", "nothing")], "domain string, term string")
    got = {r["term"]: r for r in scoring.term_scores(stats, lex, "CSM", "PM", config.Scoring(src_threshold=0.3)).collect()}
    assert got["graph Laplacian"]["flagged"] and got["graph Laplacian"]["reason"] == "src_distinctive+low_tgt_familiarity"
    assert not got["band gap"]["flagged"] and got["band gap"]["reason"] == "src_distinctive"
