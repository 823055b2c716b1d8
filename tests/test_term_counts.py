"""Terms in many documents against plain sets of every text, and the number of times that a corpus is mined."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from termforge import config
from termforge.operators import mining, term_counts
from termforge.plans import registry


def texts():
    r = random.Random(5)
    words = ["alpha", "beta-x", "se(3)", "(f(x)", "the", "gamma", "k-space", "is", "d9", "of", "omega/2"]
    out = ["", " ", "...", "a", "se(3)-net se(3)-net", "é alpha beta-x", "alpha  beta-x", "alpha\nbeta-x gamma"]
    return out + ["".join(r.choice(words) + r.choice([" ", " ", " ", ", ", "-", "\n"]) for _ in range(r.randrange(1, 40))) for _ in range(300)]


def plain(rows):
    df = Counter()
    for text, domain in rows:
        df.update((t, domain) for t in mining.text_terms(text.lower()))
    return df


@pytest.mark.parametrize("block", [1, 50, 1 << 18])
def test_blocks_hold_every_term(monkeypatch, block):
    monkeypatch.setattr(term_counts, "BLOCK_WORDS", block)
    rows = [(t.lower(), "ab"[i % 2]) for i, t in enumerate(texts())]
    batches = pa.table({"low": [t for t, _ in rows], "domain": [d for _, d in rows]}).to_batches(max_chunksize=7)
    got = Counter()
    for words, terms in term_counts._blocks(batches, ["a", "b"]):
        for _, places, counts in terms:
            for at, c in zip(places.tolist(), counts.tolist()):
                got.update({(" ".join(words[i] for i in at), d): n for d, n in zip("ab", c) if n})
    assert got == plain(rows)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_frequent_counts_equal_plain_sets(spark, least):
    rows = [(t.lower(), "ab"[i % 3 % 2]) for i, t in enumerate(texts())]
    want = {}
    for (t, d), n in plain(rows).items():
        want.setdefault(t, [0, 0])["ab".index(d)] += n
    want = {t: tuple(c) for t, c in want.items() if sum(c) >= least}
    got = term_counts.frequent_counts(spark.createDataFrame(rows, "low string, domain string").repartition(3), ["a", "b"], least).collect()
    assert {r["term"]: (r["c0"], r["c1"]) for r in got} == want and all(r["total"] == r["c0"] + r["c1"] for r in got)


def test_no_documents(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    assert mining.mined(d, config.Mining()).count() == 0


@pytest.mark.parametrize("name", ["lexicon_sections", "mine_ctfidf", "term_score_flags"])
def test_a_corpus_is_mined_once(spark, name):
    """Before, the plan mined the texts again for every section and for the sums."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_mean_tfidf_with_few_words_in_all_tasks(spark):
    """Words that are shuffled to meet their idf weigh what those that go to all tasks do."""
    d = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts())], "doc_id long, text string, lang string")
    want, *others = ({(r["domain"], r["term"]): r["tfidf_mean"] for r in mining.mean_tfidf(d, most_often=most).collect()} for most in (1 << 17, 1, 4))
    assert want and all(set(o) == set(want) and all(o[k] == pytest.approx(want[k], rel=1e-9) for k in want) for o in others)
