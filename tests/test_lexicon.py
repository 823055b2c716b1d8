"""Lexicons: sections, JSON and back, merging, and the gates by hand."""

import json

from termforge.operators import lexicon

STATS = [("a", "graph", 1.0, 0.5), ("a", "graph kernel", 2.0, 0.4), ("a", "kernel loss", 3.0, 0.1), ("a", "kernel loss bound", 0.5, 0.2), ("a", "energy", 5.0, 0.9), ("a", "model", 0.1, 1.5), ("b", "graph kernel", 1.0, 0.1), ("b", "native=1", 9.0, 0.0)]


def test_sections_by_hand(spark):
    s = spark.createDataFrame(STATS, "domain string, term string, z double, combined double")
    got = {}
    for r in lexicon.sections(s, 3).orderBy("rank").collect():
        got.setdefault((r["domain"], r["section"]), []).append(r["term"])
    assert got["a", "style"] == ["kernel loss bound", "kernel loss", "graph kernel"]
    assert got["a", "topic"] == ["model", "energy"] and got["a", "bigrams"] == ["kernel loss", "graph kernel"] and got["a", "trigrams"] == ["kernel loss bound"]


def test_lexicon_files_round_trip_and_merge(spark, tmp_path):
    s = lexicon.sections(spark.createDataFrame(STATS, "domain string, term string, z double, combined double"), 9)
    lexicon.write_lexicon(s, f"{tmp_path}/lines")
    key = lambda df: sorted(tuple(r) for r in df.select("domain", "section", "rank", "term").collect())
    assert key(lexicon.read_lexicon(spark, f"{tmp_path}/lines")) == key(s)
    old = {"PM": ["Band Gap", "x", "band gap"], "CSM": {"style": ["Loss", "net"], "top_terms": ["old"], "bigrams": ["a b", "loss"], "meta": {"n": 2}, "trigrams": "odd"}, "CCE": 5}
    (tmp_path / "old.json").write_text(json.dumps(old, indent=1))
    read = lexicon.read_lexicon(spark, f"{tmp_path}/old.json")
    assert sorted((r["domain"], r["section"] or "", r["rank"], r["term"]) for r in read.collect())[0] == ("CSM", "bigrams", 1, "a b")
    got = {}
    for r in lexicon.merged(read).orderBy("domain", "rank").collect():
        got.setdefault(r["domain"], []).append(r["term"])
    assert got == {"PM": ["Band Gap", "x"], "CSM": ["a b", "loss", "net", "old"]}


def test_gates_by_hand(spark):
    rows = [("a", "style", i, t) for i, t in enumerate(["x y", "model", "p q"])] + [("b", "style", 0, "X y"), ("b", "bigrams", 0, "x y"), ("b", "topic", 0, "data"), ("c", None, 1, "z")]
    lex = spark.createDataFrame(rows, "domain string, section string, rank int, term string")
    stats = spark.createDataFrame([("native=0.00",), ("UpdatedGPT x",), ("fine",)], "term string")
    f1 = spark.createDataFrame([(0.75,)], "macro_f1 double")
    got = {(r["gate"], r["subject"]): (r["value"], r["passed"]) for r in lexicon.gates(lex, stats, f1, least_style=2, least_by_domain={"b": 1}).collect()}
    assert got["banned", "a"] == (1.0, False) and got["banned", "b"] == (0.0, True)
    assert got["style", "a"] == (3.0, True) and got["style", "b"] == (1.0, True) and got["style", "c"] == (1.0, False)
    assert got["overlap", "a-b"] == (1 / 3, False) and got["overlap", "a-c"] == (0.0, True)
    assert got["debug_rows", ""] == (2.0, False) and got["macro_f1", ""] == (0.75, True)
    assert not lexicon.gates(lex, stats, f1.limit(0)).where("gate = 'macro_f1'").first()["passed"]
