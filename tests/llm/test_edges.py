"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termforge.llm import decontamination, html_extraction, line_dedup, mixing, ngram_join, quality, storage, token_counts, topk_search, toxicity, url_filter

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
CLASH = ("_bad", "_later", "k_doc", "k_part", "k_line", "_part", "k_gone", "block", "epoch", "weight", "n_removed_", "fold", "cls", "host", "component", "ord", "rank", "total", "shard", "lines_gone", "doc_key")


@pytest.fixture(scope="module")
def table(spark):
    """Documents with nulls in every column, an empty, a blank and a very long text, repeated rows and ids, ties and odd columns."""
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (1, "other words here", "fr", "b"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "en", None), (None, "one two three four five six", "en", "a"), (None, None, None, None), (5, LONG, "en", "a"), (6, "one two three four five six", "de", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark for the stages."""
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(1)
    rows = [(100 + i, f"zzgrub {r.random()} zzgrub" if i % 4 == 0 else f"fine {r.random()} words", i % 4 == 0) for i in range(80)]
    spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "never seen words of a benchmark item that nothing else holds at all"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, [(i, t) for i, t, _ in rows]


def ids(df):
    return sorted([r["doc_id"] for r in df.select("doc_id").collect()], key=lambda x: (x is not None, x))


def operators(spark, folder):
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    return {
        "op1": lambda d: mixing.mix_sources(d, repetition_limit=2.0),
        "op2": token_counts.count_tokens,
        "op4": lambda d: toxicity.toxicity_scores(d, labels),
        "op5": lambda d: decontamination.benchmark_overlap(d, bench),
        "op6": line_dedup.dedup_lines,
        "op7": ngram_join.near_duplicates,
        "op10": lambda d: quality.quality_scores(d, labels.select("doc_id")),
    }


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op7", "op10"])
def test_every_row_gets_its_row(spark, table, folder, name):
    d = table.unionByName(spark.createDataFrame(folder[1], "doc_id long, text string"), allowMissingColumns=True)
    out = operators(spark, folder[0])[name](d)
    assert ids(out) == ids(d)
    one = [tuple(x) for x in out.where("doc_id = 1").drop("text").collect()]
    assert len(one) == 3 and one.count(one[0]) + one.count(one[1]) >= 2  # repeated rows end alike


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op10"])
def test_empty_tables_give_no_rows(spark, table, folder, name):
    assert operators(spark, folder[0])[name](table.limit(0)).count() == 0


def test_pages_and_vectors_with_odd_rows(spark):
    p = spark.createDataFrame([(1, "http://h/a", "<p>x</p>", 0), (1, "http://h/a", "<p>x</p>", 0), (None, None, None, 0), (2, "http://h/b", "", 0), (3, "no scheme", "<div>" * 3000 + "deep" + "</div>" * 3000, 0), (4, "http://h/c", "<i>a</i>" * 20_000, 0)], "page_id long, url string, html string, host int")
    rules = [url_filter.Rule("h", "/a", "block")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(p, rules).collect()}
    assert got == {1: "block", None: "allow", 2: "allow", 3: "allow", 4: "allow"} and url_filter.filter_urls(p, rules).count() == 6
    text = html_extraction.extract_main_text(p).collect()
    assert len(text) == 6 and {r["page_id"]: r["text"] for r in text}[3] == "deep"
    assert url_filter.filter_urls(p.limit(0), rules).count() == html_extraction.extract_main_text(p.limit(0)).count() == 0
    v = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [1.0]), (2, [1.0]), (None, [1.0])], "vec_id long, embedding array<double>").withColumn("w", F.lit(0)).withColumn("cb", F.lit(1))
    assert [tuple(r) for r in topk_search.top_k(v.where("vec_id = 1"), v, k=2).orderBy("rank").collect()] == [(1, 1, 2, 256 * 256), (1, 2, 2, 256 * 256)]


def test_constant_blocks_leave_the_content(spark):
    page = "<body><nav>menu</nav><article><h1>T{0}</h1><p>Read our terms before you go</p><p>Story {0} goes on.</p></article><div id='comments'><p>long comment {0} and more and more</p></div></body>"
    story = "<body><div class='promotion-story'><p>Story {0} goes on for a while and longer.</p></div><div>x{0}</div></body>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(8)] + [(100 + i, f"http://g/{i}", story.format(i)) for i in range(4)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = None
    for n in (1, 4, 13):
        got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(d.repartition(n)).collect()}
        assert first is None or got == first
        first = got
    assert first[3] == "T3\nStory 3 goes on." and first[101] == "Story 1 goes on for a while and longer."


def test_stages_keep_clashing_columns_apart_and_take_odd_rows(spark, table, folder):
    d = table.unionByName(spark.createDataFrame(folder[1], "doc_id long, text string"), allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, folder[0])
        assert len(set(out.columns)) == len(out.columns) and out.count() > 0
        assert stage(spark, d.limit(0), folder[0]).count() == 0
    kept = toxicity.drop_toxic(d, spark.read.parquet(f"{folder[0]}/labels.parquet"))
    assert kept.columns == d.columns
    assert ngram_join.keep_one_of_each(d).columns == d.columns
    assert [c for c in line_dedup.dedup_lines(d).columns if c not in ("n_lines", "n_removed")] == d.columns


def test_pipeline_takes_what_its_stages_take(spark, tmp_path):
    """Planted cases: a toxic document, a repeated passage, a near copy, a benchmark passage; clean documents stay."""
    r = random.Random(7)
    text = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    clean = [(i, text(40), "en", f"s{i % 2}") for i in range(40)]
    toxic = [(100 + i, f"{text(4)} you zzgrub horrid zzgrub scum zzgrub", "en", "s0") for i in range(40)]
    item, passage = text(30), text(60)
    w = clean[0][1].split()
    planted = [(200, " ".join([*w[:38], "p", "q"]), "en", "s1"), (201, f"{text(10)} {item} {text(10)}", "en", "s1"), (202, f"{passage}\n{text(30)}", "en", "s1"), (203, f"{text(30)}\n{passage}", "en", "s1")]
    spark.createDataFrame([*clean, *toxic, *planted], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert not any(100 <= i < 140 for i in seen["toxicity"]) and set(range(40)) <= set(seen["toxicity"])
    assert passage in seen["line_dedup"][202] and passage not in seen["line_dedup"][203]
    assert set(range(1, 40)) <= set(seen["benchmark_decontamination"]) and 201 not in seen["benchmark_decontamination"]
    assert 0 in seen["ngram_jaccard_join"] and 200 not in seen["ngram_jaccard_join"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in out.collect()} <= set(seen["benchmark_decontamination"])


def test_line_dedup_with_frequent_tokens_equals_brute_force(spark, monkeypatch):
    """Low limits, so that tokens are reordered by counts, lists are dealt to parts, and undecided lines meet all others."""
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "_PART", 3)
    r = random.Random(4)
    base = [f"b{i}" for i in range(24)]
    lines = []
    for _ in range(60):
        w = list(base)
        for i in r.sample(range(24), r.randrange(0, 4)):
            w[i] = f"x{r.randrange(6)}"
        lines.append(" ".join(w[: r.randrange(18, 25)]))
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, 60, 4)]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for ln in t.split("\n"):
            s = grams(ln)
            if not any(100 * len(s & o) >= 75 * len(s | o) for o in seen):
                kept.append(ln)
            seen.append(s)
        want[i] = "\n".join(kept)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(d).collect()} == want


def test_blocks_over_chains_of_links_equal_union_find(spark):
    r, n = random.Random(9), 300
    to = {i: r.randrange(n) for i in range(n) if r.random() < 0.7}
    tag = lambda j: f'<link rel="canonical" href="{r.choice([f"http://h{j % 7}.net/p{j}", f"//h{j % 7}.net/p{j}"])}">'
    rows = [(i, f"http://h{i % 7}.net/p{i}", tag(to[i]) if i in to else None) for i in range(n)]
    bad = {i for i in range(n) if i % 7 == 3 and str(i).startswith("1")}
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in to.items():
        parent[find(i)] = find(j)
    blocked = {find(i) for i in bad}
    rules = [url_filter.Rule("h3.net", "/p1", "block"), url_filter.Rule("h5.net", "/", "allow")]
    got = {x["page_id"]: x["verdict"] for x in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {i: "allow" if i % 7 == 5 else "block" if find(i) in blocked else "allow" for i in range(n)}


def test_url_query_equals_its_sql_on_pages_with_links(spark, tmp_path):
    """Absolute, relative and redirecting links, encoded ampersands, chains; the tables of the driver hold none."""
    import duckdb

    from termforge.llm import oracles, queries

    r = random.Random(11)
    sites = ["example.com", "example.org", "a.example.com", "b.net"]
    urls = [f"http://{s}/{p}{q}" for s in sites for p in ("", "de/1", "fr/2", "es/3", "en/1", "x/y", "z") for q in ("", "?a=1&b=2")]
    def tag():
        to = r.choice([r.choice(urls).replace("&", "&amp;"), "/de/1", "2", "?q=1", "//b.net/z", "https://example.com/x/y", "#top"])
        return r.choice([f'<link rel="canonical" href="{to}">', f"<LINK href='{to}' rel='alternate Canonical'>", f'<meta http-equiv="Refresh" content="0; url={to}">', "<p>none</p>", f'<link rel="alternate" href="{to}">'])
    rows = [(i, u, f"<head>{tag()}</head>") for i, u in enumerate(urls * 2)] + [(900, None, tag()), (901, "nourl", tag()), (902, "http://b.net/none", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"select {', '.join(names)} from ({oracles.OP8}) order by page_id").fetchall()
    got = [tuple(x) for x in queries.op8(spark, str(tmp_path)).select(*names).orderBy("page_id").collect()]
    assert got == want and {x[4] for x in got if x[3] is None} == {"allow", "block"}


def test_bits_differ_in_no_more_places_than_tokens(spark):
    r = random.Random(5)
    sets = [sorted({r.randrange(-(2**63), 2**63) for _ in range(n)}) for n in (0, 1, 2, 30, 30, 300)]
    sets += [s[k:] + [r.randrange(2**62)] for s in sets[3:] for k in (0, 1, 7)]
    rows = spark.createDataFrame(list(enumerate(sets)), "ord long, tokens array<long>")
    bits = {x["ord"]: [b & (2**64 - 1) for b in x["bits"]] for x in line_dedup._bits(rows).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = sum((x ^ y).bit_count() for x, y in zip(bits[i], bits[j]))
            assert differ <= len(set(a) ^ set(b)) and (differ > 0 or len(set(a) ^ set(b)) % 2 == 0)
    assert len({tuple(b) for b in bits.values()}) > 8


def test_whole_token_sets_are_gone_before_postings_are_dealt(spark, monkeypatch):
    """Lines that share a frequent token: when lists are saved, no table of whole token sets is kept."""
    monkeypatch.setattr(line_dedup, "HOT", 2)
    texts = [f"a b c d e f{i % 5} g{i} h i j k{i}" for i in range(12)]
    saved, gone, kept = [], set(), []
    save, discard = storage.Scratch.save, storage.Scratch.discard

    def record(self, df):
        out = save(self, df)
        if "head" in out.columns:
            kept.append([x for x in saved if "tokens" in x.columns and x._scratch_path not in gone])
        saved.append(out)
        return out

    monkeypatch.setattr(storage.Scratch, "save", record)
    monkeypatch.setattr(storage.Scratch, "discard", lambda self, df: (gone.add(df._scratch_path), discard(self, df))[1])
    line_dedup.similar_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [x for x in saved if "tokens" in x.columns] and kept == [[]]


def test_like_lines_without_a_central_one_make_few_pairs(spark, monkeypatch):
    """Variants of one line that are like it, but hardly like each other: few pairs are left, dealt over parts."""
    monkeypatch.setattr(line_dedup, "_PART", 8)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(60):
        w = list(base)
        for i in (k, (k + 30) % 60):
            w[i] = f"x{k}"
        texts.append(" ".join(w))
    texts.insert(40, " ".join(base))
    saved = []
    save = storage.Scratch.save
    monkeypatch.setattr(storage.Scratch, "save", lambda self, df: (saved.append(out := save(self, df)), out)[1])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = storage.Scratch(spark)
    gone = {r["k_doc"] for r in line_dedup.similar_lines(table, scratch=scratch).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    assert gone == {j for j in range(61) if any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for i in range(j))}
    pairs = [s.count() for s in saved if s.columns == ["x", "y"]]
    assert len(pairs) == 2 and sum(pairs) < 61 * 60 / 4


def test_edited_copies_unlike_their_hub_are_not_open_with_the_whole_group(spark, monkeypatch):
    """Copies with more edits than their hub allows, like some of the others: pairs to verify stay in proportion."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(120):
        w = list(base)
        for i in r.sample(range(2, 148, 8), 2 if k % 3 else 5 + k % 2):
            w[i] = f"e{i}"
        texts.append(" ".join(w))
    saved = []
    save = storage.Scratch.save
    monkeypatch.setattr(storage.Scratch, "save", lambda self, df: (saved.append(out := save(self, df)), out)[1])
    monkeypatch.setattr(storage.Scratch, "discard", lambda self, df: None)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(ngram_join.near_duplicates(table).select("doc_id", "component_id").collect())
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    comp = list(range(len(texts)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == dict(enumerate(comp))
    assert max(s.count() for s in saved if s.columns == ["a", "b"]) < 3 * len(texts)


def test_a_notice_on_most_pages_leaves_all_of_them(spark):
    """A block on 49 of 50 pages is constant, one on 40 of 50 is content; an odd page and the partitions change nothing."""
    page = "<body><div class='box'><p>Read our terms before you go</p>{1}<p>Story {0} goes on.</p></div></body>"
    rows = [(i, f"http://h/{i}", page.format(i, "<p>Shared line of many stories</p>" if i < 40 else "")) for i in range(49)]
    rows.append((49, "http://h/49", "<body><h1>Not found</h1></body>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "Shared line of many stories\n" * (i < 40) + f"Story {i} goes on." for i in range(49)} | {49: "Not found"}
    for n in (1, 7):
        assert {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(d.repartition(n)).collect()} == want
