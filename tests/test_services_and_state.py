"""Services as data sources with offline fetchers, the stream that goes back in time, stateful operators in started and
restarted streams, calls from executors, reports, evidence and moves between stored domains."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from termforge.operators import corpus, evidence, generation
from termforge.sources import harvest, report, services
from termforge.streaming import state

FAST = {"backoff": "0.001", "retries": "2"}


def test_query_source_ends_at_target_or_a_short_page(spark):
    def fetch(query, start, size):
        if query == "bad" and start == 0:
            return []
        rows = [{"id": f"{query}-{i // 2}", "title": "t", "categories": ["c"]} for i in range(7)]
        return rows[start : start + size]

    spark.dataSource.register(services.query_source("q_rows", fetch, {"A": "a", "B": "b", "C": "bad"}))
    got = spark.read.format("q_rows").options(page_size=3, **FAST).load()
    assert sorted((r["domain"], r["id"]) for r in got.collect()) == [(d, f"{d.lower()}-{i}") for d in "AB" for i in range(4)]
    assert got.columns[:3] == ["id", "source", "domain"] and got.first()["source"] == "q_rows"
    assert spark.read.format("q_rows").options(page_size=3, target=2, **FAST).load().groupBy("domain").count().collect()[0]["count"] == 2


def test_filters_leave_partitions_out():
    from pyspark.sql.datasource import EqualTo, In

    reader = services.query_source("x", None, {"A": "a", "B": "b", "C": "c"})({"push_filters": "true"}).reader(None)
    other = EqualTo(("title",), "t")
    assert list(reader.pushFilters([In(("domain",), ("A", "B")), other, EqualTo(("domain",), "B")])) == [other]
    assert [p.value for p in reader.partitions()] == ["B"]


def test_pushed_filters_reach_the_source(spark):
    def fetch(query, start, size):
        if query == "b":
            raise ValueError("read although filtered out")
        return [{"id": "1"}] if start == 0 else []

    spark.dataSource.register(services.query_source("q_pushed", fetch, {"A": "a", "B": "b"}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r["id"] for r in spark.read.format("q_pushed").options(push_filters=True, **FAST).load().where("domain = 'A'").collect()] == ["1"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_cursor_source_falls_back_and_tells_domains(spark):
    long = {f"w{i}": [i] for i in range(60)}

    def fetch(text, cursor):
        from termforge.sources.harvest import HttpError

        if "display_name" in text:
            raise HttpError(400)
        assert text.endswith("concepts.id:C1|C2") and "has_abstract:true" in text
        concept = lambda i, s: {"id": f"https://x/{i}", "display_name": i, "score": s}
        pages = {
            "*": ([{"id": "1", "display_name": "On a Reactor", "abstract_inverted_index": long, "concepts": [concept("C185592680", 0.2)], "publication_year": 2020}, {"id": "2", "display_name": "Short", "abstract_inverted_index": {"a": [0]}}], "x"),
            "x": ([{"id": "3", "display_name": "Bonds", "abstract_inverted_index": {**long, "late": [0, "odd"], "bad": 7}, "concepts": [concept("C178790620", 0.9), concept("C185592680", 0.1), "junk"]}, {"id": "", "abstract_inverted_index": long}, {"id": "3", "display_name": "Bonds", "abstract_inverted_index": long}, {"id": "4", "display_name": "Engines", "abstract_inverted_index": long, "concepts": [concept("C185592680", 0.9)]}], None),
        }
        return pages[cursor]

    spark.dataSource.register(services.cursor_source("works", fetch, {"chemistry": ["C1", "C2"]}))
    works = spark.read.format("works").options(from_year=2015, **FAST).load()
    assert works.count() == 6
    chem = services.works_of_domain(works, "CHEM").collect()
    assert [(r["id"], r["categories"]) for r in chem] == [("3", ["C178790620", "C185592680"])] and chem[0]["abstract"].split()[1] == "w1"
    assert [(r["id"], r["year"]) for r in services.works_of_domain(works, "CHEME").collect()] == [("1", 2020)]
    assert services.works_of_domain(works, "CHEM", ["nothing"]).count() == 0
    no_ids = services.cursor_source("none", fetch, {"c": []})({}).reader(None)
    with pytest.raises(harvest.HttpError):
        list(no_ids.read(no_ids.partitions()[0]))


def test_the_later_token_wins_a_position(spark):
    d = spark.sql("select map('b', array(1), 'a', array(0, 1), 'z', array(3)) as m union all select cast(map() as map<string,array<int>>) union all select null")
    assert [r[0] for r in d.select(services.abstract_of("m")).collect()] == ["a a z", "", None]


def test_offset_source_reads_pages_in_parts(spark):
    items = [{"slug": f"s{i}", "title": f" T{i} ", "description": "d", "categories": [{"name": "Catalysis"}, "x"] if i % 2 else []} for i in range(23)]

    def fetch(skip, limit):
        return items[skip : skip + limit]

    spark.dataSource.register(services.offset_source("items", fetch))
    raw = spark.read.format("items").options(page_size=5, parts=3, **FAST).load()
    rows = services.preprint_rows(raw.unionByName(raw).unionByName(spark.createDataFrame([("{no json",), ('{"title": "x"}',)], "value string")), "CCE", ["catalysis"])
    assert sorted(r["id"] for r in rows.collect()) == sorted(f"s{i}" for i in range(1, 23, 2))
    assert rows.where("id = 's1'").first()["title"] == "T1" and rows.where("id = 's1'").first()["categories"] == ["Catalysis", "x"]
    assert spark.read.format("items").options(page_size=5, max_results=12, **FAST).load().count() == 12

    def closed(skip, limit):
        from termforge.sources.harvest import HttpError

        raise HttpError(403)

    reader = services.offset_source("closed", closed)(FAST).reader(None)
    with pytest.raises(harvest.FatalHttpError):
        list(reader.read(reader.partitions()[0]))


def test_atom_files_are_read_where_they_are(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>T\n1</title><category term='c'/></entry></feed>")
    (tmp_path / "2.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'/>")
    got = services.atom_pages(spark, str(tmp_path)).collect()
    assert [(r["id"], r["title"], r["categories"]) for r in got] == [("1", "T 1", ["c"])] and got[0]["path"].endswith("1.xml")


# --- the stream back in time


def pages_of(days):
    def fetch(category, day, start, size):
        return [{"id": x, "title": category} for x in days.get((category, day), [])[start : start + size]]

    return fetch


def offsets(reader, most=50):
    at, rows = reader.initialOffset(), []
    for _ in range(most):
        got, to = reader.read(at)
        got = [r[0] for r in got]
        assert [r[0] for r in reader.readBetweenOffsets(at, to)] == got
        rows += got
        if to == at:
            return rows, at
        at = json.loads(json.dumps(to))
    raise AssertionError("never done")


def test_slices_go_back_until_something_ends_them():
    days = {("a", "2024-01-31"): list("abcde"), ("a", "2024-01-21"): list("efg"), ("b", "2024-01-31"): ["x", "x", "y"]}
    make = lambda **o: services.category_stream("s", pages_of(days), {"a": "A", "b": "B"})({"last_day": "2024-01-31", "slice_days": "10", "page_size": "2", **FAST, **{k: str(v) for k, v in o.items()}}).simpleStreamReader(None)
    rows, end = offsets(make())
    assert sorted(rows) == sorted("abcdefg" + "xy") and {c: (x["done"], x["kept"]) for c, x in end.items()} == {"a": ("empty_slice", 7), "b": ("empty_slice", 2)}
    rows, end = offsets(make(target=3))
    assert sorted(rows) == sorted("abcxy") and end["a"]["done"] == "target"
    rows, end = offsets(make(max_slices=1))
    assert end["a"]["done"] == "slices" and sorted(rows) == sorted("abcdexy")
    stale = {("a", "2024-01-31"): ["p", "p", "p", "p", "p", "p", "q", "r"]}
    reader = services.category_stream("s", pages_of(stale), {"a": "A"})({"last_day": "2024-01-31", "slice_days": "10", "page_size": "2", "stale_pages": "2", **FAST}).simpleStreamReader(None)
    assert offsets(reader)[0] == ["p"]


def test_a_restarted_harvest_goes_on_where_it_left(spark, tmp_path):
    days = {("a", "2024-01-31"): [f"i{k}" for k in range(6)], ("a", "2024-01-21"): ["i5", "j1", "j2"]}
    spark.dataSource.register(services.category_stream("back", pages_of(days), {"a": "A"}))
    stored = spark.createDataFrame([("i2",)], "id string")

    def run(max_batches):
        s = spark.readStream.format("back").options(last_day="2024-01-31", slice_days=10, page_size=2, **FAST).load()
        q = services.new_rows(s, stored).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(processingTime="0 seconds").start()
        import time

        end = time.time() + 60
        while time.time() < end and q.isActive and (q.lastProgress is None or q.lastProgress["batchId"] + 1 < max_batches):
            time.sleep(0.1)
        q.stop()
        return sorted(r["id"] for r in spark.read.schema(services.ROW).parquet(f"{tmp_path}/out").collect())

    first = run(1)
    second = run(9)
    assert set(first) <= set(second) and second == ["i0", "i1", "i3", "i4", "i5", "j1", "j2"]


# --- state


def plain_ttl(rows, seconds):
    out, written = {}, {}
    for user, kind, t, event in sorted(rows, key=lambda r: (r[2], r[3])):
        hit = (user, kind) in written and t - written[user, kind] <= seconds
        if not hit:
            written[user, kind] = t
        out[event] = hit
    return out


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_cache_of_a_stream_hits_as_in_batch(spark, tmp_path, rocks):
    r = random.Random(1)
    rows = [(r.randrange(3), r.choice("ab"), 60 * i + r.randrange(50), i) for i in range(60)]
    want = plain_ttl(rows, 200)
    d = spark.createDataFrame(rows, "user_id long, event_type string, t long, event_id long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    assert {x["event_id"]: x["hit"] for x in state.ttl_hits(d, 200).collect()} == want and len(set(want.values())) == 2
    for k in range(3):
        d.where(f"event_id div 20 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run(n):
        s = spark.readStream.schema(d.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = state.ttl_stream(s, 200).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    run(1)
    late = [(1, "a", 60 * 61, 100), (1, "a", 60 * 62, 101)]
    more = spark.createDataFrame(late, "user_id long, event_type string, t long, event_id long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    more.coalesce(1).write.parquet(f"{tmp_path}/in/9")
    run(2)  # a restarted query still knows what was written
    got = {x["event_id"]: x["hit"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain_ttl(rows + late, 200)


def plain_bandit(rows, actions, epsilon, seed):
    arms, out = {}, {}
    for route, ts, event, rewards in sorted(rows, key=lambda r: (r[1], r[2])):
        own = arms.setdefault(route, {a: [0, 0.0] for a in actions})
        u, k = state.draw(seed, event)
        if u < epsilon:
            action = actions[k % len(actions)]
        else:
            best = max(v[1] / v[0] if v[0] else 0.0 for v in own.values())
            action = next(a for a in actions if (own[a][1] / own[a][0] if own[a][0] else 0.0) == best)
        own[action][0] += 1
        own[action][1] += rewards.get(action, 0.0)
        out[event] = (route, action, u < epsilon)
    return out


def test_bandit_chooses_and_learns_alike_in_batch_and_stream(spark, tmp_path, rocks):
    r, actions = random.Random(2), ["literal", "steered", "framing"]
    rows = [(f"r{i % 2}", i, i, {a: round(r.random() * (k + 1) / 3, 3) for k, a in enumerate(actions)}) for i in range(400)]
    want = plain_bandit(rows, actions, 0.2, 7)
    d = spark.createDataFrame(rows, "route string, ts long, event_id long, rewards map<string,double>")
    pick = lambda df: {x["event_id"]: (x["route"], x["action"], x["explored"]) for x in df.collect()}
    assert pick(state.bandit_choices(d, actions, seed=7)) == want
    explored = sum(x[2] for x in want.values())
    assert 0.13 < explored / 400 < 0.27
    assert sum(x[1] == "framing" for x in list(want.values())[200:]) > 120
    for k in range(2):
        d.where(f"event_id div 200 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        s = spark.readStream.schema(d.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sink = lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")
        q = state.bandit_stream(s, actions, seed=7).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").outputMode("update").start()
        q.processAllAvailable()
        q.stop()
    assert pick(spark.read.parquet(f"{tmp_path}/out")) == want


# --- calls, reports, evidence, stored domains


def test_failed_requests_are_rows(spark):
    def make():
        def client(request):
            if request["text"] == "boom":
                raise TimeoutError("timed out")
            if request["text"] == "odd":
                return 500, "no json"
            return 200, {"best_candidate": request["text"].upper(), "k": request["k"]}

        return client

    cases = spark.createDataFrame([("c1", "A", "B", "fine"), ("c2", "A", "B", "boom"), (None, "A", "B", "odd")], "id string, src string, tgt string, text string").coalesce(1)
    got = {r["text"]: r for r in generation.run_cases(cases, make, k=3).collect()}
    assert got["fine"]["ok"] and json.loads(got["fine"]["response"]) == {"best_candidate": "FINE", "k": 3}
    assert (got["boom"]["status"], got["boom"]["ok"], json.loads(got["boom"]["response"])) == (0, False, {"detail": "request_error: timed out"})
    assert got["odd"]["status"] == 500 and json.loads(got["odd"]["response"]) == {"raw": "no json"} and got["odd"]["id"] == f"case_{got['odd']['index']}"


def test_models_are_asked_in_order(spark):
    def first():
        tries = {}

        def model(prompt, temperature, top_p):
            tries[prompt] = tries.get(prompt, 0) + 1
            if prompt.startswith("quota") and tries[prompt] < (3 if prompt == "quota once" else 99):
                raise RuntimeError("429 too many")
            if prompt in ("down", "all down", "slow"):
                raise RuntimeError("request timed out" if prompt == "slow" else "bad gateway")
            return f"one {prompt} {temperature}"

        return model

    def second():
        def model(prompt, temperature, top_p):
            if prompt != "down":
                raise RuntimeError("timeout" if prompt == "slow" else "RESOURCE_EXHAUSTED" if prompt == "quota" else "gone")
            return " two "

        return model

    def absent():
        from termforge.operators.generation import NotConfigured

        raise NotConfigured("API_KEY is not configured")

    p = spark.createDataFrame([(i, x, 0.2, f"f{i}") for i, x in enumerate(["fine", "quota once", "quota", "down", "all down", "slow"])], "id long, prompt string, temperature double, fallback string")
    got = {r["id"]: (r["text"], r["model"], r["reason"]) for r in generation.generate(p, [("a", first), ("b", second)], pause=0.0).collect()}
    assert got == {0: ("one fine 0.2", "a", None), 1: ("one quota once 0.2", "a", None), 2: ("f2", None, "api_error"), 3: ("two", "b", None), 4: ("f4", None, "other"), 5: ("f5", None, "timeout")}
    assert {r["reason"] for r in generation.generate(p, [("c", absent)], pause=0.0).collect()} == {"no_key"}


def test_reports_are_written_whole_or_not(spark, tmp_path):
    d = spark.createDataFrame([("A", "x", "abcd", "2001", "2020-01-01"), ("CHEM", "x", None, None, "2021-01-01"), ("A", "y", "ab", "2005", "bad")], "domain string, source string, abstract string, year string, published string")
    spark.dataSource.register(report.Report)
    place = f"{tmp_path}/r/report.md"
    write = lambda df, mode="overwrite", **o: df.write.format("report").mode(mode).option("path", place).options(title="Corpus Scale Report", **o).save()
    write(report.corpus_report(d))
    want = "# Corpus Scale Report\n\nTotal docs: 3\nAverage abstract length: 2.0\nYear distribution (min/max/median): 2001/2005/2003.0\n\n## Counts per domain\n- A: 2\n- CHEM: 1\n\n## Counts per source\n- x: 2\n- y: 1\n\n## CHEM vs CHEME\n- CHEM: 1\n- CHEME: 0\n"
    assert open(place).read() == want
    dates = report.corpus_report(d.withColumn("year", F.lit("unknown"))).where("section = 0 and pos = 2").first()["line"]
    assert dates == "Year distribution (min/max/median): 2020/2021/2020.5"
    for bad in (report.corpus_report(d).withColumn("line", F.when(F.col("section") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("line")).cast("string")), report.corpus_report(d)):
        with pytest.raises(Exception):  # noqa: B017
            write(bad, most_lines="3")
    assert open(place).read() == want and [x.name for x in (tmp_path / "r").iterdir()] == ["report.md"]
    empty = report.corpus_report(d.limit(0)).where("section = 0").orderBy("pos").collect()
    assert [r["line"] for r in empty] == ["Total docs: 0", "Average abstract length: 0.0", "Year distribution (min/max/median): 0/0/0.0"]


def test_evidence_passes_over_what_has_another_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({" B::X y ": [{"snippet": "s1", "doc_id": 7}, "bad", 3, None, {"source": "w"}], "c": {"snippet": "no list"}, "d": [], "e": 1}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[1, 2]")
    index = evidence.read_evidence(spark, str(tmp_path))
    got = sorted((r["key"], r["pos"], tuple(r["hit"])) for r in index.collect())
    assert got == [("b::x y", 0, ("s1", "7", "")), ("b::x y", 1, ("", "", "w"))]
    assert evidence.read_evidence(spark, f"{tmp_path}/none").count() == 0
    from termforge.operators import strategy

    rows = spark.createDataFrame([("b::x y",), ("other",)], "k string")
    assert {r["k"]: [h["source"] for h in r["evidence"]] for r in strategy.evidence_for(rows, index, "k", 2).collect()} == {"b::x y": ["", "w"], "other": []}


def test_rows_move_between_stored_domains(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [("1", "a", "CHEM"), ("2", "b", "CHEM"), ("3", "c", "CHEME"), ("9", "z", "PM")]
    spark.createDataFrame(rows, "id string, title string, domain string").write.partitionBy("domain").parquet(path)
    found = spark.createDataFrame([("2", "new b"), ("3", "other c"), ("4", "d"), ("4", "d"), (None, "x")], "id string, title string")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("id", "title", "domain").collect())
    want = [("1", "a", "CHEM"), ("2", "new b", "CHEME"), ("3", "c", "CHEME"), ("4", "d", "CHEME"), ("9", "z", "PM")]
    for _ in range(2):
        corpus.move_stored(found, path, "CHEME", "CHEM")
        spark.catalog.refreshByPath(path)
        assert read() == want
    corpus.move_stored(spark.createDataFrame([("1", "n")], "id string, title string"), path, "CHEME", "CHEM")
    spark.catalog.refreshByPath(path)
    assert [r for r in read() if r[2] == "CHEM"] == [] and ("1", "n", "CHEME") in read()
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_staged")]


def test_draws_are_even():
    u = [state.draw(3, i)[0] for i in range(4000)]
    assert math.isclose(sum(u) / 4000, 0.5, abs_tol=0.03) and state.draw(3, 5) == state.draw(3, 5) != state.draw(4, 5)
