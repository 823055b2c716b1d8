"""Readers, writers and harvesting against offline fixtures; the stateful forms in started streams."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from termforge.sources import harvest, readers
from termforge.streaming import state

ENTRY = "<entry><id>{0}</id><title>T\n{0}</title><summary>A {0}</summary><published>2024-01-0{1}</published><category term='cs.X'/></entry>"


def feed(*entries):
    return "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join(ENTRY.format(*e) for e in entries) + "</feed>"


def test_atom_folder_is_a_data_source(spark, tmp_path):
    for cat, pages in {"a": [feed(("1", 1), ("2", 2))], "b": [feed(("3", 3)), feed()]}.items():
        (tmp_path / cat).mkdir()
        for i, p in enumerate(pages):
            (tmp_path / cat / f"{i}.xml").write_text(p)
    spark.dataSource.register(harvest.AtomFolder)
    got = spark.read.format("atom_folder").load(str(tmp_path))
    assert sorted((r["category"], r["id"], r["title"], r["categories"]) for r in got.collect()) == [("a", "1", "T 1", ["cs.X"]), ("a", "2", "T 2", ["cs.X"]), ("b", "3", "T 3", ["cs.X"])]


def test_retry_pauses_grow_and_end():
    pauses, tries = [], iter([harvest.HttpError(429), OSError("x"), "rows"])

    def fetch():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert harvest.with_retry(fetch, base=10.0, sleep=pauses.append) == "rows" and pauses == [10.0, 60.0]
    for status, kind in ((404, harvest.HttpError), (403, harvest.FatalHttpError)):
        with pytest.raises(kind):
            harvest.with_retry(lambda: (_ for _ in ()).throw(harvest.HttpError(status)), fatal=(403,), sleep=pauses.append)


def test_harvest_goes_back_and_resumes():
    data = {date(2024, 1, 31): [["a", "b"], ["b", "c"]], date(2024, 1, 21): [["d"]]}

    def page(first, end, start):
        pages, at = data.get(end, []), 0
        for p in pages:
            if at == start:
                return [{"id": i} for i in p]
            at += len(p)
        return []

    p = harvest.Progress()
    rows = [r["id"] for r in harvest.harvest_back(page, known={"a"}, target=9, last=date(2024, 1, 31), days=10, progress=p)]
    assert rows == ["b", "c", "d"] and (p.kept, p.duplicates, p.reason) == (3, 2, "empty_slice")
    assert [r["id"] for r in harvest.harvest_back(page, known=set(), target=1, last=date(2024, 1, 31), days=10)] == ["a"]


def test_cursors_offsets_and_priorities():
    pages = {"*": ([{"id": 1}, {"id": 2}], "x"), "x": ([{"id": 3}], None)}
    assert [r["id"] for r in harvest.cursor_rows(pages.__getitem__, 9)] == [1, 2, 3]
    assert list(harvest.offset_rows(lambda n: [n, n + 1] if n < 4 else [], 3)) == [0, 1, 2]
    name, rows, failed = harvest.first_that_works([("a", lambda: 1 / 0), ("b", list), ("c", lambda: [{"id": 1}])])
    assert (name, len(rows), len(failed)) == ("c", 1, 2)
    assert harvest.filter_text(["C1", "C2"], 2020) == "from_publication_date:2020-01-01,has_abstract:true,concepts.id:C1|C2"


def test_artifacts_and_evidence(tmp_path):
    (tmp_path / "big").write_text("x" * 17)
    (tmp_path / "small").write_text("x" * 16)
    (tmp_path / "ev.json").write_text('{"A::x": [{"t": 1}, "bad"], "B": 3}')
    assert harvest.missing_artifacts({n: str(tmp_path / n) for n in ("big", "small", "none")}) == ["small", "none"]
    assert harvest.evidence_index(str(tmp_path / "ev.json")) == {"A::x": [{"t": 1}]} and harvest.evidence_index("/none") == {}
    assert harvest.settings(str(tmp_path / "ev.json"))["B"] == 3


def test_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("1", "s", "A", "t", "x", "p", "u", "l", ["c"])], readers.RAW)
    readers.write_jsonl(d, f"{tmp_path}/j.jsonl")
    readers.write_jsonl(d, f"{tmp_path}/j.jsonl", append=True)
    assert readers.read_corpus(spark, f"{tmp_path}/j.jsonl").count() == 2
    readers.write_corpus(d, f"{tmp_path}/p.parquet")
    both = readers.read_many([readers.read_corpus(spark, f"{tmp_path}/p.parquet"), d.select("id", F.lit(1).alias("extra"))])
    assert both.count() == 2 and "extra" in both.columns
    plain = d.drop("domain")
    plain.write.parquet(f"{tmp_path}/q.parquet")
    assert [r["domain"] for r in readers.read_mapped(spark, {f"{tmp_path}/q.parquet": "B"}).collect()] == ["B"]
    s = spark.createDataFrame([("A", "x y", 0.5)], "domain string, term string, log_odds double")
    readers.write_term_stats(s, f"{tmp_path}/s.csv")
    assert [tuple(r) for r in readers.read_term_stats(spark, f"{tmp_path}/s.csv").collect()] == [("A", "x y", 0.5, 0.0, 2)]


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:00', 1L, 'a', 2.0D), (1L, timestamp'2024-01-01 00:00:01', 1L, 'a', 2.0D), (2L, timestamp'2024-01-01 00:01:00', 1L, 'b', 3.0D) t(event_id, ts, user_id, event_type, value)")
    rows.write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")


def test_arms_of_a_stream(spark, events, tmp_path):
    q = state.running_arms(events).writeStream.format("memory").queryName("arms").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("arms").collect())) == [(1, "a", 2, 4.0), (1, "b", 1, 3.0)]


def test_stream_of_feedback_has_each_id_once(spark, events, tmp_path):
    q = state.append_feedback(state.first_seen(events), f"{tmp_path}/out", f"{tmp_path}/c2")
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    again = state.append_feedback(state.first_seen(events), f"{tmp_path}/out", f"{tmp_path}/c2")
    again.processAllAvailable()
    again.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
