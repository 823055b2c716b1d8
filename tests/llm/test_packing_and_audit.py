"""Packing, fill-in-middle and the filter audit against brute force, exact round trips and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.llm import fill_in_middle, filter_audit, packing, queries

ODD = ["", None, " \t\n\v\f\r ", "One two", "One two", "café Σίσυφος ΣΑΣ 東京 x́ ́y  a b c", "<|endoftext|> and<|startoftext|>x", "it's 42 o'clock!?", "A" * 300, "-\x00-\x1c-\x85-", "<P>", "a<S>b", "x < M > <", "S><P<M", "日本語テキスト" * 40]


def odd_table(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(2, ODD[2]), (None, "no id"), (None, None), (77, " ".join(f"Word{i % 991}" for i in range(30_000)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({c: F.lit(1) for c in ("n", "form", "ids", "offset", "mask", "part", "d", "h", "output")}), rows


def whole_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for x in texts]


@pytest.mark.parametrize(("capacity", "limit"), [(4096, 1024), (64, 3)])
def test_pieces_rebuild_every_document_and_fill_every_sequence(spark, capacity, limit):
    d, rows = odd_table(spark)
    out = packing.pack_documents(d.repartition(3, "text"), capacity=capacity, open_windows=limit).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["doc_id"], r["doc_tokens"])].append((r["start"], bytes(r["ids"])))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    want = defaultdict(list)
    for (i, _), ids in zip(rows, whole_ids([t for _, t in rows])):
        want[(i, len(ids))].append(ids.tobytes())
    assert set(want) == set(pieces)
    for key, bodies in want.items():
        got = sorted(pieces[key])
        if len(bodies) == 1:
            assert b"".join(b for _, b in got) == bodies[0] and [s for s, _ in got] == list(itertools.accumulate([0, *[len(b) // 4 for _, b in got]]))[:-1]
        else:
            assert sum(len(b) for _, b in got) == sum(map(len, bodies))


def test_items_go_where_the_sum_of_squares_is_least():
    """Every choice equals a search over all levels; the level array equals a count of the windows."""
    r, packer, c = random.Random(5), packing.Packer(16, 10**6), 16
    for _ in range(3000):
        size = r.randrange(1, 17)
        levels = sorted(x for x, w in packer.at.items() if w)

        def squares(level):
            n = packer.counts.copy()
            n[level] -= level > 0
            n[level + size] += 1
            return int((n[1:c] ** 2).sum())

        chosen = packer.best_level(size)
        assert squares(chosen) == min(squares(x) for x in [0, *levels] if x + size <= c)
        packer.add(None, b"\0\0\0\0" * size)
        for level, windows in packer.at.items():
            assert packer.counts[level] == len(windows) and all(w.level == level for w in windows)
    assert packer.open < 200
    packer.finish()
    assert packer.open == 0 and not packer.counts.any()


def test_open_windows_are_bounded():
    packer = packing.Packer(100, 8)
    for _ in range(500):
        packer.add(None, b"\0\0\0\0" * 51)
        assert packer.open <= 9
    packer.finish()
    assert sum(w.level for w in packer.closed) == 500 * 51


def test_fill_in_middle_equals_a_plain_version(spark):
    d, rows = odd_table(spark)
    rows = [*rows, *[(1000 + i, f"Text {i}, with <b> and é{i}\n" * (i % 9)) for i in range(300)]]
    d = d.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(rows) - 300 :], "doc_id long, text string"))

    def plain(i, t):
        t = t or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        n = len(u)
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            return i, n, "plain", None, None, t, t
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if h[3] % 100 < 20:
            return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
        return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t

    got = fill_in_middle.fill_in_middle(d).withColumn("back", fill_in_middle.restored())
    key = lambda x: (x[0] is not None, x[0], x[5])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain(*x) for x in rows), key=key)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(d.limit(0)).count() == packing.pack_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["ab1 " * 50, "x" * 500, "é", "a", "", "-" * 70, "abc" * 30 + "-" + "z" * 90])
def test_chunks_end_between_units(monkeypatch, text):
    monkeypatch.setattr(fill_in_middle, "CHUNK", 7)
    assert fill_in_middle.UnitOffsets()(text).tolist() == [m.start() for m in re.finditer(fill_in_middle.UNITS, text)]


def test_marks_that_pieces_could_form_at_their_ends(spark):
    parts = ["<", "<P", "P>", ">", "S>", "<S", "<<S", "M>", ""]
    rows = [("psm", f"<P>{a}<S>{c}<M>{b}", a + b + c) for a in parts for b in parts for c in parts] + [("spm", f"<S>{c}<P>{a}<M>{b}", a + b + c) for a in parts for b in parts for c in parts]
    d = spark.createDataFrame(rows, "form string, output string, want string")
    assert d.where(fill_in_middle.restored() != F.col("want")).count() == 0


def test_audit_equals_a_replay_of_all_orders(spark):
    r = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma", "Delta", "x", "y", "Beta"]
    texts = [" ".join(r.choice(vocabulary if i % 2 else [f"w{k}" for k in range(400)]) for _ in range(r.choice([3, 150, 199, 200, 260]))) + r.choice(["", "", " #", "&"]) for i in range(60)]
    texts += [texts[0], texts[0], texts[5], None, "", " \t", "ABC", None]
    rows = [(i * 3 % 71, t, r.choice(["a", "b", "", None])) for i, t in enumerate(texts)] + [(None, texts[1], "a"), (None, None, None), (3, texts[1], "a"), (3, texts[1], "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 70, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit(9)).withColumn("part", F.lit("z"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = {}
    for part in {s or "" for _, _, s in rows}:
        docs = []
        for i, t, s in rows:
            if (s or "") == part:
                t = t or ""
                w = re.findall(r"[^\x20\x09-\x0D]+", t)
                fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
                docs.append((i, {k for k, v in fails.items() if v}))
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(out)
                want[(part, "".join(order), step)] = [len(left), len(out), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in docs), sum(x[0] in good and x[0] is not None for x in out), sum(x[0] in toxic and x[0] is not None for x in out), f]
                gone = gone + out
        for k, v in want.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for x in filter_audit.audit_filters(d, lab).collect()}
    assert got == want and len(got) == 600 * 3
    assert filter_audit.audit_filters(d.limit(0), lab).count() == 0
    assert filter_audit.audit_filters(d, lab.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_parity_sums_invert_to_the_masks(spark):
    r = random.Random(8)
    rows = [("p", r.randrange(32), r.random() < 0.3, r.random() < 0.2) for _ in range(500)]
    d = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
    out = filter_audit.cells(filter_audit.parity_sums(d, 5), 5).first()
    assert out["all_docs"] == [sum(x[1] == m for x in rows) for m in range(32)]
    assert out["good_docs"] == [sum(x[1] == m and x[2] for x in rows) for m in range(32)]
    assert out["toxic_docs"] == [sum(x[1] == m and x[3] for x in rows) for m in range(32)]


def test_packing_query_gives_the_checksum_of_the_ids(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = whole_ids(["one two three"])[0]
    assert [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in queries.op11(spark, str(tmp_path)).collect()] == [(1, 0, 4, zlib.crc32(ids.tobytes()), 4, 0)]
