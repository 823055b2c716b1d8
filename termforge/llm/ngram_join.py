"""Near-duplicate documents: an n-gram Jaccard join as a blocked sparse matrix product.

The document by n-gram incidence matrix is multiplied with its transpose column
block by column block.  A document's columns are ordered from rare to frequent,
by counts of all n-grams in a table of fixed size, and only its first
n - ceil(t n) + 1 columns can be the first that a similar document shares, so
only these enter the product (size-derived bound).  Documents with one set are
one row of the matrix.

Within a column the rows are first multiplied with one row of like size (the
hub, the one with the fewest columns of its own), which joins a large group of copies by a number of products linear in its
size.  Components of these links tell which products are still open: pairs in
one column but different components, within the size and position bounds.  Open
pairs are few, as frequent columns come last: a row that differs from a group's
hub has its own rare columns first, and what it shares with the group comes too
late for the positional bound.  For all candidates the product is completed over
their whole rows.

An edited copy that is not like its hub would be open with the whole group.  So
rows in wide columns of several components are first multiplied with a few rows of
these columns, chosen by hash, and the nearest of them is verified.  A bitmap of
a row, in which every column flips one bit, bounds the columns that two rows do
not share: no open pair beyond that bound leaves a wide column.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .components import connected_components
from .storage import Scratch, free_name

_COUNTER_BITS, _SEGMENTS, _BIT_SPACE = 22, 64, 1 << 23
_HOT_LEVEL = 16
#: Rows of a column, above which its products must keep the positional bound.
_WIDE = 64
#: Of a row's shared columns so many of the rarest and of the most frequent are searched for hubs.
_RARE, _FREQUENT = 4, 12
#: Longs of a row's bitmap.
_LONGS = 16
#: Rows of a wide column that its rows of other components are held against, and how many of them are verified for a row.
_TRIED, _NEAREST = 32, 2


def shingle_sets(column: pa.Array, k: int):
    """(row, distinct shingle hashes, ascending) of each row; fewer than k words make one shingle."""
    data, offsets = tb.string_bytes(column)
    for a, b in tb.row_chunks(offsets):
        low = tb.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = tb.word_bounds(low, offsets[a : b + 1] - offsets[a], tb.NONSPACE)
        words = tb.word_hashes(low, starts, ends)
        grams = tb.gram_hashes(words, k)
        for r in range(b - a):
            i, j = int(first[r]), int(first[r + 1])
            if j - i >= k:
                g = np.sort(grams[i : j - k + 1])
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                yield a + r, g[keep]
            else:
                yield a + r, tb.gram_hashes(words[i:j], j - i) if j > i else words[i:i]


def signature(grams: np.ndarray) -> int:
    """A 64-bit key of a set of hashes."""
    a = grams.sum(dtype=np.uint64)
    b = tb.mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    both = tb.mix(np.array([a, b + np.uint64(len(grams))], np.uint64))
    return int((both[:1] * np.uint64(0xE7037ED1A0B428DB) + both[1:]).view(np.int64)[0])


def sketch(grams: np.ndarray) -> np.ndarray:
    """Longs in which every hash of a set has flipped one bit."""
    odd = np.bincount((grams >> np.uint64(8)).astype(np.int64) % (64 * _LONGS), minlength=64 * _LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Rarity level of each bucket: 0 up to about the mean, then four to a doubling."""
    mean = counts.mean()
    return np.clip(np.floor(4 * np.log2((counts + 16) / (mean + 16 + 4 * mean**0.5))), 0, 63).astype(np.uint64)


def _tokens(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in order of rarity: the level above the top 58 bits of the hash."""
    return np.sort(levels[grams >> np.uint64(64 - _COUNTER_BITS)].astype(np.uint64) << np.uint64(58) | grams >> np.uint64(6))


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """A row (doc_id, n, sig, bits) of each document, and rows (seg, counts) of each task."""

    def run(batches):
        size_of = 1 << _COUNTER_BITS
        total = np.zeros(size_of, np.uint32)
        kind = None
        names = ["doc_id", "n", "sig", "bits", "seg", "counts"]

        def add(pend):
            np.add(total, np.bincount(np.concatenate(pend) >> np.uint64(64 - _COUNTER_BITS), minlength=size_of).astype(np.uint32), out=total)

        pend, held = [], 0
        for batch in batches:
            n = batch.num_rows
            kind = batch.column(0).type
            size, sig, bits = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros((n, _LONGS), np.int64)
            for r, g in shingle_sets(batch.column(1), k):
                size[r] = len(g)
                if len(g):
                    sig[r] = signature(g)
                    bits[r] = sketch(g)
                    pend.append(g)
                    held += len(g)
                    if held > 1 << 20:
                        add(pend)
                        pend, held = [], 0
            each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * _LONGS), pa.array(bits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(sig), each, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if pend:
            add(pend)
        if kind is not None and total.any():
            parts = [zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in total.reshape(_SEGMENTS, -1)]
            m = _SEGMENTS
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.array(range(m), pa.int32()), pa.array(parts, pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n int, sig long, bits array<long>, seg int, counts binary")


def _column_levels(rows: DataFrame) -> np.ndarray:
    """Rarity levels of all buckets: the tasks' counts are added up by segment, and one byte a bucket leaves them."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, raw in zip(batch.column("seg").to_pylist(), batch.column("counts").to_pylist()):
                planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
                part = np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1).astype(np.int64)
                sums[seg] = sums[seg] + part if seg in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_levels(x).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], names=["seg", "levels"])

    got = rows.where("seg is not null").select("seg", "counts").repartition("seg").mapInArrow(add, "seg int, levels binary").collect()
    out = np.zeros((_SEGMENTS, (1 << _COUNTER_BITS) // _SEGMENTS), np.uint8)
    for r in got:
        out[r["seg"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out.reshape(-1)


def _postings(docs: DataFrame, k: int, num: int, levels) -> DataFrame:
    """(t, sig, n, pos): the first columns of each row of the matrix, copies in a task once."""

    def run(batches):
        own = levels.value
        for batch in batches:
            seen: set[int] = set()
            ts, sigs, ns, ps, held = [], [], [], [], 0

            def flush():
                count = [len(x) for x in ts]
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ts).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), count)), pa.array(np.repeat(np.array(ns, np.int32), count)), pa.array(np.concatenate(ps).astype(np.int32))],
                    names=["t", "sig", "n", "pos"],
                )
                for x in (ts, sigs, ns, ps):
                    x.clear()
                return out

            for _, g in shingle_sets(batch.column(1), k):
                if not len(g) or (s := signature(g)) in seen:
                    continue
                seen.add(s)
                m = len(g) - -(-num * len(g) // 100) + 1
                ts.append(_tokens(g, own)[:m])
                sigs.append(s)
                ns.append(len(g))
                ps.append(np.arange(m))
                held += m
                if held > 1 << 17:
                    yield flush()
                    held = 0
            if ts:
                yield flush()

    return docs.mapInArrow(run, "t long, sig long, n int, pos int")


def _shared_columns(postings: DataFrame) -> DataFrame:
    """The postings of columns with two sets or more, and all of columns dealt by salt.

    Rows arrive sorted by (t, salt, n, sig); only a column's first row is carried
    from batch to batch, while it is alone.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["t", "sig", "n", "pos"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        last = alone = None  # the last row's column; the column's only row so far
        for batch in batches:
            t, salt, sig, n, pos = (batch.column(c).to_numpy() for c in ("t", "salt", "sig", "n", "pos"))
            m = len(t)
            if not m:
                continue
            before = np.empty(m, bool)
            before[0] = last is not None and last[:2] == (t[0], salt[0])
            before[1:] = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
            copy = np.zeros(m, bool)
            copy[0] = before[0] and last[2] == sig[0]
            copy[1:] = before[1:] & (sig[1:] == sig[:-1])
            last = t[-1], salt[-1], sig[-1]
            if copy.any():
                keep = np.flatnonzero(~copy)
                if not len(keep):
                    continue
                t, salt, sig, n, pos = (x[keep] for x in (t, salt, sig, n, pos))
                first = bool(before[0]) and (keep[0] == 0 or bool(copy[: keep[0]].all()))
                before = np.empty(len(t), bool)
                before[0] = first
                before[1:] = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
            met = before.copy()
            met[:-1] |= before[1:]
            head = []
            if alone is not None and before[0]:
                head, alone = [alone], None
            elif alone is not None:
                alone = None
            met |= salt > 0
            if not met[-1]:
                alone = (int(t[-1]), int(sig[-1]), int(n[-1]), int(pos[-1]))
            if head:
                yield batch_of(head)
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[met], k) for x, k in zip((t, sig, n, pos), kinds)], names=names)

    dealt = postings.repartition("t", "salt").sortWithinPartitions("t", "salt", "n", "sig")
    return dealt.mapInArrow(run, "t long, sig long, n int, pos int")


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sig, text) of the wanted sets and some others, of copies in a task one."""
    bit = F.pmod("sig", F.lit(_BIT_SPACE)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    bits = np.zeros(_BIT_SPACE, bool)
    for r in maps:
        own = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        at = (r["b"] - 1) * len(own)
        bits[at : at + len(own)] = own[: _BIT_SPACE - at]
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            seen: dict[int, int] = {}
            for r, g in shingle_sets(batch.column(1), k):
                if len(g) and known[(s := signature(g)) % _BIT_SPACE]:
                    seen.setdefault(s, r)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), batch.column(1).take(pa.array(list(seen.values())))], names=["sig", "text"])

    return docs.mapInArrow(run, "sig long, text string")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is num / 100 or more."""
    # A set with very many partners is dealt to several tasks.
    many = pairs.groupBy("b").count().where("count > 512").select(F.col("b").alias("m"), F.ceil(F.col("count") / 256).alias("parts"))
    dealt = pairs.join(many, F.col("b") == F.col("m"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0).cast("bigint")).alias("salt"))
    needs = dealt.select("b", "salt", "a", F.col("a").alias("need")).unionByName(dealt.select("b", "salt").distinct().select("b", "salt", F.lit(None).cast("long").alias("a"), F.col("b").alias("need")))
    needs = scratch.save(needs)
    texts = _texts(docs, needs.select(F.col("need").alias("sig")), k)

    def run(batches):
        hub, mine = None, None
        for batch in batches:
            b, a = batch.column("b").to_pylist(), batch.column("a").to_pylist()
            found: list[tuple[int, int]] = []
            for r, g in shingle_sets(batch.column("text"), k):
                if a[r] is None:
                    hub, mine = b[r], g
                else:
                    assert hub == b[r]
                    both = len(np.intersect1d(mine, g, assume_unique=True))
                    if 100 * both >= num * (len(mine) + len(g) - both):
                        found.append((a[r], b[r]))
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    met = texts.join(needs, F.col("sig") == F.col("need")).select("b", "salt", "a", "text")
    met = met.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    out = scratch.save(met.mapInArrow(run, "a long, b long").distinct())
    del met, texts, dealt
    scratch.discard(needs)
    scratch.release()
    return out


def _least_shared(num: int, x: str, y: str) -> Column:
    """Columns that two similar rows of these sizes share among their first ones, at least.

    They share need = ceil(num / (100 + num) * (x + y)) columns, so of x's first
    x - ceil(num / 100 * x) + 1 all but x - need are shared, of y's likewise, and
    the shared ones come in one order.
    """
    need = F.expr(f"({num} * ({x} + {y}) + {99 + num}) div {100 + num}")
    return F.least(need - F.expr(f"({num} * {x} + 99) div 100"), need - F.expr(f"({num} * {y} + 99) div 100")) + 1


def _open_columns(columns: DataFrame, members: DataFrame) -> DataFrame:
    """``columns`` with the component and whether the column is wide; only those with rows of two components."""
    comp = members.select(F.col("node").alias("c_sig"), "component")
    now = columns.join(comp, F.col("sig") == F.col("c_sig"), "left").withColumn("component", F.coalesce("component", "sig")).drop("c_sig")
    mixed = now.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select(F.col("t").alias("m_t"), (F.col("m") > _WIDE).alias("wide"))
    return now.join(mixed, F.col("t") == F.col("m_t")).drop("m_t")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document row.

    Words are runs without ASCII white space, A-Z lower-cased.  A document's set
    has its distinct shingles of k words; fewer words are one shingle.  Two
    documents link when their Jaccard similarity is ``similarity`` hundredths or
    more.  component_id is the smallest doc_id reachable by links, itself
    included.  Documents without words (null texts too) link with nothing.  Rows
    that repeat an id are rows of their own with the same or another component.
    Null ids keep their row; their component is the smallest id that is not
    null, else null.  Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    described = scratch.save(_describe(d, k))
    rows = described.where("n is not null").select("doc_id", "n", "sig")
    levels = spark.sparkContext.broadcast(_column_levels(described))

    # Four levels are a doubling, so a part of a hot column keeps about one size.
    level = F.shiftrightunsigned("t", 58)
    salt = F.when(level >= _HOT_LEVEL, 1 + F.pmod("sig", F.call_function("shiftleft", F.lit(1).cast("long"), ((level - _HOT_LEVEL) / 4 + 2).cast("int")))).otherwise(F.lit(0)).cast("int")
    columns = scratch.save(_shared_columns(_postings(d, k, similarity, levels).withColumn("salt", salt)))
    scratch.release()
    # The hub of a column: of each size class the row with the least columns of its own, so that a
    # text is preferred to its edited copies.  Two overlapping series of size classes are used.
    # A row asks for hubs in its most frequent columns and a few of its rarest; what this leaves out is taken up below.
    own = Window.partitionBy("sig")
    ranked = columns.withColumns({"m": F.count("*").over(own), "rk": F.row_number().over(own.orderBy("pos", "t"))}).where((F.col("rk") <= _RARE) | (F.col("m") - F.col("rk") < _FREQUENT))
    graded = ranked.withColumn("shared", (F.col("m") / F.expr(f"n - ({similarity} * n + 99) div 100 + 1")).cast("float"))
    size = 2 * F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / similarity))
    graded = graded.withColumn("band", F.explode(F.array(F.floor(size / 2), F.lit(1 << 20) + F.floor((size + 1) / 2)))).select("t", "band", "sig", "n", "shared")
    graded = scratch.save(graded)
    tops = graded.groupBy("t", "band").agg(F.max(F.struct("shared", "sig", "n")).alias("h"), F.count("*").alias("m")).where("m > 1").select(F.col("t").alias("h_t"), F.col("band").alias("h_band"), F.col("h.sig").alias("hub"), F.col("h.n").alias("hub_n"))
    hubs = graded.join(tops, (F.col("t") == F.col("h_t")) & (F.col("band") == F.col("h_band"))).where("sig <> hub").select("sig", "n", "hub", "hub_n")
    # Of a set's hubs the one it meets most often, if often enough to be like it.
    asked = F.least(F.lit(_RARE + _FREQUENT), _least_shared(similarity, "n", "hub_n"))
    counted = hubs.groupBy("sig", "n", "hub", "hub_n").count().where(3 * F.col("count") >= asked)
    pairs = scratch.save(counted.groupBy("sig").agg(F.max(F.struct("count", "hub")).alias("top")).select(F.col("sig").alias("a"), F.col("top.hub").alias("b")))
    del hubs, counted, tops
    scratch.discard(graded)
    scratch.release()
    links = _verified(d, pairs, k, similarity, scratch)
    members = scratch.save(connected_components(links, scratch))

    # What is left: one column, two components, sizes and positions that still allow the overlap.  Rows of wide columns
    # have their bitmaps with them.
    left = scratch.save(_open_columns(columns.select("t", "sig", "n", "pos"), members))
    scratch.discard(columns)
    scratch.release()
    narrow = left.where("not wide").drop("wide")
    wide = left.where("wide").drop("wide")
    asked = wide.select(F.col("sig").alias("l_sig")).distinct()
    sketches = described.where("n > 0").select(F.col("sig").alias("s_sig"), "bits").join(asked, F.col("s_sig") == F.col("l_sig"), "left_semi").distinct()
    wide = scratch.save(wide.join(sketches, F.col("sig") == F.col("s_sig")).drop("s_sig"))
    del asked, sketches
    scratch.release()

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*[F.col(c).alias(p + c) for c in df.columns])

    # The first column that two similar rows share leaves room for the overlap in both.  Wide columns only give products
    # that keep this bound and the bitmaps'; of the others all are counted, and the wide ones that a row has are the most that is missing.
    fits = 100 * F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n")
    room = (100 + similarity) * F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= similarity * (F.col("x_n") + F.col("y_n"))
    differ = sum((F.bit_count(F.get("x_bits", F.lit(k)).bitwiseXOR(F.get("y_bits", F.lit(k)))) for k in range(_LONGS)), F.lit(0))
    near = (100 + similarity) * differ <= (100 - similarity) * (F.col("x_n") + F.col("y_n"))

    # A row of another component than a group of copies meets a few of the group first, so that it is not open with all of them.
    ranked = wide.withColumn("rk", F.row_number().over(Window.partitionBy("t").orderBy(F.xxhash64("sig")))).where(F.col("rk") <= _TRIED)
    tried = side(wide, "x_").join(side(ranked, "y_"), (F.col("x_t") == F.col("y_t")) & (F.col("x_component") != F.col("y_component")) & fits & near)
    tried = tried.select(F.col("x_sig").alias("a"), F.col("y_sig").alias("b"), (differ / (F.col("x_n") + F.col("y_n"))).alias("far")).distinct()
    nearest = tried.withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))).where(F.col("rk") <= _NEAREST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    seen = pairs.select(F.least("a", "b").alias("p_a"), F.greatest("a", "b").alias("p_b"))
    unseen = lambda found: found.join(seen, (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b")), "left_anti")
    more = scratch.save(unseen(nearest))
    del ranked, tried, nearest
    scratch.release()
    if not more.isEmpty():
        links = links.unionByName(_verified(d, more, k, similarity, scratch))
        members = scratch.save(connected_components(links, scratch))
        seen = seen.unionByName(more.toDF("p_a", "p_b"))
        before, wide = wide, scratch.save(_open_columns(wide.drop("component"), members).drop("wide"))
        scratch.discard(before)
        scratch.release()

    wides = wide.groupBy(F.col("sig").alias("w_sig")).agg(F.count("*").alias("wides"))

    def products(df: DataFrame, counted: int, bound: Column) -> DataFrame:
        both = side(df, "x_").join(side(df, "y_"), (F.col("x_t") == F.col("y_t")) & (F.col("x_component") != F.col("y_component")) & (F.col("x_sig") < F.col("y_sig")) & fits & bound)
        return both.select(F.col("x_sig").alias("a"), F.col("y_sig").alias("b"), "x_n", "y_n", F.lit(counted).alias("counted"), room.alias("room"))

    met = products(narrow, 1, F.lit(True)).unionByName(products(wide, 0, room & near))
    met = met.groupBy("a", "b", "x_n", "y_n").agg(F.sum("counted").alias("count"), F.max("room").alias("room")).where("room")
    for p in ("a", "b"):
        met = met.join(wides.select(F.col("w_sig").alias(p + "_sig"), F.col("wides").alias(p + "_wides")), F.col(p) == F.col(p + "_sig"), "left")
    missing = F.least(F.coalesce("a_wides", F.lit(0)), F.coalesce("b_wides", F.lit(0)))
    rest = met.where(F.col("count") + missing >= _least_shared(similarity, "x_n", "y_n")).select("a", "b")
    rest = scratch.save(unseen(rest))
    scratch.discard(left)
    scratch.discard(wide)
    del met
    scratch.release()
    if not rest.isEmpty():
        joined = links.unionByName(_verified(d, rest, k, similarity, scratch))
        members = scratch.save(connected_components(joined, scratch))

    classes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = classes.join(members.withColumnRenamed("node", "m_sig"), F.col("sig") == F.col("m_sig"), "left").select("sig", "least", F.coalesce("component", "sig").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = scratch.save(named.join(least, "component").select(F.col("sig").alias("i_sig"), "component_id"))
    out = rows.join(ids, (F.col("sig") == F.col("i_sig")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: int = 75) -> DataFrame:
    """The documents whose id is the smallest of their component, with their own columns.

    Rows with a null id stay.  Rows that repeat an id stay or go together.  Other
    columns, whatever their names, are kept as they are; an empty table gives no rows.
    """
    ids = near_duplicates(docs, doc_id=doc_id, text=text, k=k, similarity=similarity)
    later = ids.where("doc_id > component_id").select(F.col("doc_id").alias(free := free_name(docs, "later"))).distinct()
    return docs.join(later, docs[doc_id] == F.col(free), "left_anti")
