"""Byte n-gram scores of documents by sharded count joins.

A document is a row of bytes; an n-gram of order N (N up to 8) is an exact
64-bit key of N bytes.  Counts live in shards, dealt by the two bytes before the
last, so all contexts of a gram of three bytes or more are in one shard.  The
two shortest orders are one table of 256 x 256 counts, a proven bound.

To score, documents are dealt into blocks of bounded size.  Each block's
distinct grams go to the shards, meet the counts there, and come back as values
that are summed over the block's documents.  No model is broadcast and no
document's grams are shuffled one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb

ORDER = 6
_SLOT_BITS = 21
U8 = np.uint64(8)


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as they are, white space as 0x20."""
    return np.where(tb.NONSPACE[data], data, np.uint8(32)), offsets


def words_only(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words, all else as 0x20."""
    low = tb.LOWER[data]
    return np.where(tb.ALNUM[low], low, np.uint8(32)), offsets


def grams(data: np.ndarray, offsets: np.ndarray, form: Callable, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): row r has keys[first[r]:first[r + 1]], one for each byte and one for its end.

    Runs of 0x20 count as one; each row is preceded by order - 1 of them.
    """
    body, offsets = form(data, offsets)
    n = len(offsets) - 1
    space = body == 32
    keep = np.ones(len(body), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = ~space[starts]
    chosen = np.flatnonzero(keep)
    sizes = np.diff(np.searchsorted(chosen, offsets))
    # In ``out`` a row has order - 1 spaces, its bytes and one more space; 8 - order spaces come before all.
    at = np.repeat(np.arange(n) * order + 7, sizes)
    at += np.arange(len(at))
    total = len(at) + n * order
    out = np.full((total + 23) // 8 * 8, 32, np.uint8)
    out[at] = body[chosen]
    key = np.empty(total, np.uint64)  # key[j]: the eight bytes from j on
    for r in range(min(8, total)):
        key[r::8] = out[r : r + (len(out) - r) // 8 * 8].view(">u8")[: -(-(total - r) // 8)]
    if order < 8:
        key &= np.uint64((1 << 8 * order) - 1)
    scored = np.repeat(np.arange(n) * (order - 1), sizes + 1)
    scored += np.arange(len(scored))
    return key[scored], np.concatenate([[0], np.cumsum(sizes + 1)])


def _firsts(ascending: np.ndarray) -> np.ndarray:
    new = np.empty(len(ascending), bool)
    new[:1] = True
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    return new


def unique(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending (np.unique hashes, which takes five times as long here)."""
    keys = np.sort(keys)
    return keys[_firsts(keys)]


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    return unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(_firsts(keys))
    return keys[at], np.diff(at, append=len(keys))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def shards_for(n_bytes: int) -> int:
    """A power of two that grows with the text: 64 up to 256 GB, then one for each 4 GB, to 4096."""
    return min(4096, max(64, 1 << max(0, (n_bytes >> 32).bit_length())))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    two = keys >> U8 & np.uint64(0xFFFF)
    return (two * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64)


def split(shards: int, keys: np.ndarray, *more: np.ndarray):
    """(shard, keys, ...) of the shards that have some."""
    s = shard_of(keys, shards)
    order = np.argsort(s, kind="stable")
    cut = np.searchsorted(s[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cut)):
        at = order[cut[k] : cut[k + 1]]
        yield int(k), keys[at], *[x[at] for x in more]


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts (2-D: one column a class) summed."""
    k = np.concatenate(keys)
    c = np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(_firsts(k))
    return k[first], np.add.reduceat(c[order], first, axis=0)


def _squeeze(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences, the low bytes of all first."""
    step = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return zlib.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _squeeze_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueeze_counts(raw: bytes, classes: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1, classes)


def count_grams(docs: DataFrame, classes: int, form: Callable, shards: int, order: int = ORDER) -> DataFrame:
    """(shard, keys, counts) of ``docs`` (text, cls): counts of each class, added up by task and shard, squeezed."""

    def run(batches):
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            data, offsets = tb.string_bytes(batch.column("text"))
            ks, cs = [], []
            for a, b in tb.row_chunks(offsets):
                key, first = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], form, order)
                of = np.repeat(cls[a:b], np.diff(first))
                for c in range(classes):
                    if len(own := key[of == c]):
                        u, m = counted(own)
                        ks.append(u)
                        cs.append(np.eye(classes, dtype=np.int64)[c] * m[:, None])
                if len(ks) > 24:
                    k, c = add_up(ks, cs)
                    ks, cs = [k], [c]
            if ks:
                k, c = add_up(ks, cs)
                rows = [(s, _squeeze(x), _squeeze_counts(y)) for s, x, y in split(shards, k, c)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])

    part = docs.select("text", "cls").mapInArrow(run, "shard long, keys binary, counts binary")

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for s, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = held.setdefault(s, [[], []])
                h[0].append(_unsqueeze(k))
                h[1].append(_unsqueeze_counts(c, classes))
                if len(h[0]) > 24:
                    k, c = add_up(*h)
                    h[:] = [[k], [c]]
        rows = [(s, _squeeze(k), _squeeze_counts(c)) for s, h in held.items() for k, c in [add_up(*h)]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])

    return part.repartition("shard").mapInArrow(add, "shard long, keys binary, counts binary")


def short_counts(model: DataFrame) -> np.ndarray:
    """256 x 256 numbers of distinct bytes seen before each pair of bytes, added up in 16 segments."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch.column("keys").to_pylist():
                three = unique(_unsqueeze(raw) & np.uint64(0xFFFFFF))
                total += np.bincount(three & np.uint64(0xFFFF), minlength=1 << 16)
        parts = total.reshape(16, -1)
        own = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([parts[i].tobytes() for i in own], pa.binary())], names=["seg", "t"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, raw in zip(batch.column("seg").to_pylist(), batch.column("t").to_pylist()):
                held[seg] = held.get(seg, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["seg", "t"])

    out = np.zeros((16, 1 << 12), np.int64)
    for row in model.select("keys").mapInArrow(run, "seg long, t binary").repartition("seg").mapInArrow(add, "seg long, t binary").collect():
        out[row["seg"]] = np.frombuffer(bytes(row["t"]), np.int64)
    return out.reshape(256, 256)


def discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more."""
    n1, n2, n3, n4 = (float(np.count_nonzero(counts == i)) for i in (1, 2, 3, 4))
    if not n1 or not n2 or not n3:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.1), m) for x, m in zip(d, (0.95, 1.9, 2.9)))


class Level:
    """One order: sorted grams with counts, and their contexts with totals and discount mass."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        d = discounts(counts)
        self.cut = np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2])) * (counts > 0)
        context = keys >> U8
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.totals = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        self.mass = np.add.reduceat(self.cut, first) if len(first) else np.zeros(0)

    def blend(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of this order interpolated with those of the lower one."""
        if not len(self.keys):
            return lower
        at = np.minimum(np.searchsorted(self.contexts, keys >> U8), len(self.contexts) - 1)
        known = (self.contexts[at] == keys >> U8) & (self.totals[at] > 0)
        g = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = np.where(self.keys[g] == keys, self.counts[g] - self.cut[g], 0.0)
        total = np.where(known, self.totals[at], 1.0)
        return np.where(known, (own + self.mass[at] * lower) / total, lower)


def lower_levels(keys: np.ndarray, order: int, least: int = 3) -> list[Level]:
    """Levels of order ``least`` to order - 1 by numbers of distinct bytes before a gram."""
    out, above = [], keys
    for k in range(order - 1, 2, -1):
        below, count = counted(above & np.uint64((1 << 8 * k) - 1))
        if k >= least:
            out.append(Level(below, count))
        above = below
    return out[::-1]


def low_probability(keys: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Orders 1 and 2, from the table of all shards."""
    pairs = short.astype(np.float64)
    seen = np.count_nonzero(short, axis=0).astype(np.float64)
    one = (np.maximum(seen - 0.5, 0) + 0.5 * np.count_nonzero(seen) / 256) / max(seen.sum(), 1) if seen.sum() else np.full(256, 1 / 256)
    one = one / one.sum()
    total = pairs.sum(1)
    d = 0.75
    two = np.where(total[:, None] > 0, (np.maximum(pairs - d, 0) + d * np.count_nonzero(short, axis=1)[:, None] * one) / np.maximum(total, 1)[:, None], one)
    x, c = keys & np.uint64(0xFF), keys >> U8 & np.uint64(0xFF)
    return two[c, x]


class _Lookup:
    """Values of the grams of one block, by a table of slots; the rare clashes by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        slot = self._slot(self.keys)
        self.slots = np.zeros(1 << _SLOT_BITS, np.float32)
        self.slots[slot] = self.values
        self.clash = np.zeros(1 << _SLOT_BITS, bool)
        s = np.sort(slot)
        self.clash[s[1:][s[1:] == s[:-1]]] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.slots[slot]
        odd = np.flatnonzero(self.clash[slot])
        out[odd] = self.values[np.searchsorted(self.keys, keys[odd])]
        return out


def _sums(values: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the sum of its values, and the largest mean of ``window`` values in a row (of all, if fewer)."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    n = np.diff(first)
    ends = np.arange(1, len(values) + 1)
    begins = np.maximum(ends - window, np.repeat(first[:-1], n))
    full = (ends - begins >= np.minimum(window, np.repeat(n, n)))
    means = np.where(full, (upto[ends] - upto[begins]) / (ends - begins), -np.inf)
    return np.add.reduceat(values, first[:-1]), np.maximum.reduceat(means, first[:-1])


def score_documents(docs: DataFrame, model: DataFrame, evaluate: Callable, classes: int, form: Callable, shards: int, n_bytes: int, *, order: int = ORDER, block_bytes: int = 8 << 20, window: int = 16) -> DataFrame:
    """The rows of ``docs`` with total (sum of the gram values), n_grams and peak added; text is dropped.

    ``peak`` is the largest mean value of ``window`` grams in a row.
    ``evaluate(keys, counts, wanted)`` gives the values of the wanted grams from
    a shard's counts.  ``docs`` has a column text of ``n_bytes`` bytes in all;
    ``shards`` is that of the model.
    """
    n_blocks = max(1, -(-n_bytes // block_bytes))
    # The more shards, the fewer of a block's grams are in one, so the more blocks meet it together.
    n_salts = max(1, -(-n_blocks // (4 * shards)))
    others = [c for c in docs.columns if c != "text"]
    # Block by a hash of the whole row: copies of a text have other ids and spread.
    dealt = docs.select(F.pmod(F.xxhash64(*others, "text"), F.lit(n_blocks)).cast("long").alias("block"), *others, "text")
    names = [*others, "text"]

    def pack(batches):
        for batch in batches:
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0])) if len(order) else order
            rows = pa.RecordBatch.from_arrays(batch.columns[1:], names=names)
            keys, packs = [], []
            for own in np.split(order, first[1:]) if len(order) else ():
                sink = pa.BufferOutputStream()
                part = rows.take(pa.array(own))
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                keys.append(int(block[own[0]]))
                packs.append(sink.getvalue().to_pybytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packs, pa.binary())], names=["block", "pack"])

    packed = dealt.mapInArrow(pack, "block long, pack binary")

    def unpacked(table: pa.Table):
        """The block's rows, one pack at a time; packs in one order."""
        for raw in sorted(table.column("pack").to_pylist()):
            yield pa.ipc.open_stream(raw).read_all()

    def chunks(rows: pa.Table):
        data, offsets = tb.string_bytes(rows.column("text"))
        for a, b in tb.row_chunks(offsets):
            yield a, b, *grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], form, order)

    def need(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        kept: list[np.ndarray] = []
        for rows in unpacked(table):
            kept += [unique(k) for _, _, k, _ in chunks(rows)]
            if len(kept) > 8:
                kept = [distinct(kept)]
        rows = [(s, block % n_salts, block, _squeeze(k)) for s, k in split(shards, distinct(kept))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "salt", "block", "keys"])

    needed = packed.groupBy("block").applyInArrow(need, "shard long, salt long, block long, keys binary")
    counts = model.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_salts - 1).cast("long"))).alias("salt"), "keys", "counts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            keys = _unsqueeze(right.column("keys")[0].as_py())
            own = _unsqueeze_counts(right.column("counts")[0].as_py(), classes)
        else:
            keys, own = np.zeros(0, np.uint64), np.zeros((0, classes), np.int64)
        blocks = left.column("block").to_pylist() if left.num_rows else []
        wanted = [_unsqueeze(k) for k in left.column("keys").to_pylist()] if blocks else []
        union = distinct(wanted)
        values = evaluate(keys, own, union).astype(np.float32) if len(union) else np.zeros(0, np.float32)
        back = [values[np.searchsorted(union, w)].tobytes() for w in wanted]
        shard = left.column("shard").to_pylist() if blocks else []
        return pa.table([pa.array(blocks, pa.int64()), pa.array(shard, pa.int64()), pa.array(back, pa.binary())], names=["block", "shard", "values"])

    valued = needed.groupBy("shard", "salt").cogroup(counts.groupBy("shard", "salt")).applyInArrow(meet, "block long, shard long, values binary")

    fields = {c: docs.schema[c].dataType.simpleString() for c in others}
    outs = [*others, "total", "n_grams", "peak"]

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        if left.num_rows:
            # A block's grams (8 bytes for each of its bytes) stay in memory, so the text is walked once.
            tables = [(rows, list(chunks(rows))) for rows in unpacked(left)]
            kept: list[np.ndarray] = []
            for _, parts in tables:
                kept += [unique(k) for _, _, k, _ in parts]
                if len(kept) > 8:
                    kept = [distinct(kept)]
            by_shard = dict(zip(right.column("shard").to_pylist(), right.column("values").to_pylist()))
            own = [(k, np.frombuffer(by_shard[s], np.float32)) for s, k in split(shards, distinct(kept))]
            look = _Lookup(np.concatenate([k for k, _ in own]), np.concatenate([v for _, v in own]))
            for rows, parts in tables:
                n = rows.num_rows
                sums, counts, peaks = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
                for a, b, k, first in parts:
                    sums[a:b], peaks[a:b] = _sums(look(k).astype(np.float64), first, window)
                    counts[a:b] = np.diff(first)
                done.append(pa.table([*[rows.column(c) for c in others], pa.array(sums), pa.array(counts), pa.array(peaks)], names=outs))
        return pa.concat_tables(done)

    schema = ", ".join([*[f"`{c}` {t}" for c, t in fields.items()], "total double", "n_grams long", "peak double"])
    return packed.groupBy("block").cogroup(valued.groupBy("block")).applyInArrow(total, schema)
