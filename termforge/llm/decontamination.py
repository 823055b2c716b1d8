"""Benchmark decontamination by winnowing.

Of each window of WIN k-gram hashes the smallest is kept (k = window - WIN + 1
words), so every shared span of ``window`` words gives both sides a common
fingerprint.  Documents' fingerprints are joined with the benchmark's, and each
common fingerprint is extended to the window of words around it, which must be
the same on both sides.  Items shorter than a window have no fingerprint that a
document is sure to keep; they are looked up by the hash of all their words.

The benchmark's index is broadcast only while its texts are under
``block_bytes``.  A larger benchmark is dealt into blocks of that size, each is
passed over the documents, and their hits are merged by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb

WIN = 5
_BITS = 22


class Index:
    """Fingerprints, windows and short items of one benchmark block."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        self.window, self.k = window, window - WIN + 1
        self.ids = np.array(ids, dtype=np.int64)
        data, offsets = tb.string_bytes(pa.array(texts, pa.large_string()))
        low = tb.LOWER[data]
        starts, ends, first = tb.word_bounds(low, offsets, tb.ALNUM)
        words = tb.word_hashes(low, starts, ends)
        prints, long_keys, short_keys = [], [], {}
        for row in range(len(ids)):
            w = words[first[row] : first[row + 1]]
            if len(w) >= window:
                g = tb.gram_hashes(w, self.k)
                prints.append(_minima(g))
                long_keys.append((tb.gram_hashes(w, window), row))
            elif len(w):
                short_keys.setdefault(len(w), []).append((tb.gram_hashes(w, len(w)), row))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.near = np.zeros(1 << _BITS, bool)
        self.near[self.prints >> np.uint64(64 - _BITS)] = True
        self.windows = _postings(long_keys)
        self.short = {n: _postings(v) for n, v in short_keys.items()}

    def hits(self, words: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start word, length, item row) of every occurrence of a window of an item in these words."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        n = len(words)
        if len(self.prints) and n >= self.window:
            low = _minima(tb.gram_hashes(words, self.k))
            at = np.flatnonzero(self.near[low >> np.uint64(64 - _BITS)] & (row_of[: len(low)] == row_of[self.window - 1 :]))
            at = at[_find(self.prints, low[at]) >= 0]
            if len(at):
                around = words[at[:, None] + np.arange(self.window)]
                same = around[:, 0].copy()
                for j in range(1, self.window):
                    same *= np.uint64(0xD6E8FEB86659FD93)
                    same += around[:, j]
                found.append((at, self.window, tb.mix(same + np.uint64(self.window))))
        for length in self.short:
            if n >= length:
                found.append((np.flatnonzero(row_of[: n - length + 1] == row_of[length - 1 :]), length, None))
        starts, lengths, items = [], [], []
        for at, length, keys in found:
            index = self.windows if keys is not None else self.short[length]
            if keys is None:
                keys = tb.gram_hashes(words, length)[at]
                some = index[3][keys >> np.uint64(64 - 16)]
                at, keys = at[some], keys[some]
            k = _find(index[0], keys)
            at, k = at[k >= 0], k[k >= 0]
            per = index[1][k + 1] - index[1][k]
            starts.append(np.repeat(at, per))
            lengths.append(np.full(int(per.sum()), length, np.int64))
            step = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
            items.append(index[2][np.repeat(index[1][k], per) + step])
        if not starts:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(items)


def _minima(grams: np.ndarray) -> np.ndarray:
    n = len(grams) - WIN + 1
    out = grams[:n].copy()
    for j in range(1, WIN):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _postings(parts: list[tuple[np.ndarray, int]]):
    """(sorted distinct keys, offsets, item rows by key, prefilter on the top 16 bits)."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, bool)
    keys = np.concatenate([k for k, _ in parts])
    rows = np.concatenate([np.full(len(k), r, np.int64) for k, r in parts])
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[keep], rows[keep]
    distinct, first = np.unique(keys, return_index=True)
    some = np.zeros(1 << 16, bool)
    some[distinct >> np.uint64(64 - 16)] = True
    return distinct, np.append(first, len(keys)).astype(np.int64), rows, some


def _scan(column: pa.Array, index: Index):
    """Of each row: number of words, hit intervals and item rows."""
    data, offsets = tb.string_bytes(column)
    for a, b in tb.row_chunks(offsets):
        part = offsets[a : b + 1] - offsets[a]
        low = tb.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = tb.word_bounds(low, part, tb.ALNUM)
        words = tb.word_hashes(low, starts, ends)
        row_of = np.repeat(np.arange(b - a), np.diff(first))
        at, length, item = index.hits(words, row_of)
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        hit = (np.cumsum(marks[:-1]) > 0).astype(np.int64)
        yield a, b, first, hit, row_of[at], item


def _item_lists(rows: np.ndarray, items: np.ndarray) -> dict[int, np.ndarray]:
    """Distinct item rows of each row."""
    if not len(rows):
        return {}
    pairs = np.unique(np.stack([rows, items], 1), axis=0)
    cut = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    return {int(p[0, 0]): p[:, 1] for p in np.split(pairs, cut)}


def digest(ids: list[int]) -> str:
    """SHA-256 of the distinct ids, sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(sorted({str(x) for x in ids})).encode()).hexdigest()


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """How much of each document repeats the benchmark.

    Words are maximal runs of letters, digits and non-ASCII characters with A-Z
    lower-cased.  A window is ``window`` consecutive words of an item; an item
    of fewer words is one window.  Returns for every row of ``docs``: doc_id,
    n_words, n_hit (words inside an occurrence of a window), n_items, items
    (distinct item ids, ascending), items_sha256 and contaminated.

    Null and empty texts have no words and no hits.  Items without words or with
    a null id match nothing; repeated ids count once, with all their texts.
    Repeated document rows each get their row.  Other columns are ignored, so
    their names cannot clash.  With an empty benchmark nothing is hit.
    """
    if window <= WIN:
        raise ValueError(f"a window has more than {WIN} words")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size <= block_bytes:
        return _one_block(d, items, window)
    blocks = -(-size // block_bytes)
    return _many_blocks(d, items, window, int(2 * blocks))


def _index_of(items: DataFrame, window: int) -> Index:
    rows = items.toPandas()
    return Index([int(x) for x in rows["item_id"]], list(rows["text"]), window)


def _one_block(d: DataFrame, items: DataFrame, window: int) -> DataFrame:
    shared = d.sparkSession.sparkContext.broadcast(_index_of(items, window))
    none = digest([])

    def scan(batches):
        index = shared.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            lists: list[list[int]] = [[]] * n
            for a, b, first, hit, rows, item in _scan(batch.column(1), index):
                n_words[a:b] = np.diff(first)
                n_hit[a:b] = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
                for r, own in _item_lists(rows, item).items():
                    lists[a + r] = sorted(set(index.ids[own].tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array([digest(x) if x else none for x in lists], pa.string()), pa.array(n_hit > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
            )

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(scan, f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<long>, items_sha256 string, contaminated boolean")


def _many_blocks(d: DataFrame, items: DataFrame, window: int, blocks: int) -> DataFrame:
    kind = d.schema["doc_id"].dataType.simpleString()
    keyed = d.withColumn("hash", F.xxhash64("text"))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def passed(block: int) -> DataFrame:
        shared = d.sparkSession.sparkContext.broadcast(_index_of(dealt.where(F.col("block") == block).select("item_id", "text"), window))

        def scan(batches):
            index = shared.value
            for batch in batches:
                n = batch.num_rows
                n_words = np.zeros(n, np.int64)
                spans: list[list[dict]] = [[]] * n
                lists: list[list[int]] = [[]] * n
                for a, b, first, hit, rows, item in _scan(batch.column(1), index):
                    n_words[a:b] = np.diff(first)
                    for r, own in _item_lists(rows, item).items():
                        lists[a + r] = index.ids[own].tolist()
                        h = np.concatenate([[0], hit[first[r] : first[r + 1]], [0]])
                        edge = np.flatnonzero(np.diff(h))
                        spans[a + r] = [{"s": int(s), "e": int(e)} for s, e in edge.reshape(-1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "hash", "n_words", "spans", "items"],
                )

        return keyed.mapInArrow(scan, f"doc_id {kind}, hash long, n_words long, spans array<struct<s:long,e:long>>, items array<long>")

    parts = passed(0)
    for block in range(1, blocks):
        parts = parts.unionByName(passed(block).where(F.size("items") > 0))
    # A row of the first pass for every document row; rows that repeat id and text have the same hits.
    merged = parts.groupBy("doc_id", "hash").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    @F.pandas_udf("long")
    def covered(spans: pd.Series) -> pd.Series:
        def one(own) -> int:
            total = last = 0
            for s, e in sorted((x["s"], x["e"]) for x in own):
                total += max(0, e - max(s, last))
                last = max(last, e)
            return total

        return spans.map(one)

    sha = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256)
    done = merged.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "n_words", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", sha.alias("items_sha256"))
    rows = keyed.select("doc_id", "hash")
    out = rows.join(done, rows["doc_id"].eqNullSafe(done["_id"]) & rows["hash"].eqNullSafe(done["_hash"]))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns.

    A document row stays unless its id is among the contaminated ones; rows with
    a null id stay unless a row with a null id is contaminated.
    """
    hit = benchmark_overlap(docs, benchmark, doc_id=doc_id, text=text, window=window, block_bytes=block_bytes).where("contaminated").select(F.col("doc_id").alias("_hit_id")).distinct()
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["_hit_id"]), "left_anti")
