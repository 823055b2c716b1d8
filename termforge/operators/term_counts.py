"""Terms in many documents, in two passes: hashes first, strings only of terms whose hash is in enough documents.

Nearly all phrases of a text stand in few documents.  The first pass passes on
five bytes for each distinct term of a block of documents; hashes in fewer than
``least`` documents are left out of a bitmap.  The second pass makes strings of
the terms that are in the bitmap, so the counts are exact whatever hashes clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import config

_PARTS, _WORD = re.compile(r"[a-z][a-z0-9\-_/()]*|[^a-z]+"), re.compile(r"[a-z][a-z0-9\-_/]*")
_NEVER = frozenset(config.ACADEMIC + config.VERB_LIKE + config.CONNECTORS)
#: Words of a block of documents; shards of the hashes; the bitmap's least and most bits, as powers of two.
BLOCK_WORDS, SHARDS, BITS = 1 << 19, 256, (16, 29)


def _blocks(batches, domains: list[str]) -> Iterator[tuple[list[str], list[tuple[int, np.ndarray, np.ndarray]]]]:
    """(words, [(n, terms, counts)]) of every block: a term's n places in ``words``, the number of documents of each domain that have it."""
    place = {d: i for i, d in enumerate(domains)}
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    seq, gap, size, single, dom = [], [], [], [], []

    def done():
        words = list(ids)
        w, near = np.array(seq, np.int64), np.array(gap, np.int64) == 1
        doc = np.repeat(np.arange(len(size)), size)
        of = np.array(dom, np.int64)
        odd = np.array([x in _NEVER for x in words], bool)
        split = np.array(["(" in x or ")" in x for x in words], bool)
        fine = ~odd[w]
        two = np.zeros(len(w), bool)
        two[1:] = fine[1:] & fine[:-1] & near[1:]
        three = np.zeros(len(w), bool)
        three[2:] = two[2:] & two[1:-1]
        n, out = len(words), []
        more = np.array([x for _, x in single], np.int64)
        at = np.array([x for x, _ in single], np.int64)
        i, j = np.flatnonzero(two), np.flatnonzero(three)
        # A block has far fewer words than 2^21, so three places fit 63 bits.
        keys = ((1, np.concatenate([w[~split[w]], more]), np.concatenate([doc[~split[w]], at])), (2, w[i - 1] * n + w[i], doc[i]), (3, (w[j - 2] * n + w[j - 1]) * n + w[j], doc[j]))
        for k, key, where in keys:
            uniq, code = np.unique(key, return_inverse=True)
            once = np.unique(where * max(len(uniq), 1) + code)
            code, where = once % max(len(uniq), 1), once // max(len(uniq), 1)
            counts = np.bincount(code * len(domains) + of[where], minlength=len(uniq) * len(domains)).reshape(len(uniq), len(domains))
            parts = [uniq // n ** (k - 1 - m) % n for m in range(k)] if n else []
            out.append((k, np.stack(parts, 1) if parts else np.zeros((0, k), np.int64), counts))
        return words, out

    for batch in batches:
        for text, domain in zip(batch.column(0), batch.column(1)):
            p = _PARTS.findall(text.as_py())
            if p and not "a" <= p[0][0] <= "z":
                del p[0]
            words = p[::2]
            seq += map(ids.__getitem__, words)
            if words:
                gap.append(0)
                gap += [len(g) for g in p[1::2]][: len(words) - 1]
            for x in {x for x in words if "(" in x or ")" in x}:
                single += [(len(size), ids[y]) for y in _WORD.findall(x)]
            size.append(len(words))
            dom.append(place[domain.as_py()])
            if len(seq) >= BLOCK_WORDS:
                yield done()
                for x in (ids, seq, gap, size, single, dom):
                    x.clear()
    if size:
        yield done()


def _mix(x: np.ndarray) -> np.ndarray:
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[str], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard, 32 bits) of each term."""
    own = pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)
    h = np.full(len(terms), terms.shape[1], np.uint64)
    for column in terms.T:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + own[column])
    return (h >> np.uint64(56)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bitmap(d: DataFrame, domains: list[str], least: int, power: int) -> bytes:
    def each(batches):
        for words, terms in _blocks(batches, domains):
            yield [(*_hashes(words, t), c.sum(1)) for _, t, c in terms if len(t)]

    return bitmap_of(d, each, least, power)


def bitmap_of(d: DataFrame, blocks, least: int, power: int) -> bytes:
    """One bit for each value of the first ``power`` bits of (shard, hash): whether a term in ``least`` documents may have it.

    ``blocks`` of batches of ``d`` gives lists of (shard, hash, count) arrays.
    """
    top = min(least, 255)

    def hashed(batches):
        for each in blocks(batches):
            if not each:
                continue
            shard, value, count = (np.concatenate(x) for x in zip(*each))
            shard, value = shard.astype(np.int64), value.astype(np.uint32)
            order = np.argsort(shard, kind="stable")
            value, count = value[order], np.minimum(count[order], top).astype(np.uint8)
            ends = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            cut = [s for s in range(SHARDS) if ends[s] < ends[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.int32()), *[pa.array([x[ends[s] : ends[s + 1]].tobytes() for s in cut], pa.binary()) for x in (value, count)]], names=["shard", "value", "count"])

    def counted(table: pa.Table) -> pa.Table:
        value = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("value")])
        count = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("count")])
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        kept = value[first][np.add.reduceat(count, first, dtype=np.int64) >= top]
        bits = np.zeros(1 << (power - 8), bool)
        bits[kept >> np.uint32(40 - power)] = True
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["shard", "bits"])

    rows = d.mapInArrow(hashed, "shard int, value binary, count binary").groupBy("shard").applyInArrow(counted, "shard int, bits binary")
    none = bytes(1 << (power - 11))
    got = {r["shard"]: bytes(r["bits"]) for r in rows.toLocalIterator()}
    return b"".join(got.get(s, none) for s in range(SHARDS))


def frequent_counts(docs: DataFrame, domains: list[str], least: int) -> DataFrame:
    """(term, total, c0, c1, ...) of all terms of (low, domain) rows that are in ``least`` rows or more; ``domains`` names all domains.

    Terms are those of :func:`mining.text_terms`.  The bitmap, 64 MB at most, is the only thing that goes to all tasks.
    """
    if not domains:
        return docs.sparkSession.createDataFrame([], "term string, total long")
    sc = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.length("low"))).first()[0] or 0
    power = min(max(int(size // 8).bit_length(), BITS[0]), BITS[1])
    bitmap = sc.broadcast(_bitmap(docs, domains, least, power))

    def named(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for words, terms in _blocks(batches, domains):
            for _, t, counts in terms:
                shard, value = _hashes(words, t)
                at = (shard << (power - 8)) + (value >> np.uint32(40 - power)).astype(np.int64)
                kept = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                for first in range(0, len(kept), 1 << 15):
                    part = kept[first : first + (1 << 15)]
                    names = [" ".join([words[i] for i in x]) for x in t[part].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in counts[part].T]], names=["term", *[f"c{i}" for i in range(len(domains))]])

    c = [f"c{i}" for i in range(len(domains))]
    g = docs.mapInArrow(named, "term string" + "".join(f", {x} long" for x in c)).groupBy("term").agg(*[F.sum(x).alias(x) for x in c])
    return g.withColumn("total", sum((F.col(x) for x in c[1:]), F.col(c[0]))).where(F.col("total") >= least)
