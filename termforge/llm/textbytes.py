"""NumPy kernels over the UTF-8 bytes of Arrow string columns.

All word classes used here are decidable on single bytes (every byte of a
non-ASCII character is 0x80 or more), so no text is decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x80:] = True
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True

#: Bytes of ``[^\x20\x09-\x0D]``.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

CHUNK = 1 << 20
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | U64(1)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, min(2 * len(_pow), CHUNK))
        _pow = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, _P)]))
        _inv = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, _PINV)]))
    return _pow, _inv


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges (first, last) of rows of about ``limit`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_bounds(low: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of row r are first[r] to first[r + 1]."""
    inside = table[low]
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(low), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(low), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in slices of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + CHUNK, side="right"))
        b = max(b, a + 1)
        lo, hi = int(starts[a]), int(ends[b - 1])
        pw, inv = _powers(hi - lo + 1)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[low[lo:hi]] * pw[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
        a = b
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position on (rows are not told apart)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for j in range(1, k):
        total *= U64(0xD6E8FEB86659FD93)
        total += words[j : j + n]
    return mix(total + U64(k))
