"""Packing documents into sequences of a fixed capacity, by sum-of-squares online packing.

Every partition packs its own documents, so nothing is shuffled.  A document is
its token ids and an end id.  Whole windows are cut off its front; the rest is
one item.  An array holds the number of open (partially filled) windows of each
fill level.  An item goes to the level, or to a new window, that leaves the
least sum of squares of those numbers.

Open windows are bounded: beyond ``open_windows``, and at the end of the
partition, the fullest window is topped up with tokens cut from the emptiest.
The one window that is left is cut into powers of two, which need no padding.

Token ids come from the tokenizers library; distinct words are tokenized once
and kept, as far as the memory set for that goes.
"""

from __future__ import annotations

import json
import os
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "word_bpe_49k.json"
#: Bytes of ids and words kept from one text to the next, in each worker.
KEPT_BYTES = 1 << 28
#: Sequences of one partition are numbered below this.
_PER_PARTITION = 1 << 33
_EMIT_BYTES = 1 << 22

# The normalizer and pattern of a tokenizer whose words can be told apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")
#: All but white space and printable ASCII without the apostrophe, and letters of Latin blocks whose lower case is one letter of them.
_ODD = re.compile("[^ \t\n\x0b\f\r\x21-\x26\x28-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]")
_UNIT = re.compile("[a-z\xc0-\u017f]+|[0-9]|[^a-z0-9\xc0-\u017f \t\n\x0b\f\r]+")


class WordIds:
    """The ids of texts as little-endian 32-bit integers, four bytes each.

    A tokenizer that drops white space and cuts words as WORD_PATTERN says sees
    a text as units that don't touch each other: runs of letters, single digits
    and runs of other characters.  Distinct units are tokenized once, many in
    one call; the ids that end a word tell them apart.  A word that holds an
    apostrophe, an added token or a character whose class or case needs its
    neighbours is tokenized as it is.  Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_words = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"]["type"] == "Sequence" and parts["pre_tokenizer"]["pretokenizers"][0] == _SPLIT and bool(suffix)
        self.added = [x["content"] for x in parts["added_tokens"]]
        if self.by_words:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        for k in range(0, len(units), 4096):
            some = units[k : k + 4096]
            data = self._encode([" ".join(some)])[0]
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 4).tolist()
            if len(ends) != len(some) or ends[-1] != len(data):
                raise ValueError("a unit is no single word of the tokenizer")
            self.known.update(zip(some, (data[a:b] for a, b in zip([0, *ends], ends))))
            self.size += len(data) + sum(map(len, some)) + 200 * len(some)

    def _plain(self, text: str) -> bytes:
        units = _UNIT.findall(text.lower())
        if self.size > KEPT_BYTES:
            self.known, self.size = {}, 0
        self._learn(list(set(units).difference(self.known)))
        return b"".join(map(self.known.__getitem__, units))

    def __call__(self, text: str) -> bytes:
        if not self.by_words:
            return self._encode([text])[0]
        if not _ODD.search(text) and not any(a in text for a in self.added):
            return self._plain(text)
        # Runs of plain words between the words that are tokenized as they are.
        out = []
        for odd, run in groupby(_BLANKS.split(text), lambda w: bool(_ODD.search(w)) or any(a in w for a in self.added)):
            out += self._encode(list(run)) if odd else [self._plain(" ".join(run))]
        return b"".join(out)


class Window:
    """A sequence being filled: pieces of (document, first token, ids)."""

    __slots__ = ("pieces", "level")

    def __init__(self):
        self.pieces: list[tuple] = []
        self.level = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.level += len(piece[2]) // 4

    def take(self, most: int) -> tuple:
        """The last piece, or as much of its end as ``most`` allows."""
        doc, start, ids = self.pieces.pop()
        n = len(ids) // 4
        if n > most:
            self.pieces.append((doc, start, ids[: 4 * (n - most)]))
            doc, start, ids = doc, start + n - most, ids[4 * (n - most) :]
        self.level -= len(ids) // 4
        return doc, start, ids


class Packer:
    """Sum-of-squares packing.  ``closed`` gathers the windows that are done."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity, self.limit = capacity, open_windows
        self.counts = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list[Window]] = {}
        self.open = 0
        self.closed: list[Window] = []

    def best_level(self, size: int) -> int:
        """The level that an item of ``size`` goes to; 0 is a new window.  Ties go to the fuller window."""
        n, c = self.counts, self.capacity
        if size == c:
            return 0
        levels = np.flatnonzero(n[1 : c - size + 1]) + 1
        if not len(levels):
            return 0
        # The change of the sum of squares: the old level loses a window, the new level gains one; full windows don't count.
        change = 1 - 2 * n[levels]
        after = levels + size
        change += np.where(after < c, 2 * n[after] + 1, 0)
        k = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[k]) if change[k] <= 2 * n[size] + 1 else 0

    def _put(self, window: Window) -> None:
        if window.level == self.capacity:
            self.closed.append(window)
        elif window.level:
            self.counts[window.level] += 1
            self.at.setdefault(window.level, []).append(window)
            self.open += 1

    def _get(self, level: int) -> Window:
        self.counts[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def add(self, doc, ids: bytes) -> None:
        """Pack one document."""
        step, start = 4 * self.capacity, 0
        while len(ids) - 4 * start >= step:
            window = Window()
            window.add((doc, start, ids[4 * start : 4 * start + step]))
            self.closed.append(window)
            start += self.capacity
        rest = ids[4 * start :]
        if rest:
            level = self.best_level(len(rest) // 4)
            window = self._get(level) if level else Window()
            window.add((doc, start, rest))
            self._put(window)
        if self.open > self.limit:
            self._top_up()

    def _top_up(self) -> None:
        """The fullest window is filled with tokens of the emptiest ones."""
        full = self._get(int(np.flatnonzero(self.counts)[-1]))
        while full.level < self.capacity and self.open:
            giver = self._get(int(np.flatnonzero(self.counts)[0]))
            while giver.level and full.level < self.capacity:
                full.add(giver.take(self.capacity - full.level))
            self._put(giver)
        self._put(full)

    def finish(self) -> None:
        """Close all windows."""
        while self.open > 1:
            self._top_up()
        if self.open:
            last = self._get(int(np.flatnonzero(self.counts)[0]))
            while last.level:
                size = 1 << (last.level.bit_length() - 1)
                window = Window()
                while window.level < size:
                    window.add(last.take(size - window.level))
                self.closed.append(window)


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2, vocabulary: str | None = None, open_windows: int = 1024) -> DataFrame:
    """One row a piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's token ids, little-endian unsigned 32-bit integers;
    ``start`` counts the document's ids before it, ``offset`` the sequence's.
    ``vocabulary`` is the path of a tokenizers file on every executor, by
    default that of the installed public one.  A sequence has ``capacity`` ids
    or a power of two, so none needs padding if a sequence of a power of two may
    stay as short as it is.

    Null and empty texts are one piece of the end id.  Rows that repeat, or
    share an id, are documents of their own; null ids stay null.  Texts of any
    length are packed whole.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        words, packer = WordIds(path), Packer(capacity, open_windows)
        sequence = TaskContext.get().partitionId() * _PER_PARTITION

        def emit(schema):
            nonlocal sequence
            rows = []
            for window in packer.closed:
                offset = 0
                for (doc, tokens), start, ids in window.pieces:
                    n = len(ids) // 4
                    rows.append((doc, start, n, ids, tokens, sequence, offset))
                    offset += n
                sequence += 1
            packer.closed = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), *[(c, pa.int64()) for c in ("start", "length")], ("ids", pa.binary()), *[(c, pa.int64()) for c in ("doc_tokens", "sequence_id", "offset")]])
            for doc, body in zip(batch.column(0), batch.column(1)):
                ids = words(body.as_py() or "") + end
                packer.add((doc.as_py(), len(ids) // 4), ids)
                if len(packer.closed) * 4 * capacity >= _EMIT_BYTES:
                    yield emit(schema)
        packer.finish()
        if packer.closed:
            yield emit(schema)

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
