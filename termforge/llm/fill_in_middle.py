"""Fill-in-middle transformation of documents.

The tokenizers library's Split pre-tokenizer, with isolated matches of a
pattern, gives the code-point offsets of a text's units; no vocabulary is
needed.  The number of offsets is n.  Two draws from 0 to n are ranks into the
offsets, which cut the text into prefix, middle and suffix.  The draws come
from a hash of seed and document id, so that every run gives the same result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UNITS = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
#: Code points that the pre-tokenizer gets at once.
CHUNK = 1 << 16
_OTHER = re.compile("[^A-Za-z]")
_ANY_MARK = re.compile("|".join(MARKS))


def _chunks(text: str):
    """(start, end) of runs of about CHUNK code points that end behind a unit."""
    start = 0
    while start < len(text):
        end = start + CHUNK
        if end < len(text):
            # A character that is no letter is a unit of its own, so a cut before it is one between units.
            cut = _OTHER.search(text, end)
            end = cut.start() if cut else len(text)
        yield start, min(end, len(text))
        start = end


class UnitOffsets:
    """Start offsets of a text's units, in code points."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(UNITS), "isolated")

    def __call__(self, text: str) -> np.ndarray:
        parts = []
        for start, end in _chunks(text):
            found = self.split.pre_tokenize_str(text[start:end])
            parts.append(np.fromiter((at[0] for _, at in found), np.int64, len(found)) + start)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def draws(seed: int, doc_id) -> list[int]:
    """The first four 8-digit groups of the hash of seed and document id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, offsets: np.ndarray, h: list[int], plain_from: int, spm_below: int) -> tuple:
    """(form, prefix_chars, middle_chars, output)."""
    if not text or h[2] % 100 >= plain_from or _ANY_MARK.search(text):
        return "plain", None, None, text
    n = len(offsets)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(offsets[r]) if r < n else len(text) for r in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h[3] % 100 < spm_below:
        return "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from output and form alone.

    The parts of a text without marks hold no mark, and no mark can begin in one
    part and end in the next, so the three marks found are the ones put in.
    """
    part = F.split(F.col(output), "|".join(MARKS), -1)
    at = lambda i: F.get(part, F.lit(i))
    psm, spm = F.concat(at(1), at(3), at(2)), F.concat(at(2), at(3), at(1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    Of 100 texts ``plain_from`` are cut, of those ``spm_below`` in a hundred put
    the suffix first.  Empty texts, and texts that hold a mark, stay plain; then
    the output is the text and both lengths are null.

    A null text is an empty one.  A null id counts as no digits.  Rows that
    repeat are changed alike.  Texts of any length are taken whole, in chunks
    that end between units.  An empty table gives no rows; other columns are
    ignored, whatever their names.
    """

    def run(batches):
        units = UnitOffsets()
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = body.as_py() or ""
                offsets = units(whole)
                rows.append((len(offsets), *transform(whole, offsets, draws(seed, doc), plain_from, spm_below)))
            n, form, prefix, middle, out = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
