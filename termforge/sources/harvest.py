"""Harvesting of paged services as a Python data source.  Pages come from a fetch function, so that tests run offline."""

from __future__ import annotations

import json
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Statuses worth another try, and the longest pause.
RETRYABLE = (429, 500, 503)
LONGEST_PAUSE = 60.0
_ATOM = "{http://www.w3.org/2005/Atom}"


class HttpError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


class FatalHttpError(HttpError):
    """A status that ends a harvest at once."""


def with_retry(fetch: Callable[[], object], *, most: int = 4, base: float = 2.0, retryable: Iterable[int] = RETRYABLE, fatal: Iterable[int] = (), sleep: Callable[[float], None] = time.sleep):
    """What ``fetch`` gives; after failures it is tried up to ``most`` times more, with pauses that grow as powers of ``base``."""
    for tried in range(most + 1):
        try:
            return fetch()
        except HttpError as e:
            if e.status in fatal:
                raise FatalHttpError(e.status) from e
            if tried == most or e.status not in retryable:
                raise
        except OSError:
            if tried == most:
                raise
        sleep(min(LONGEST_PAUSE, base ** (tried + 1)))


def atom_rows(xml: str) -> list[dict]:
    """Entries of an Atom feed; line breaks in titles and abstracts become spaces, tags become categories."""
    def text(e, name: str) -> str:
        return (e.findtext(_ATOM + name) or "").replace("\n", " ").strip()

    return [
        {"id": text(e, "id"), "title": text(e, "title"), "abstract": text(e, "summary"), "published": text(e, "published"), "updated": text(e, "updated"), "url": text(e, "id"), "categories": [c.get("term") for c in e.findall(_ATOM + "category") if c.get("term")]}
        for e in ET.fromstring(xml).findall(_ATOM + "entry")
    ]


def slices_back(last: date, days: int, most: int) -> Iterator[tuple[date, date]]:
    """(first, last) day of slices that end at ``last`` and go back in time."""
    for _ in range(most):
        yield last - timedelta(days=days - 1), last
        last -= timedelta(days=days)


@dataclass
class Progress:
    kept: int = 0
    duplicates: int = 0
    reason: str = "slices"


def harvest_back(page: Callable[[date, date, int], list[dict]], *, known: set[str], target: int, last: date, days: int = 30, most_slices: int = 120, stale_pages: int = 10, progress: Progress | None = None) -> Iterator[dict]:
    """New rows of slices back in time, page by page, until a target, an empty slice, or pages without anything new.

    ``known`` has the ids of earlier runs, so a harvest goes on where it ended.
    """
    p, stale = progress or Progress(), 0
    for first, end in slices_back(last, days, most_slices):
        start = 0
        while rows := page(first, end, start):
            new = [r for r in {r["id"]: r for r in rows if r.get("id")}.values() if r["id"] not in known]
            p.duplicates += len(rows) - len(new)
            stale = 0 if new else stale + 1
            for r in new:
                known.add(r["id"])
                p.kept += 1
                yield r
                if p.kept >= target:
                    p.reason = "target"
                    return
            if stale >= stale_pages:
                p.reason = "stale"
                return
            start += len(rows)
        if not start:
            p.reason = "empty_slice"
            return


def cursor_rows(page: Callable[[str], tuple[list[dict], str | None]], most: int) -> Iterator[dict]:
    """Rows of a service that hands out cursors, from ``*`` on."""
    cursor, n = "*", 0
    while cursor and n < most:
        rows, cursor = page(cursor)
        if not rows:
            return
        for r in rows[: most - n]:
            n += 1
            yield r


def offset_rows(page: Callable[[int], list[dict]], most: int) -> Iterator[dict]:
    """Rows of a service with skip and limit."""
    n = 0
    while n < most and (rows := page(n)):
        yield from rows[: most - n]
        n += len(rows)


def filter_text(concepts: list[str], year: int, name: str = "") -> str:
    """A filter of the cursor service: from a year on, with an abstract, by a concept's name or ids."""
    parts = [f"from_publication_date:{year}-01-01", "has_abstract:true"]
    if name or concepts:
        parts.append(f"concepts.display_name:{name}" if name else "concepts.id:" + "|".join(concepts))
    return ",".join(parts)


def first_that_works(sources: list[tuple[str, Callable[[], list[dict]]]]) -> tuple[str | None, list[dict], list[str]]:
    """(name, rows, failures): the first source in order of priority that gives rows."""
    failed = []
    for name, get in sources:
        try:
            if rows := get():
                return name, rows, failed
            failed.append(f"{name}: no rows")
        except Exception as e:
            failed.append(f"{name}: {e}")
    return None, [], failed


def missing_artifacts(paths: dict[str, str], least: int = 16) -> list[str]:
    """Names of the files that don't exist or have ``least`` bytes or fewer."""
    return [n for n, p in paths.items() if not Path(p).is_file() or Path(p).stat().st_size <= least]


def evidence_index(path: str) -> dict[str, list[dict]]:
    """Evidence by key; nodes of another shape are passed over, a missing file is empty."""
    if not Path(path).is_file():
        return {}
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k: [x for x in v if isinstance(x, dict)] for k, v in raw.items() if isinstance(v, list)} if isinstance(raw, dict) else {}


def settings(path: str) -> dict:
    """A mapping from a JSON file, or from YAML where its package is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


class AtomFolder(DataSource):
    """``spark.read.format("atom_folder").load(folder)``: a folder for each category with Atom pages, a partition each."""

    @classmethod
    def name(cls) -> str:
        return "atom_folder"

    def schema(self) -> str:
        return "category string, id string, title string, abstract string, published string, updated string, url string, categories array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _AtomReader(self.options["path"])


class _Category(InputPartition):
    pass


class _AtomReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_Category(p.name) for p in sorted(Path(self.folder).iterdir()) if p.is_dir()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for f in sorted((Path(self.folder) / partition.value).glob("*.xml")):
            for r in atom_rows(f.read_text(encoding="utf-8")):
                yield partition.value, r["id"], r["title"], r["abstract"], r["published"], r["updated"], r["url"], r["categories"]
