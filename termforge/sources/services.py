"""Paged services as Spark data sources: batch readers with a partition a category, query, concept or residue of pages,
and a stream that goes back in time.

A source is made with a fetch function, so it works with any client and tests
run offline; the function is sent to the executors as it is.  Retries stand
within a read, so a failed task begins its partition again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, SimpleDataSourceStreamReader

from ..functions import terms as S, text as T
from . import harvest

ROW = "id string, source string, domain string, title string, abstract string, published string, updated string, url string, categories array<string>"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
#: The shortest abstract that is kept, and the concepts of the two chemistry domains.
SHORTEST_ABSTRACT = 200
CHEMISTRY, CHEMICAL_ENGINEERING = "C178790620", "C185592680"


def _tuple(row: dict, source: str, domain: str) -> tuple:
    have = {**row, "source": source, "domain": domain}
    return tuple(have.get(c) if c == "categories" else str(have.get(c) or "") for c in _NAMES)


class _Of(InputPartition):
    """What one partition reads."""


class _PartReader(DataSourceReader):
    """A partition for each value of a column."""

    column = ""

    def __init__(self, values: list[str]):
        self.values = list(values)

    def partitions(self) -> list[InputPartition]:
        return [_Of(v) for v in self.values]


class _Pushed:
    """Filters on the column leave partitions out.  Spark takes such a reader only if
    ``spark.sql.python.filterPushdown.enabled`` is true, so the option push_filters asks for it."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.column,):
                self.values = [v for v in self.values if v == f.value]
            elif isinstance(f, In) and f.attribute == (self.column,):
                self.values = [v for v in self.values if v in f.value]
            else:
                yield f


def _reader(kind: type[_PartReader], options) -> DataSourceReader:
    return (type("Pushing", (_Pushed, kind), {}) if str(options.get("push_filters", "")).lower() == "true" else kind)(options)


def _retry(options: dict, fetch: Callable[[], Any], fatal: tuple[int, ...] = ()):
    return harvest.with_retry(fetch, most=int(options.get("retries", 4)), base=float(options.get("backoff", 2.0)), fatal=fatal)


def query_source(name: str, fetch: Callable[[str, int, int], list[dict]], queries: dict[str, str]) -> type[DataSource]:
    """Search results: ``fetch(query, start, size)`` gives a page; a partition a domain of ``queries`` (domain to query).

    Options: page_size, target (rows a domain), retries, backoff, push_filters.  A domain's rows end with its target, an empty page or
    one shorter than page_size; an id comes once in a domain.
    """

    class Reader(_PartReader):
        column = "domain"

        def __init__(self, options):
            super().__init__(list(queries))
            self.options = dict(options)

        def read(self, partition) -> Iterator[tuple]:
            size, target = int(self.options.get("page_size", 100)), int(self.options.get("target", 1 << 62))
            start, seen = 0, set()
            while len(seen) < target:
                rows = _retry(self.options, lambda: fetch(queries[partition.value], start, size))
                for row in rows:
                    rid = str(row.get("id") or "").strip()
                    if rid and rid not in seen and len(seen) < target:
                        seen.add(rid)
                        yield _tuple(row, name, partition.value)
                if len(rows) < size:
                    return
                start += len(rows)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROW

        def reader(self, schema) -> DataSourceReader:
            return _reader(Reader, self.options)

    return Source


#: What the cursor service gives, before domains and keywords are told.
WORK = "concept string, id string, display_name string, abstract_index map<string,array<int>>, concepts array<struct<id:string,display_name:string,score:double>>, publication_year int, publication_date string"


def cursor_source(name: str, fetch: Callable[[str, str], tuple[list[dict], str | None]], concepts: dict[str, list[str]]) -> type[DataSource]:
    """Works of a service that hands out cursors: ``fetch(filter, cursor)`` gives (items, next cursor).

    A partition a concept of ``concepts`` (name to ids).  Status 400 on the name's filter takes that of the ids, if there
    are any.  Options: from_year, target, retries, backoff,
    push_filters.
    """

    class Reader(_PartReader):
        column = "concept"

        def __init__(self, options):
            super().__init__(list(concepts))
            self.options = dict(options)

        def read(self, partition) -> Iterator[tuple]:
            year, target = int(self.options.get("from_year", 2000)), int(self.options.get("target", 1 << 62))
            ids, by_name, cursor, n = concepts[partition.value], True, "*", 0
            while cursor and n < target:
                text = harvest.filter_text(ids, year, partition.value if by_name else "")
                try:
                    items, after = _retry(self.options, lambda: fetch(text, cursor))
                except harvest.HttpError as e:
                    if e.status != 400 or not by_name or not ids:
                        raise
                    by_name = False
                    continue
                if not items:
                    return
                for x in items[: target - n]:
                    n += 1
                    index = x.get("abstract_inverted_index")
                    index = {k: [i for i in v if isinstance(i, int)] for k, v in index.items() if isinstance(v, list)} if isinstance(index, dict) else {}
                    tags = [(str(c.get("id") or ""), c.get("display_name"), float(c.get("score") or 0.0)) for c in x.get("concepts") or [] if isinstance(c, dict)]
                    year_of = x.get("publication_year")
                    yield partition.value, str(x.get("id") or "").strip(), str(x.get("display_name") or "").strip(), index, tags, year_of if isinstance(year_of, int) else 0, str(x.get("publication_date") or "")
                cursor = after

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return WORK

        def reader(self, schema) -> DataSourceReader:
            return _reader(Reader, self.options)

    return Source


def abstract_of(index) -> Column:
    """The text of an inverted index (token to positions): tokens in order of position; of two at one position the later of the map."""
    each = F.flatten(F.transform(F.map_entries(T.col(index)), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("at"), i.alias("nth"), e["key"].alias("token")))))
    ordered = F.array_sort(each)
    last = F.filter(F.transform(ordered, lambda x, i: F.struct(x["token"].alias("token"), (F.coalesce(F.get(ordered, i + 1)["at"], F.lit(-1)) != x["at"]).alias("keep"))), lambda x: x["keep"])
    return F.trim(F.array_join(F.transform(last, lambda x: x["token"]), " "))


def works_of_domain(works: DataFrame, domain: str, keywords: list[str] = [], shortest: int = SHORTEST_ABSTRACT) -> DataFrame:
    """(id, source, domain, title, abstract, year, concepts, categories, published): works (:data:`WORK`) that belong to the
    domain, have an abstract of ``shortest`` characters and one of the keywords; an id once.

    A work is CHEME by a keyword of chemical engineering, or by its concepts' scores; a CHEME work without one goes.
    """
    named = F.filter(F.transform("concepts", lambda c: c["display_name"]), lambda c: F.coalesce(c, F.lit("")) != "")
    w = works.select("id", F.col("display_name").alias("title"), abstract_of("abstract_index").alias("abstract"), F.col("publication_year").alias("year"), named.alias("names"), F.col("publication_date").alias("published"), S.concept_score("concepts", CHEMISTRY).alias("chem"), S.concept_score("concepts", CHEMICAL_ENGINEERING).alias("cheme"))
    text = F.concat_ws(" ", "title", "abstract", F.array_join("names", " "))
    keyword = T.contains_any(text, S.CHEME_KEYWORDS)
    fits = (S.chemistry_domain(keyword, F.col("chem"), F.col("cheme")) == domain) & (F.length("abstract") >= shortest) & (F.col("id") != "") & T.contains_any(text, keywords)
    if domain == "CHEME":
        fits = fits & keyword
    out = w.where(fits).dropDuplicates(["id"])
    return out.select("id", F.lit("openalex").alias("source"), F.lit(domain).alias("domain"), "title", "abstract", "year", F.col("names").alias("concepts"), F.col("names").alias("categories"), "published")


ITEM = "value string"


def offset_source(name: str, fetch: Callable[[int, int], list[dict]]) -> type[DataSource]:
    """Items of a service with skip and limit, as JSON: ``fetch(skip, limit)`` gives a page.

    Partition p of P reads pages p, p + P, p + 2 P and so on, each until a page that isn't full.  Status 403 ends the
    read at once.  Options: page_size, parts, max_results, retries, backoff.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)
            self.size, self.parts = max(1, int(self.options.get("page_size", 50))), max(1, int(self.options.get("parts", 4)))

        def partitions(self) -> list[InputPartition]:
            return [_Of(p) for p in range(self.parts)]

        def read(self, partition) -> Iterator[tuple]:
            page, most = partition.value, int(self.options.get("max_results", 1 << 62))
            while page * self.size < most:
                limit = min(self.size, most - page * self.size)
                items = _retry(self.options, lambda: fetch(page * self.size, limit), fatal=(403,))
                for x in items:
                    yield (json.dumps(x, ensure_ascii=False),)
                if len(items) < self.size:
                    return
                page += self.parts

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ITEM

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Source


def preprint_rows(items: DataFrame, domain: str, categories: list[str] = [], source: str = "chemrxiv") -> DataFrame:
    """Rows of items (JSON in value): the first field that holds something for each column; those of the categories; an id once.

    Malformed JSON and items without any id are left out.
    """
    j = lambda *names: S.first_of(*[F.get_json_object("value", f"$.{n}") for n in names])
    cats = F.coalesce(F.get_json_object("value", "$.categories"), F.lit("[]"))
    rows = items.select(
        j("id", "itemId", "slug", "doi").alias("id"), F.lit(source).alias("source"), F.lit(domain).alias("domain"), F.trim(j("title")).alias("title"), F.trim(j("abstract", "description")).alias("abstract"),
        S.category_names(cats).alias("categories"), j("publishedDate", "published", "createdDate").alias("published"), j("doi").alias("doi"), j("license").alias("license"), j("url", "landingPage").alias("url"),
    )
    return rows.where((F.col("id") != "") & S.category_match("categories", categories)).dropDuplicates(["id"])


# --- a stream that goes back in time


def category_stream(name: str, fetch: Callable[[str, str, int, int], list[dict]], categories: dict[str, str]) -> type[DataSource]:
    """New rows of categories, slice by slice back in time: ``fetch(category, last_day, start, size)`` gives a page of rows
    up to a day.  A micro-batch reads one page of every category that isn't done.

    The offset holds, for each category of ``categories`` (category to domain), the slice's last day, the row at which
    its next page begins, the rows kept, and short hashes of the ids of the last pages; so a restarted query goes on at
    the page it left.  A category is done at its target, after a slice without rows, and after its slices; a slice ends
    with a page that isn't full or ``stale_pages`` pages without a new id.  An id that comes again later than that is
    dropped by :func:`new_rows`.

    Options: last_day, slice_days, max_slices, page_size, target, stale_pages, retries, backoff.
    """

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            o = self.options = dict(options)
            self.size, self.target = int(o.get("page_size", 100)), int(o.get("target", 1 << 62))
            self.days, self.slices, self.stale = int(o.get("slice_days", 30)), int(o.get("max_slices", 120)), int(o.get("stale_pages", 10))

        def initialOffset(self) -> dict:
            return {c: {"day": self.options["last_day"], "start": 0, "slice": 0, "kept": 0, "stale": 0, "done": "", "ids": []} for c in sorted(categories)}

        def _page(self, category: str, at: dict) -> tuple[list[tuple], dict]:
            rows = _retry(self.options, lambda: fetch(category, at["day"], at["start"], self.size))
            known = {h for page in at["ids"] for h in page}
            new = {}
            for r in rows:
                rid = str(r.get("id") or "").strip()
                if rid and (h := hashlib.sha256(rid.encode()).hexdigest()[:12]) not in known and h not in new and at["kept"] + len(new) < self.target:
                    new[h] = _tuple(r, name, categories[category])
            to = {**at, "kept": at["kept"] + len(new), "stale": 0 if new or not rows else at["stale"] + 1, "ids": [*at["ids"], sorted(new)][-max(self.stale, 1) :]}
            if to["kept"] >= self.target:
                to["done"] = "target"
            elif not rows and at["start"] == 0:
                to["done"] = "empty_slice"
            elif len(rows) < self.size or to["stale"] >= self.stale:
                day = date.fromisoformat(at["day"]) - timedelta(days=self.days)
                to |= {"day": day.isoformat(), "start": 0, "slice": at["slice"] + 1, "stale": 0}
                if to["slice"] >= self.slices:
                    to["done"] = "slices"
            else:
                to["start"] = at["start"] + len(rows)
            return list(new.values()), to

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            out, end = [], {}
            for category, at in start.items():
                if at["done"]:
                    end[category] = at
                else:
                    rows, end[category] = self._page(category, at)
                    out += rows
            return iter(out), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            """The same page again, after a failure."""
            return self.read(start)[0]

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROW

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader(self.options)

    return Source


def new_rows(stream: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each id once, by state that is kept; without the ids of ``stored``."""
    once = stream.dropDuplicates(["id"])
    return once if stored is None else once.join(stored.select("id").distinct(), "id", "left_anti")


def atom_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows of entries) of Atom files, whatever file system they are on: a file is a row, parsed where it is read."""
    import pyarrow as pa

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    names = ("id", "title", "abstract", "published", "updated", "url")

    def run(batches):
        for b in batches:
            rows = [(p, *(r[n] for n in names), r["categories"]) for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in harvest.atom_rows(v)]
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:7]] + [pa.array(cols[7], pa.list_(pa.string()))], names=["path", *names, "categories"])

    return files.mapInArrow(run, "path string, " + ", ".join(f"{n} string" for n in names) + ", categories array<string>")
