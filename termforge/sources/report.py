"""Reports as a data source: ``df.write.format("report")`` writes one Markdown document of rows (section, pos, line).

Tasks hand their lines to the commit, which writes the document beside its
place and renames it: a reader sees the old report or the new one, and an
aborted write leaves nothing.  A report is made for people: a write of more
than ``most_lines`` lines fails.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "section int, pos long, line string"


@dataclass
class _Lines(WriterCommitMessage):
    lines: list[tuple[int, int, str]]


class Report(DataSource):
    """Options: path (a local path or a URI that pyarrow can open), title, most_lines."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.title, self.overwrite = options["path"], options.get("title", ""), overwrite
        self.most = int(options.get("most_lines", 100_000))
        self.own = f"{uuid.uuid4().hex}.part"

    def _place(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), os.path.abspath(self.path)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        lines = []
        for r in rows:
            lines.append((r["section"], r["pos"], r["line"] or ""))
            if len(lines) > self.most:
                raise ValueError(f"a report of more than {self.most} lines")
        return _Lines(lines)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        lines = sorted(x for m in messages if m for x in m.lines)
        if len(lines) > self.most:
            raise ValueError(f"a report of more than {self.most} lines")
        out, last = ([f"# {self.title}"] if self.title else []), None
        for section, _, line in lines:
            if section != last and out:
                out.append("")
            out.append(line)
            last = section
        files, place = self._place()
        if not self.overwrite and files.get_file_info(place).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)
        files.create_dir(os.path.dirname(place), recursive=True)
        beside = f"{place}.{self.own}"
        with files.open_output_stream(beside) as f:
            f.write(("\n".join(out) + "\n").encode())
        files.move(beside, place)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        files, place = self._place()
        if files.get_file_info(f"{place}.{self.own}").type != fs.FileType.NotFound:
            files.delete_file(f"{place}.{self.own}")


def _section(n: int, df: DataFrame, line, order) -> DataFrame:
    return df.select(F.lit(n).alias("section"), order.cast("long").alias("pos"), line.alias("line"))


def _heading(df: DataFrame, n: int, text: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(n, -1, text)], SCHEMA)


def _listed(n: int, df: DataFrame, heading: str, name: str, count: str) -> DataFrame:
    """A heading and a line for each row, in the order of names."""
    # The rows of a report's list are few; their place is their rank by name.
    ordered = df.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(name), F.lit("")).alias("name"), F.col(count).alias("n")))).alias("a"))
    rows = ordered.select(F.posexplode("a").alias("at", "x"))
    return _heading(df, n, heading).unionByName(_section(n, rows, F.format_string("- %s: %d", "x.name", "x.n"), F.col("at")))


def corpus_report(docs: DataFrame, *, text: str = "abstract", domain: str = "domain", source: str = "source", year: str = "year", published: str = "published") -> DataFrame:
    """The lines of a corpus's report: size, mean length, years, counts by domain and source, the two chemistry domains."""
    number = F.col(year).try_cast("double")
    own = F.year(F.to_timestamp(F.try_to_timestamp(F.col(published)))).cast("double")
    base = docs.select(F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), number.alias("y"), own.alias("p"), F.col(domain).alias("domain"), F.col(source).alias("source"))
    one = base.agg(F.count("*").alias("docs"), F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("length"), *[f(c).alias(f"{k}_{c}") for c in ("y", "p") for k, f in (("min", F.min), ("max", F.max), ("mid", F.median))])
    # The dates count if no row has a year.
    pick = lambda k: F.coalesce(F.when(F.col("max_y").isNotNull(), F.col(f"{k}_y")).otherwise(F.col(f"{k}_p")), F.lit(0.0))
    lines = F.array(
        F.format_string("Total docs: %d", "docs"),
        F.concat(F.lit("Average abstract length: "), F.col("length").cast("string")),
        F.concat(F.lit("Year distribution (min/max/median): "), pick("min").cast("long").cast("string"), F.lit("/"), pick("max").cast("long").cast("string"), F.lit("/"), pick("mid").cast("string")),
    )
    head = _section(0, one.select(F.posexplode(lines).alias("at", "l")), F.col("l"), F.col("at"))
    by_domain = base.groupBy("domain").agg(F.count("*").alias("n"))
    two = docs.sparkSession.createDataFrame([("CHEM",), ("CHEME",)], "domain string").join(by_domain, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))
    return head.unionByName(_listed(1, by_domain, "## Counts per domain", "domain", "n")).unionByName(_listed(2, base.groupBy("source").agg(F.count("*").alias("n")), "## Counts per source", "source", "n")).unionByName(_listed(3, two, "## CHEM vs CHEME", "domain", "n"))


def evaluation_report(log: DataFrame, k: int = 5) -> DataFrame:
    """The lines of an evaluation's report: summary, failure modes, routes, and the lists of failures."""
    from ..operators import evaluation

    s = evaluation.summary(log)
    values = F.array(*[F.struct(F.lit(i).alias("at"), F.concat(F.lit(f"- {c}: "), F.format_string("%.3f", c) if t == "double" else F.col(c).cast("string")).alias("l")) for i, (c, t) in enumerate(s.dtypes)])
    out = _heading(log, 0, "## Summary metrics").unionByName(_section(0, s.select(F.explode(values).alias("x")), F.col("x.l"), F.col("x.at")))
    for n, title, rows in ((1, "## Routes", evaluation.routes(log)), (2, f"## Failures (top {k})", evaluation.failures(log))):
        text = F.concat(F.lit("- "), F.to_json(F.struct(*rows.columns)))
        ordered = rows.groupBy().agg(F.array_sort(F.collect_list(text)).alias("a")).select(F.posexplode("a").alias("at", "l"))
        out = out.unionByName(_heading(log, n, title)).unionByName(_section(n, ordered, F.col("l"), F.col("at")))
    return out
