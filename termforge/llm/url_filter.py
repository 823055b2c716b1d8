"""URL rules, and block decisions propagated over redirects and canonical links.

A rule is a host (with all its subdomains) and a path prefix.  URLs that no rule
fits get the decision of their aliases: the connected component that redirects
and canonical links put them in.  A blocked member blocks the component's other
members, but never one that a rule allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .storage import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query): empty for null and for URLs without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    before = F.substring_index(rest, "?", 1)
    path = F.when(F.instr(before, "/") > 0, F.substring(before, F.instr(before, "/"), F.length(before))).otherwise(F.lit(""))
    query = F.when(F.instr(rest, "?") > 0, F.substring(rest, F.instr(rest, "?"), F.length(rest))).otherwise(F.lit(""))
    return ascii_lower(host), path, query


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def alias_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): the page's own address and each canonical or refresh target in its html, both absolute."""
    tags = pages.select(F.col(url).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    attr = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def value(name: str) -> Column:
        return F.concat(*[F.regexp_extract("tag", rf"(?is)\b{name}{attr}", i) for i in (1, 2, 3)])

    canonical = F.when(F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "canonical"), value("href"))
    refresh = F.when(F.lower(value("http-equiv")) == "refresh", F.regexp_extract(value("content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    to = F.trim(F.regexp_replace(F.coalesce(canonical, refresh), "&amp;", "&"))
    found = tags.withColumn("to", to).where("src is not null and to is not null and to <> '' and instr(src, '://') > 0")
    host, path, _ = url_parts(F.col("src"))
    scheme = F.substring_index("src", "://", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    dst = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to"))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), host, "to"))
        .when(F.substring("to", 1, 1).isin("?", "#"), F.concat(scheme, F.lit("://"), host, path, "to"))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), "to"))
    )
    return found.select("src", dst.alias("dst"))


def _address(url: Column) -> Column:
    """What two URLs of one address share: no scheme and no fragment."""
    host, path, query = url_parts(url)
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query)


def filter_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every row of ``pages``.

    A rule fits a URL of its host or a subdomain whose path starts with the
    rule's path; the longest rule wins and its verdict stands.  Other URLs are
    blocked if a URL in their component of redirects and canonical links is
    blocked by a rule, else they get ``default``.  ``redirects`` may add edges
    (src, dst).  component is the smallest address of the component, null
    without edges.  Null URLs and URLs without ``://`` have empty parts and get
    ``default``; null html has no edges; repeated rows are judged alike; an
    empty table gives no rows.  Other columns are ignored.
    """
    host, path, _ = url_parts(F.col(url))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = own.withColumns({"rule": text, "by_rule": verdict})
    edges = alias_edges(pages, url=url, html=html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst").where("instr(src, '://') > 0 and instr(dst, '://') > 0"))
    scratch = Scratch(pages.sparkSession)
    links = scratch.save(edges.distinct())
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("component"))
    named = links.select(_address(F.col("src")).alias("a"), _address(F.col("dst")).alias("b"))
    members = connected_components(named, scratch)
    ends = links.select(F.explode(F.array("src", "dst")).alias("url"))
    host, path, _ = url_parts(F.col("url"))
    ends = ends.select(_address(F.col("url")).alias("node"), host.alias("host"), path.alias("path")).distinct()
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = ends.where(verdict == "block").join(members, "node").select("component").distinct().withColumn("blocked", F.lit(True))
    state = scratch.save(members.join(blocked, "component", "left").select(F.col("node").alias("address"), "component", "blocked"))
    # The few hundred rows of an address meet all its pages; hot addresses are split by the engine's skew handling.
    out = judged.withColumn("address", F.when(F.col("host") != "", _address(F.col("url")))).join(state, "address", "left")
    alias = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit(default))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", alias).alias("verdict"), "component")
