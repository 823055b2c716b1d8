"""Main-text extraction by wrapper induction.

Every page is parsed to a small tree of its block elements, runs of like
siblings folded into one.  Trees of one host are aligned by simple tree matching
and merged to the host's template: a node whose text is the same on all pages is
constant, the others are varying slots.  The content slot is the varying slot
with the strongest article mark-up or else the most text that is neither
constant nor in a boilerplate role.  A page is aligned with its host's template
and the text under the node that meets the content slot is returned, without the
blocks that stand under the same path with the same text on a share of the host's
pages (``SUPPORT``): these are constant nodes of the template, wherever they are,
and a few odd pages don't switch them off.  A page whose blocks are all constant
keeps them all.

Fewer than three pages of a host tell nothing constant; there the mark-up alone
decides.  Words in class names only choose between slots: without article
mark-up, a slot that holds most of the varying text is content whatever its name
(reader comments excepted).  Elements below the 200th level count with their
ancestor at it; only the choice of the slot depends on that.  The children of two
nodes are aligned exactly, however many there are.

Templates are merged in each task first, then by host and salt, then by host, so
a host with a third of all pages sends only small templates.  The pages that hold a
block are counted by host and block, in each task first.
"""

from __future__ import annotations

import hashlib
import html as _html
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .url_filter import url_parts

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head".split())
_NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg canvas object embed menu dialog title input label audio video math".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion promotions recommended related replies reply search share sharing sidebar sidenav skip social sponsor sponsored sponsors subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
_COMMENTS = frozenset("comment comments disqus replies reply".split())
_MAIN = {"article": 3, "main": 2}
_DEPTH = 200
#: Nodes with more child pairs are aligned row by row in NumPy, with the same result.
_WIDE = 4096
#: Degrees of boilerplate: by its name, or by its tag, role, visibility or as comments.
_SOFT, _HARD = 1, 2


class Node:
    __slots__ = ("tag", "label", "skip", "parent", "children", "depth")

    def __init__(self, tag: str, label: str, skip: int, parent: "Node | None"):
        self.tag, self.label, self.skip, self.parent = tag, label, skip, parent
        self.children: list = []
        self.depth = parent.depth + 1 if parent else 0


def _describe(tag: str, attrs: str) -> tuple[str, int]:
    """(label for alignment, degree of boilerplate by its tag or attributes)."""
    skip, names = _HARD * (tag in _NEVER), []
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                tokens = [re.sub(r"\d+", "#", x) for x in value.lower().split()]
                names += tokens
                parts = {w for t in tokens for w in re.split(r"[^a-z]+", t)}
                skip = max(skip, _HARD if parts & _COMMENTS else _SOFT * bool(parts & _WORDS))
            elif name == "role":
                names.append(value.lower())
                skip = max(skip, _HARD * (value.lower() in _ROLES))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                skip = _HARD
    if tag in ("html", "body", "article", "main"):
        skip = 0
    return tag + "".join("." + n for n in sorted(set(names))), skip


def parse(text: str) -> Node:
    """The tree of elements and text of a page; never fails on broken mark-up."""
    root = here = Node("#root", "#root", 0, None)
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if not m:
            here.children.append(text[at:])
            break
        if m.start() > at:
            here.children.append(text[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            up = here
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                here = up.parent
            continue
        if tag in _CLOSES_P:
            up = here
            while up.parent and up.tag != "p" and up.tag not in _BLOCK:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in _ENDED_BY:
            up = here
            while up.parent and up.tag not in _ENDED_BY[tag] and up.tag not in _SCOPE[tag]:
                up = up.parent
            if up.tag in _ENDED_BY[tag]:
                here = up.parent
        label, skip = _describe(tag, attrs)
        node = Node(tag, label, skip, here)
        here.children.append(node)
        if tag in _RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(text, at)
            node.children.append(text[at : end.start()])
            at = end.end()
        elif tag not in _VOID and not attrs.endswith("/"):
            here = node
    return root


def _path(node: Node) -> int:
    """A hash of the labels from the root to a node's innermost block element."""
    labels = []
    while node:
        if node.tag in _BLOCK:
            labels.append(node.label)
        node = node.parent
    return zlib.crc32("/".join(labels).encode("utf-8", "surrogatepass"))


def blocks(root: Node, skip: int = _SOFT) -> list[tuple[Node, str]]:
    """(element, text) of the blocks under a node, in page order, without boilerplate of degree ``skip`` or more."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []
    here = [root]

    def end() -> None:
        if run:
            if line := " ".join(_html.unescape("".join(run)).split()):
                out.append((here[-1], line))
            run.clear()

    stack: list = [iter(root.children)]
    breaks = [True]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if breaks.pop():
                end()
                here.pop()
        elif isinstance(child, str):
            run.append(child)
        elif child.skip >= skip:
            if child.tag in _BLOCK:
                end()
        elif child.tag == "header" and not any(not isinstance(c, str) and re.fullmatch("h[1-6]|hgroup", c.tag) for c in child.children):
            end()
        elif child.tag == "br":
            run.append(" ")
        else:
            block = child.tag in _BLOCK
            if block:
                end()
                here.append(child)
            stack.append(iter(child.children))
            breaks.append(block)
    end()
    return out


def keys(lines: list[tuple[Node, str]]) -> list[int]:
    """A key of each block: its path and its text."""
    paths: dict[int, int] = {}
    out = []
    for node, line in lines:
        if id(node) not in paths:
            paths[id(node)] = _path(node)
        out.append(paths[id(node)] << 64 | int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
    return out


# A template node: [label, degree of boilerplate, pages, varies, text length, hash, children].
def skeleton(root: Node) -> list:
    """The tree of block elements, runs of like siblings folded, with text sizes and hashes."""
    top = ["#root", 0, 1, False, 0, 0, []]
    todo = [(root, top)]
    while todo:
        node, mine = todo.pop()
        flat = list(reversed(node.children))
        while flat:
            child = flat.pop()
            if isinstance(child, str):
                body = child.strip()
                mine[4] += len(body)
                mine[5] = zlib.crc32(body.encode("utf-8", "surrogatepass"), mine[5])
            elif child.tag in _BLOCK and child.depth < _DEPTH and child.tag != "head":
                kids = mine[6]
                if kids and kids[-1][0] == child.label:
                    todo.append((child, kids[-1]))
                else:
                    kids.append([child.label, child.skip, 1, False, 0, 0, []])
                    todo.append((child, kids[-1]))
            elif not child.skip:
                flat.extend(reversed(child.children))
    return top


def _structures(nodes: list, known: dict) -> list[int]:
    """A number for each node, the same for nodes of equal labels all the way down."""
    return [known.setdefault((x[0], *_structures(x[6], known)), len(known)) for x in nodes]


def wide_match(left: list, right: list) -> tuple[int, list]:
    """As :func:`simple_tree_match` of two nodes with these children.

    Equal children are matched once.  Of the table only every n-th row is kept, n being the root of the number of rows;
    the rows between are made again on the way back.
    """
    known: dict = {}
    a, b = _structures(left, known), _structures(right, known)
    _, first, place = np.unique(np.array(b), return_index=True, return_inverse=True)
    weights: dict[int, np.ndarray] = {}

    def after(row: np.ndarray, i: int) -> np.ndarray:
        x = left[i]
        if a[i] not in weights:
            weights[a[i]] = np.array([simple_tree_match(x, right[k])[0] if x[0] == right[k][0] else 0 for k in first.tolist()], np.int64)
        out = np.zeros(len(row), np.int64)
        out[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[a[i]][place]))
        return out

    step, row, saved = int(len(left) ** 0.5) + 1, np.zeros(len(right) + 1, np.int64), {}
    for i in range(len(left)):
        if i % step == 0:
            saved[i] = row
        row = after(row, i)
    most, pairs, i, j = int(row[-1]), [], len(left), len(right)
    while i and j:
        base = (i - 1) // step * step
        rows = [saved[base]]
        for k in range(base, i):
            rows.append(after(rows[-1], k))
        while i > base and j:
            here = rows[i - base]
            if here[j] == rows[i - base - 1][j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return 1 + most, pairs[::-1]


def simple_tree_match(a: list, b: list) -> tuple[int, list]:
    """(number of matched nodes, matched child pairs) of two nodes of one label."""
    left, right = a[6], b[6]
    if not left or not right:
        return 1, []
    if len(left) * len(right) > _WIDE:
        return wide_match(left, right)
    w = [[simple_tree_match(x, y)[0] if x[0] == y[0] else 0 for y in right] for x in left]
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left)):
        for j in range(len(right)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + m[len(left)][len(right)], pairs[::-1]


def merge(a: list, b: list) -> list:
    """One template of two that have the same root label."""
    _, pairs = simple_tree_match(a, b)
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[6]), len(b[6]))]:
        kids += a[6][i:x] + b[6][j:y]
        if x < len(a[6]):
            kids.append(merge(a[6][x], b[6][y]))
        i, j = x + 1, y + 1
    return [a[0], min(a[1], b[1]), a[2] + b[2], a[3] or b[3] or a[5] != b[5] or a[4] * b[2] != b[4] * a[2], a[4] + b[4], a[5], kids]


def content_slot(template: list) -> tuple[str, ...] | None:
    """The path of labels to the content slot."""
    if not _marked(template):
        whole, _ = _slot_text(template, _HARD)
        todo = [template]
        while todo:
            for kid in todo.pop()[6]:
                if kid[1] == _SOFT and 2 * _slot_text(kid, _HARD)[0] > whole:
                    kid[1] = 0
                if kid[1] < _HARD:
                    todo.append(kid)
    best, todo = None, [(template, (), 0)]
    while todo:
        node, path, mark = todo.pop()
        if node[1]:
            continue
        here = (*path, node[0])
        tag = re.split(r"[.]", node[0])[0]
        mark = _MAIN.get(tag, 2 if node[0].endswith(".main") and tag != "html" else 0)
        size, own = _slot_text(node)
        rank = (mark if size else 0, own if not mark else size, -len(here))
        if best is None or rank > best[0]:
            best = rank, here
        todo += [(k, here, mark) for k in node[6]]
    return best and best[1]


def _marked(template: list) -> bool:
    """Whether article mark-up holds text."""
    todo = [template]
    while todo:
        node = todo.pop()
        if node[1]:
            continue
        if node[0].split(".")[0] in _MAIN and _slot_text(node)[0]:
            return True
        todo += node[6]
    return False


_FLOW = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "table", "dl", "figure")


def _slot_text(node: list, skip: int = _SOFT) -> tuple[int, int]:
    """(text in varying nodes below, text that belongs to this node: its own and its paragraphs'); nodes of degree ``skip`` left out."""
    size = own = 0
    todo = [(n, True) for n in [node]]
    while todo:
        n, mine = todo.pop()
        if n[1] >= skip and n is not node:
            continue
        if n[3] or n[2] < 3:  # constant text says nothing until three pages agree
            size += n[4]
            own += n[4] * mine
        todo += [(k, mine and k[0].split(".")[0] in _FLOW) for k in n[6]]
    return size, own


def extract(text: str | None, slot: tuple[str, ...] | None, constant: frozenset = frozenset()) -> str:
    """The main text of one page: the slot's blocks but for constant ones; all of them, if every one is constant."""
    if not text:
        return ""
    root = parse(text)
    found = _at(root, slot) if slot else []
    if not found or not any(blocks(x) for x in found):
        found = _at(root, content_slot(skeleton(root)) or ())
    lines = [line for x in (found or [root]) for line in blocks(x)]
    if constant:
        kept = [line for line, key in zip(lines, keys(lines)) if key not in constant]
        lines = kept or lines
    return "\n".join(line for _, line in lines)


def _at(root: Node, path: tuple[str, ...]) -> list[Node]:
    """The page's nodes that align with a template path, in page order; inline elements are seen through."""
    level = [root]
    for label in path[1:]:
        below: list[Node] = []
        for node in level:
            flat = [c for c in reversed(node.children) if not isinstance(c, str)]
            while flat:
                child = flat.pop()
                if child.tag in _BLOCK:
                    if child.label == label and child.skip < _HARD:
                        below.append(child)
                elif not child.skip:
                    flat.extend(c for c in reversed(child.children) if not isinstance(c, str))
        level = below
    return level


#: A block is constant if at least so many hundredths of its host's pages have it, of three pages or more.
SUPPORT = 90
#: Block counts that a task holds before it passes them on.
_HELD = 200_000


_PARTS = "host string, salt int, template binary, block string, pages long"


def _parts(pages: DataFrame) -> DataFrame:
    """Templates and block counts of the pages that a task has seen: rows of (host, salt, template, null, pages) or (host, null, null, block, pages)."""
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64())

    def induce(batches):
        trees: dict[str, list] = {}
        held: Counter = Counter()

        def flush():
            rows = [(h, zlib.crc32(p) % 32, p, None, t[2]) for h, t in trees.items() for p in [pickle.dumps(t)]]
            rows += [(h, None, None, format(k, "x"), n) for (h, k), n in held.items()]
            trees.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "salt", "template", "block", "pages"])

        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html")):
                if text := text.as_py():
                    root = parse(text)
                    own = skeleton(root)
                    trees[host] = merge(trees[host], own) if host in trees else own
                    held.update((host, k) for k in set(keys(blocks(root, _HARD))))
                if len(trees) > 4000 or len(held) > _HELD:
                    yield flush()
        if trees:
            yield flush()

    return pages.select("host", "html").mapInArrow(induce, _PARTS)


def _templates(parts: DataFrame) -> DataFrame:
    """(host, template): induced from every page of the host."""

    def join(table: pa.Table) -> pa.Table:
        done = None
        for p in sorted(table.column("template").to_pylist()):
            t = pickle.loads(p)
            done = merge(done, t) if done else t
        first = table.slice(0, 1)
        return pa.table([first.column("host"), first.column("salt"), pa.array([pickle.dumps(done)], pa.binary())], names=["host", "salt", "template"])

    schema = "host string, salt int, template binary"
    salted = parts.where("template is not null").select("host", "salt", "template").groupBy("host", "salt").applyInArrow(join, schema)
    return salted.groupBy("host").applyInArrow(join, schema).select("host", "template")


def _constants(parts: DataFrame) -> DataFrame:
    """(host, blocks): the blocks that at least SUPPORT hundredths of a host's pages have, of hosts of three pages or more."""
    hosts = parts.where("block is null").groupBy("host").agg(F.sum("pages").alias("all")).where("all > 2")
    counts = parts.where("block is not null").groupBy("host", "block").agg(F.sum("pages").alias("n")).where("n > 2")
    often = counts.join(hosts, "host").where(100 * F.col("n") >= SUPPORT * F.col("all"))
    return often.groupBy("host").agg(F.collect_set("block").alias("blocks"))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text by its host's wrapper.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by a newline in page order.  Null or
    empty html gives an empty text.  Pages without host share one template.
    Broken mark-up is repaired, never refused.  Repeated rows each get their
    row; an empty table gives none.  Other columns are ignored.
    """
    host, _, _ = url_parts(F.col(url))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))

    def slots(batches):
        for batch in batches:
            made = []
            for raw, same in zip(batch.column("template").to_pylist(), batch.column("blocks").to_pylist()):
                made.append(pickle.dumps((content_slot(pickle.loads(raw)), frozenset(int(k, 16) for k in same or []))))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.binary())], names=["host", "wrapper"])

    from .storage import Scratch

    scratch = Scratch(pages.sparkSession)
    parts = scratch.save(_parts(rows))
    wrappers = scratch.save(_templates(parts).join(_constants(parts), "host", "left").mapInArrow(slots, "host string, wrapper binary"))
    scratch.discard(parts)
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("wrapper") + F.lit(64)), F.lit(0)).alias("n")).first()["n"]
    kind = rows.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"

    def run(batches, known):
        for batch in batches:
            texts = [extract(t.as_py(), *(w or (None, frozenset()))) for t, w in zip(batch.column("html"), known(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: pickle.loads(r["wrapper"]) for r in wrappers.toLocalIterator()})
        return rows.mapInArrow(lambda batches: run(batches, lambda b: [shared.value.get(h) for h in b.column("host").to_pylist()]), out)
    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(lambda batches: run(batches, lambda b: [pickle.loads(w) if w else None for w in b.column("wrapper").to_pylist()]), out)
