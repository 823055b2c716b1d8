"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its word shingles.  Lines of one token set collapse to their
first occurrence.  Tokens are ordered from rare to frequent; two lines of
Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of
each (prefix filter), have lengths within t of each other (length filter), and
meet at a first common token with enough tokens left (positional filter).  Such
candidates are verified on their whole token sets.

Rarity is exact: the first tokens by hash are counted by a shuffle of tokens
alone, and those of more than ``HOT`` lines go last, by their counts.  Only lines
with such a token among their first ones need another prefix.  A line that
differs from a large group of like lines so has tokens of its own first, and
what it shares with the group comes too late for the positional filter.

A list of lines sharing a token is first compared with one line of each length
class, so a large group of like lines costs one comparison a line.  Lines that
are still undecided are then compared with all others of their lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import Scratch, free_name

#: Lines that share a token, above which the token counts as frequent.
HOT = 16
#: Lines of one token that one task takes.
_PART = 4096
_BLANK = " \t\r\f\u000b"
_MASK_WORDS = 1 << 15


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def with_tokens(df: DataFrame, line: str, out: str, shingle: int = 5) -> DataFrame:
    """``line`` replaced by ``out``: distinct hashes of its word shingles, ascending.

    Fewer words make one shingle, none make an empty array.  The words' hashes
    are a column of their own, so that they are made once.
    """
    trimmed = F.coalesce(F.btrim(F.lower(line), F.lit(_BLANK)), F.lit(""))
    hashed = df.withColumn("_blank", trimmed == "").withColumn("_words", F.transform(F.split(trimmed, r"\s+"), lambda w: F.xxhash64(w))).drop(line)
    w = F.col("_words")
    many = F.transform(F.slice(w, F.lit(1), F.size(w) - (shingle - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, shingle)]))
    grams = F.when(F.col("_blank"), F.array().cast("array<bigint>")).when(F.size(w) >= shingle, many).otherwise(F.array(F.xxhash64(w, F.size(w))))
    return hashed.withColumn(out, F.sort_array(F.array_distinct(grams))).drop("_words", "_blank")


def _prefix_len(n: Column, num: int) -> Column:
    """n - ceil(num / 100 * n) + 1."""
    return (n - F.ceil(n * num / 100.0 - 1e-9) + 1).cast("int")


def _bit_filter(keys: DataFrame, col: str) -> tuple[Column, Column]:
    """A test of 2^21 bits that every key in ``keys`` passes, for use before a join: (values literal, hash)."""
    h = F.pmod(F.xxhash64(col), F.lit(_MASK_WORDS * 64))
    rows = keys.select(h.alias("h")).groupBy(F.expr("h div 64").cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("h", F.lit(64)).cast("int"))).alias("b")).toArrow()
    words = [0] * _MASK_WORDS
    for w, b in zip(rows.column("w").to_pylist(), rows.column("b").to_pylist()):
        words[w] = b
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), h


def _passes(mask: Column, h: Column) -> Column:
    return F.call_function("shiftright", F.get(mask, (h / 64).cast("int")), F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


_ID = ("k_doc", "k_part", "k_line")


class _Lines:
    """The documents with a row key, and the token sets of wanted lines."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, shingle: int):
        self.shingle = shingle
        own = docs.select(F.col(doc_id).alias("k_doc"), F.col(text).alias("k_text"))
        self.again = own.groupBy("k_doc").count().where("count > 1").limit(1).count()
        # Rows that share an id are told apart by their text.
        self.part = F.xxhash64("k_text") if self.again else F.lit(0).cast("bigint")
        self.rows = own.where("k_text is not null").withColumn("k_part", self.part)

    def all(self) -> DataFrame:
        # An outer explode: for an inner one the optimizer adds a filter that splits the text again.
        return self.rows.select("k_doc", "k_part", F.posexplode_outer(_lines(F.col("k_text"))).alias("k_line", "line"))

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """(k_doc, k_part, k_line, ord, tokens) of the wanted (k_doc, k_part, k_line, ord); only lines that may be wanted leave their document."""
        own = wanted.select(F.col("k_doc").alias("w_doc"), F.col("k_part").alias("w_part"), F.col("k_line").alias("w_line"), "ord")
        mask, h = _bit_filter(wanted.select(F.xxhash64(*_ID).alias("k")), "k")
        some = self.all().withColumn("k", F.xxhash64(*_ID)).where(_passes(mask, h))
        met = some.join(own, F.col("k_doc").eqNullSafe(F.col("w_doc")) & (F.col("k_part") == F.col("w_part")) & (F.col("k_line") == F.col("w_line"))).select(*_ID, "ord", "line")
        # Repeated rows of one id and text bring their lines more than once.
        return with_tokens(met.dropDuplicates([*_ID, "ord"]) if self.again else met, "line", "tokens", self.shingle)


#: Bits of a line in the bitmap filter, in longs.
_WORDS = 4


def _bits(tokens: DataFrame) -> DataFrame:
    """(ord, bits) of (ord, tokens): longs in which every token has flipped one bit."""
    flip = lambda k: F.aggregate(
        F.filter("tokens", lambda t: F.pmod(t, F.lit(_WORDS)) == k), F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(t, 8), F.lit(64)).cast("int")))
    )
    return tokens.select("ord", F.array(*[flip(k) for k in range(_WORDS)]).alias("bits"))


def _fetch_ends(pairs: DataFrame, sets: DataFrame, lines: _Lines, scratch: Scratch) -> DataFrame:
    """(k_doc, k_part, k_line, ord, tokens) of every line in the pairs (x, y)."""
    ends = pairs.select(F.col("x").alias("e")).unionByName(pairs.select(F.col("y").alias("e"))).distinct()
    return scratch.save(lines.fetch(sets.join(ends, F.col("ord") == F.col("e")).select(*_ID, "ord")))


def _later(pairs: DataFrame, tokens: DataFrame, num: int, scratch: Scratch) -> DataFrame:
    """ord of the later line of every pair (x, y) whose Jaccard similarity is num / 100 or more."""
    side = lambda p: tokens.select(F.col("ord").alias(p + "ord"), F.struct(*_ID).alias(p + "at"), F.col("tokens").alias(p + "t"))
    both = pairs.join(side("l_"), F.col("x") == F.col("l_ord")).join(side("r_"), F.col("y") == F.col("r_ord"))
    shared = F.size(F.array_intersect("l_t", "r_t"))
    alike = both.where(100 * shared >= num * (F.size("l_t") + F.size("r_t") - shared))
    return scratch.save(alike.select(F.when(F.col("l_at") < F.col("r_at"), F.col("r_ord")).otherwise(F.col("l_ord")).alias("gone")).distinct())


def _by_rarity(sets: DataFrame, lines: _Lines, num: int, scratch: Scratch) -> DataFrame:
    """(ord, n, pre) of ``sets`` with the frequent tokens last; pre has the tokens and the parts of their lists."""
    plain = lambda s: s.select("ord", "n", F.transform("pre", lambda t: F.struct(t.alias("t"), F.lit(0).alias("parts"))).alias("pre"))
    hot = scratch.save(sets.select(F.explode_outer("pre").alias("t")).groupBy("t").count().where(F.col("count") > HOT))
    scratch.release()
    if hot.isEmpty():
        return plain(sets)

    def holding(keys: DataFrame):
        mask, _ = _bit_filter(keys.select("t"), "t")
        maybe = lambda t: _passes(mask, F.pmod(F.xxhash64(t), F.lit(_MASK_WORDS * 64)))
        return maybe, F.exists("pre", maybe)

    def fetched(which: Column) -> DataFrame:
        return scratch.save(lines.fetch(sets.where(which).select(*_ID, "ord")).select("ord", "tokens"))

    # Tokens that no line has among its first ones are frequent too: all tokens of the lines found are counted.
    _, warm = holding(hot)
    tokens = some = fetched(warm)
    hot = scratch.save(tokens.select(F.explode_outer("tokens").alias("t")).groupBy("t").count().where(F.col("count") > HOT))
    scratch.release()
    maybe, also = holding(hot)
    more = fetched(also & ~warm)
    tokens, warm = tokens.unionByName(more), warm | also
    # Only the tokens that may be frequent leave their row to be looked up.
    asked = tokens.select("ord", F.explode_outer(F.filter("tokens", maybe)).alias("t")).where("t is not null")
    found = asked.join(hot.select(F.col("t").alias("h"), "count"), F.col("t") == F.col("h")).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct(F.col("count").alias("c"), "t"))).alias("last"))
    none = F.array().cast("array<struct<c:bigint,t:bigint>>")
    met = tokens.join(found.withColumnRenamed("ord", "f_ord"), F.col("ord") == F.col("f_ord"), "left").select("ord", "tokens", F.coalesce("last", none).alias("last"))
    first = F.transform(F.array_except("tokens", F.transform("last", lambda x: x["t"])), lambda t: F.struct(F.lit(0).cast("bigint").alias("c"), t.alias("t")))
    ranked = met.select("ord", F.size("tokens").alias("n"), F.slice(F.concat(first, F.col("last")), F.lit(1), _prefix_len(F.size("tokens"), num)).alias("x"))
    pre = F.transform("x", lambda s: F.struct(s["t"].alias("t"), F.floor(s["c"] / _PART).cast("int").alias("parts")))
    # The first tokens alone are kept: the whole sets and the shuffles that ranked them are gone before the postings are dealt.
    ranked = scratch.save(ranked.select("ord", "n", pre.alias("pre")))
    for whole in (some, more):
        scratch.discard(whole)
    del tokens, asked, found, met
    scratch.release()
    return plain(sets.where(~warm)).unionByName(ranked)


def similar_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """(k_doc, k_part, k_line) of every line with an earlier line of the same or a similar token set."""
    scratch = scratch or Scratch(docs.sparkSession)
    lines = _Lines(docs, doc_id, text, shingle)
    # Blank lines are told by the text: a filter on the tokens would be pushed down and compute them twice.
    heavy = with_tokens(lines.all().where(F.btrim("line", F.lit(_BLANK)) != ""), "line", "t", shingle)
    n = F.size("t")
    table = scratch.save(heavy.select(*_ID, F.monotonically_increasing_id().alias("ord"), F.xxhash64("t", n).alias("s1"), F.xxhash64(n, "t").alias("s2"), n.alias("n"), F.slice("t", F.lit(1), _prefix_len(n, similarity)).alias("pre")))
    sets = scratch.save(table.groupBy("s1", "s2").agg(F.min(F.struct(*_ID, "ord")).alias("at"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("pre").alias("pre")).select("at.*", "s1", "s2", "m", "n", "pre"))
    occurrences = scratch.save(table.select(*_ID, "s1", "s2"))
    scratch.discard(table)
    scratch.release()

    posting = _by_rarity(sets, lines, similarity, scratch).select("ord", "n", F.posexplode_outer("pre").alias("pos", "x")).select("ord", "n", "pos", "x.*")
    scratch.release()
    # Two longs and two small numbers a row: the id of a line is looked up for the few that meet.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / similarity))).cast("bigint")
    salt = F.when(F.col("parts") > 0, 1 + F.pmod(F.xxhash64("ord"), F.col("parts"))).otherwise(F.lit(0)).cast("bigint")
    packed = posting.select("t", "ord", F.expr("cast(n as bigint) * 2147483648 + pos").alias("np"), salt.alias("salt"))
    dealt = packed.repartition("t", "salt").select("t", "ord", F.expr("np div 2147483648").alias("n"), F.expr("np % 2147483648").alias("pos"), "salt").withColumn("band", band)
    size = F.count("*").over(Window.partitionBy("t", "salt"))
    head = F.min(F.struct("pos", "ord")).over(Window.partitionBy("t", "salt", "band"))["ord"]
    lists = scratch.save(dealt.withColumn("size", size).where("size > 1 or salt > 0").withColumn("head", head).drop("size"))
    scratch.release()

    heads = lists.select(F.col("head").alias("x"), F.col("ord").alias("y"))
    # The heads of a frequent token's parts meet the first of them.
    tops = lists.where("salt > 0").groupBy("t", "band").agg(F.min("head").alias("x")).select(F.col("t").alias("p_t"), F.col("band").alias("p_band"), "x")
    parts = lists.where("salt > 0").select("t", "band", "head").distinct()
    heads = heads.unionByName(parts.join(tops, (F.col("t") == F.col("p_t")) & (F.col("band") == F.col("p_band"))).select("x", F.col("head").alias("y")))
    first_pairs = scratch.save(heads.where("x <> y").distinct())
    tokens = _fetch_ends(first_pairs, sets, lines, scratch)
    decided = _later(first_pairs, tokens, similarity, scratch)

    # Lines still undecided against all others of their lists, but for pairs already compared.  A line of a frequent
    # token meets every part of its list in another task.
    bits = _bits(tokens)
    known = scratch.save(lists.join(bits.select(F.col("ord").alias("b_ord"), "bits"), F.col("ord") == F.col("b_ord"), "left").select("t", "salt", "ord", "n", "pos", "bits"))
    side = lambda p: known.select(*[F.col(c).alias(p + c) for c in known.columns])
    spread = known.where("salt > 0").groupBy(F.col("t").alias("s_t")).agg(F.max("salt").alias("parts"))
    y = side("y_").join(decided.select(F.col("gone").alias("d")), F.col("y_ord") == F.col("d"), "left_anti").join(spread, F.col("y_t") == F.col("s_t"), "left")
    y = y.withColumn("y_part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(1).cast("bigint"), F.col("parts"))))).drop("s_t", "parts", "y_salt")
    both = F.col("x_n") + F.col("y_n")
    fits = (100 * F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n")) & ((100 + similarity) * F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= similarity * both)
    differ = sum((F.bit_count(F.get("x_bits", F.lit(k)).bitwiseXOR(F.get("y_bits", F.lit(k)))) for k in range(_WORDS)), F.lit(0))
    # Without bits of both the sum is null, and the pair passes.
    near = F.coalesce((100 + similarity) * differ <= (100 - similarity) * both, F.lit(True))
    met = y.join(side("x_"), (F.col("x_t") == F.col("y_t")) & (F.col("x_salt") == F.col("y_part")) & (F.col("x_ord") != F.col("y_ord")) & fits & near)
    rest = met.select(F.least("x_ord", "y_ord").alias("x"), F.greatest("x_ord", "y_ord").alias("y")).distinct()
    seen = first_pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    rest = scratch.save(rest.join(seen, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left_anti"))
    scratch.discard(known)
    scratch.discard(tokens)
    if rest.isEmpty():
        gone = decided
    else:
        tokens = _fetch_ends(rest, sets, lines, scratch)
        gone = scratch.save(decided.unionByName(_later(rest, tokens, similarity, scratch)).distinct())
        scratch.discard(tokens)
    scratch.discard(lists)

    removed = sets.join(gone, F.col("ord") == F.col("gone"), "left").where("m > 1 or gone is not null")
    removed = removed.select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), F.struct(*_ID).alias("at"), F.col("gone").isNotNull().alias("similar"))
    met = occurrences.join(removed, (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")))
    return met.where(F.col("similar") | ~F.struct(*_ID).eqNullSafe(F.col("at"))).select(*_ID)


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: int = 75) -> DataFrame:
    """The documents with later near-duplicates of lines removed from their text.

    A line's tokens are the distinct shingles of ``shingle`` lower-cased words
    (all words, if fewer).  A line goes if a line before it, by document id and
    position, has the same tokens or a Jaccard similarity of ``similarity``
    hundredths or more.  Lines without words stay.  Adds n_lines and n_removed.

    Null texts stay null with counts of 0.  Rows with equal id and text are
    taken as one document and end alike; rows with equal id and other texts are
    told apart.  Null ids sort first.  An empty table gives no rows.  Columns
    named n_lines or n_removed in the input are replaced, others are kept,
    whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.drop("n_lines", "n_removed")
    doc, part, own, gone, each = (free_name(docs, c) for c in ("doc_key", "part_key", "part_own", "lines_gone", "lines_all"))
    lists = similar_lines(docs, doc_id=doc_id, text=text, shingle=shingle, similarity=similarity, scratch=scratch)
    lists = scratch.save(lists.groupBy(F.col("k_doc").alias(doc), F.col("k_part").alias(part)).agg(F.collect_set("k_line").alias(gone)))
    scratch.release()
    again = docs.groupBy(doc_id).count().where("count > 1").limit(1).count()
    count = lambda lines: F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines")
    # Documents that lose no line stay where they are.
    mask, h = _bit_filter(lists.select(F.col(doc).alias("d")), "d")
    h = F.pmod(F.xxhash64(doc_id), F.lit(_MASK_WORDS * 64))
    whole = base.where(~_passes(mask, h)).select(*base.columns, count(_lines(F.col(text))), F.lit(0).cast("long").alias("n_removed"))
    some = base.where(_passes(mask, h)).withColumn(own, F.xxhash64(text) if again else F.lit(0).cast("bigint"))
    met = some.join(lists, some[doc_id].eqNullSafe(F.col(doc)) & (F.col(own) == F.col(part)), "left").withColumn(each, _lines(F.col(text)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(each) - 1), gone), lambda i: F.get(each, i))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    cols = [new.alias(text) if c == text else F.col(c) for c in base.columns]
    cut = met.select(*cols, count(F.col(each)), F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_removed"))
    return whole.unionByName(cut)
