"""Column builders for text: cleaning, tokens, n-grams, predicates, similarities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config

TOKEN = r"[A-Za-z][A-Za-z0-9\-_/]*"
TOKEN_PAREN = r"[A-Za-z][A-Za-z0-9\-_/()]*"
# Forms that are terms whatever their words.
TECH = r"\b[A-Za-z]{1,4}\(\d+(?:,\d+)*\)-[A-Za-z]+(?:-[A-Za-z]+)*\b|\b[kK]-[sS][pP][aA][cC][eE]\b"
SPECIAL = r"(?i)SE\(3\)-equivariant|SE\(3\)|inverse Fourier transform|Fourier|\bDFT\b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def sanitize(c, replacement: str = " ") -> Column:
    """Debug markers out, white space collapsed."""
    out = col(c)
    for p in config.DEBUG_PATTERNS:
        out = F.regexp_replace(out, "(?i)" + p, replacement)
    return collapse(out)


def scrub_debug_terms(c) -> Column:
    out = F.lower(col(c))
    for term in config.DEBUG_TERMS:
        out = F.replace(out, F.lit(term), F.lit(""))
    return out


def vectorizer_text(title, abstract) -> Column:
    return F.lower(sanitize(F.concat_ws(" ", col(title), col(abstract))))


def letter_share(c) -> Column:
    """ASCII letters over all letters; null without letters."""
    letters = F.length(F.regexp_replace(col(c), r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(col(c), "[^A-Za-z]", "")) / letters)


def english_like(c, least: float = 0.8) -> Column:
    return F.coalesce(letter_share(c) >= least, F.lit(False))


def contains_any(c, words) -> Column:
    """Whether lower(text) has one of the words; an empty list passes all."""
    if not words:
        return F.lit(True)
    low = F.lower(col(c))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return F.coalesce(out, F.lit(False))


def keyword_hits(c, words) -> Column:
    low = F.lower(col(c))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def tokens(c, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(pattern.replace("A-Z", "")), F.lit(0))


def token_set(c, pattern: str = TOKEN) -> Column:
    return F.array_distinct(tokens(c, pattern))


def ngrams(toks, n: int) -> Column:
    """N-grams of a column of tokens; give a column, not an expression, or it is evaluated for each n-gram."""
    t = col(toks)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngram_set(toks, most: int = 3) -> Column:
    return F.array_distinct(F.flatten(F.array(*[ngrams(toks, n) for n in range(1, most + 1)])))


def jaccard(a, b) -> Column:
    """Of two sets; 0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def normalize_phrase(c) -> Column:
    return F.regexp_replace(F.lower(collapse(c)), r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", "")


def in_list(c, words) -> Column:
    return col(c).isin(*words)


def valid_phrase(c, generic: bool = False) -> Column:
    """At least 3 characters, no debug term, not only stop words, no verb-like or connecting token."""
    p = col(c)
    toks = tokens(p)
    only_stop = F.size(F.array_except(toks, F.array(*map(F.lit, config.ACADEMIC)))) == 0
    odd = F.size(F.array_intersect(toks, F.array(*map(F.lit, config.VERB_LIKE + config.CONNECTORS)))) > 0
    ok = (F.length(p) >= 3) & ~contains_any(p, config.DEBUG_TERMS) & ~only_stop & ~odd
    if generic:
        ok = ok & ~p.isin(*(config.ACADEMIC + config.DOMAIN_GENERIC))
    return ok


def ngram_len(c) -> Column:
    return F.size(F.split(F.trim(col(c)), r"\s+"))


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def symbol_ratio(c) -> Column:
    c = col(c)
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[A-Za-z0-9 ]", "")) / F.length(c)).otherwise(F.lit(0.0))


def technicality(c) -> Column:
    c = col(c)
    return c.rlike(r"[-()]").cast("int") + c.rlike(r"(^|[^A-Za-z0-9])[A-Z]{2,}([^A-Za-z0-9]|$)").cast("int")


def preview(c, n: int = 300) -> Column:
    body = collapse(c)
    return F.when(F.length(body) > n, F.concat(F.substring(body, 1, n), F.lit("..."))).otherwise(body)


def window_around(text, phrase, most: int = 25, left: int = 12) -> Column:
    """Words around the first hit of the phrase, ``left`` at most before it; the first words without a hit."""
    body, p = collapse(text), F.lower(col(phrase))
    at = F.instr(F.lower(body), p)
    before = F.filter(F.split(F.trim(F.substring(body, F.lit(1), at - 1)), " "), lambda w: w != "")
    after = F.filter(F.split(F.trim(F.substring(body, at + F.length(p), F.length(body))), " "), lambda w: w != "")
    kept = F.slice(before, F.greatest(F.size(before) - (left - 1), F.lit(1)), F.lit(left))
    right = F.slice(after, F.lit(1), F.lit(most) - F.size(kept) - 1)
    hit = F.array_join(F.concat(kept, F.array(F.substring(body, at, F.length(p))), right), " ")
    return F.when(at > 0, hit).otherwise(F.array_join(F.slice(F.split(body, " "), 1, most), " "))


def temperature(step, total) -> Column:
    step, total = col(step), col(total)
    t = F.when(total <= 1, F.lit(0.2)).otherwise(0.2 + 0.7 * step / F.greatest(total - 1, F.lit(1)))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.2), t)), 2)


def cache_key(*cols) -> Column:
    return F.sha2(F.concat_ws("|", *[col(c).cast("string") for c in cols]), 256)
