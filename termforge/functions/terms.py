"""Column builders for terms, requests, source rows, fallbacks and prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as T

# Word lists, patterns and texts that results depend on.
ACRONYMS = {
    "dft": "density functional theory",
    "pde": "partial differential equation",
    "ode": "ordinary differential equation",
    "gnn": "graph neural network",
    "ml": "machine learning",
}
STRATEGY_STOPWORDS = ("a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "under", "with", "we", "our")
NOISY_TERMS = ("model", "predict", "prediction", "steps", "reduces", "method", "methods", "result", "results", "study", "approach", "propose", "show", "data", "system")
ANCHORS = ("energy", "diffusion", "entropy", "rate", "stability", "transport", "barrier", "functional", "reaction", "graph", "constraint")
FORMAL = ("sigma-algebra", "lebesgue", "hilbert", "banach", "measure theory", "sobolev", "riemann", "stokes theorem", "lagrangian density")
EVAL_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "under", "with", "when", "while", "we", "our")
LEAK = r"\(domain-specific concept\)|\(native=|\[updatedgpt|native=0\.00"
DEBUG = r"updatedgpt|run\d{2,}|noself|debug"
BANNED_PHRASES = ("equivalent to", "identical to", "is the same as")
REQUIRED_PHRASES = ("analogous", "conceptually similar", "shares structural similarity")
CHEME_HINTS = ("reactor", "separation", "distillation", "membrane", "adsorption", "mass transfer", "transport", "process control", "reaction engineering", "heat transfer", "column", "reflux")
CHEM_HINTS = ("transition state", "substituent", "synthesis", "molecule", "molecular", "ligand", "spectroscopy", "reaction mechanism")
CHEME_KEYWORDS = ("reactor", "separation", "distillation", "membrane", "adsorption", "catalysis", "mass transfer", "transport", "process control", "reaction engineering", "heat transfer")
LEADS = {
    "CSM": "From a computational modeling perspective, ",
    "PM": "From a physics-oriented interpretation, ",
    "CHEM": "From a chemistry perspective, ",
    "CHEME": "From a chemical engineering standpoint, ",
    "CCE": "From a process-engineering standpoint, ",
}
FALLBACK_REASONS = ("no_key", "timeout", "api_error", "filter_empty", "other")
ACTIONS = ("literal", "domain_steered", "process_framing", "educator")


def words(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items])


def normalize_term(c) -> Column:
    """Lower case, one space between words, other characters than ``a-z0-9-_/`` out, acronyms written out."""
    t = F.regexp_replace(F.lower(T.collapse(c)), r"[^a-z0-9\-_/ ]+", "")
    out = t
    for short, long in ACRONYMS.items():
        out = F.when(t == short, F.lit(long)).otherwise(out)
    return out


def term_noise(normal) -> Column:
    """Of a normalised term: empty, a debug marker, only stop words, or one word that says nothing."""
    t = T.col(normal)
    toks = F.filter(F.split(t, " "), lambda x: x != "")
    marker = t.contains("updatedgpt") | t.contains("native=") | t.contains("domain-specific concept")
    return (F.size(toks) == 0) | marker | (F.size(F.array_except(toks, words(*STRATEGY_STOPWORDS))) == 0) | ((F.size(toks) == 1) & F.get(toks, F.lit(0)).isin(*NOISY_TERMS))


def contains_leak(c) -> Column:
    return F.coalesce(T.col(c).rlike("(?i)" + LEAK), F.lit(False))


def debug_term(c) -> Column:
    return F.coalesce(T.col(c).rlike("(?i)" + DEBUG), F.lit(False))


def stopword_only(c) -> Column:
    """No token, or none outside the list of the evaluation."""
    return F.size(F.array_except(T.tokens(c), words(*EVAL_STOPWORDS))) == 0


def policy_verdict(short, long) -> Column:
    """banned_phrase, no_analogy or ok, for an explanation's two texts."""
    low = F.lower(F.concat_ws(" ", F.coalesce(T.col(short), F.lit("")), F.coalesce(T.col(long), F.lit(""))))
    has = lambda phrases: F.exists(words(*phrases), lambda p: F.contains(low, p))
    return F.when(has(BANNED_PHRASES), "banned_phrase").when(~has(REQUIRED_PHRASES), "no_analogy").otherwise("ok")


def request_text(c, most: int = 1200) -> Column:
    """White space collapsed, ``most`` characters at most (128 at least)."""
    return F.substring(T.collapse(c), 1, max(128, most))


def truthy(c) -> Column:
    return F.coalesce(F.lower(F.trim(T.col(c))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def category_match(categories, filters) -> Column:
    """Whether a filter is part of the joined lower-cased categories; no filters pass all."""
    if not filters:
        return F.lit(True)
    low = F.lower(F.array_join(T.col(categories), " | "))
    return F.exists(words(*[f.lower() for f in filters]), lambda f: F.contains(low, f))


def category_names(c) -> Column:
    """Names of a JSON list of strings or objects (name, label or title), in order; empty ones out."""
    items = F.from_json(T.col(c), "array<string>")
    named = F.transform(items, lambda x: F.when(F.substring(x, 1, 1) == "{", F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("name", "label", "title")])).otherwise(x))
    return F.coalesce(F.filter(named, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def normalize_categories(c) -> Column:
    """Trimmed, ordered, each once; empty ones out."""
    return F.array_distinct(F.filter(F.transform(T.col(c), lambda x: F.trim(x)), lambda x: x != ""))


def safe_name(c) -> Column:
    return F.regexp_replace(T.col(c), r"[^A-Za-z0-9_\-]", "_")


def first_of(*cols) -> Column:
    """The first that is neither null nor empty; else an empty string."""
    return F.coalesce(*[F.nullif(T.col(c), F.lit("")) for c in cols], F.lit(""))


def concept_score(concepts, suffix: str) -> Column:
    """Largest score of the concepts (id, score) whose id ends in ``suffix``; 0 without one."""
    hit = F.filter(T.col(concepts), lambda x: x["id"].endswith(suffix))
    return F.coalesce(F.array_max(F.transform(hit, lambda x: F.coalesce(x["score"], F.lit(0.0)))), F.lit(0.0))


def chemistry_domain(keyword: Column, chem: Column, cheme: Column) -> Column:
    return F.when(keyword | ((cheme >= chem) & (cheme > 0)), "CHEME").otherwise("CHEM")


def fallback_reason(reasons) -> Column:
    """The first of the priorities that occurs in the array, or null."""
    return F.get(F.filter(words(*FALLBACK_REASONS), lambda r: F.array_contains(T.col(reasons), r)), F.lit(0))


def provider_error(c, configured: Column | None = None) -> Column:
    """The fallback reason of a provider's error message: quota is api_error, and all that is neither quota nor time is other.

    ``configured`` is false for a provider that isn't set up: no_key if the message says so, else api_error.
    """
    t = F.coalesce(T.col(c), F.lit(""))
    low = F.lower(t)
    quota = t.contains("429") | t.contains("RESOURCE_EXHAUSTED")
    known = F.when(quota, "api_error").when(low.contains("timeout") | low.contains("timed out"), "timeout").otherwise("other")
    if configured is None:
        return known
    return F.when(configured, known).otherwise(F.when(low.contains("api_key") | low.contains("not configured"), "no_key").otherwise("api_error"))


def fallback_translation(c, tgt) -> Column:
    """A lead phrase of the target, and the text with a lower first letter."""
    t, g = T.col(c), T.col(tgt)
    lead = F.concat(F.lit("In "), g, F.lit(" terms, "))
    for k, v in LEADS.items():
        lead = F.when(g == k, F.lit(v)).otherwise(lead)
    return F.concat(lead, F.when(F.length(t) > 1, F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))).otherwise(t))


def prompt(action, text, src, tgt, instructions, hints) -> Column:
    """A prompt of labelled lines with 20 hints at most."""
    some = F.array_join(F.slice(T.col(hints), 1, 20), ", ")
    return F.concat_ws("\n", F.concat(F.lit("Action: "), T.col(action)), F.concat(F.lit("From: "), T.col(src), F.lit(" to: "), T.col(tgt)), F.concat(F.lit("Hints: "), some), T.col(instructions), F.concat(F.lit("Text: "), T.col(text)))


def explanation(term, src, tgt) -> Column:
    """The text of a stand-in for a provider: it keeps to the policy."""
    return F.format_string("%s in %s is analogous to a concept of %s.", T.col(term), T.col(src), T.col(tgt))


def action_slots(k: int, extra: Column | None = None) -> Column:
    """(slot, action): the first actions in order, further slots by ``extra``."""
    own = F.transform(F.sequence(F.lit(1), F.lit(min(k, len(ACTIONS)))), lambda i: F.element_at(words(*ACTIONS), i))
    return own if k <= len(ACTIONS) or extra is None else F.concat(own, F.array_repeat(extra, k - len(ACTIONS)))


def normalized(p) -> Column:
    """A map of probabilities: negative ones as 0, of sum 1; even if all are 0."""
    m = F.transform_values(T.col(p), lambda _, v: F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0))))
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(m, lambda _, v: F.when(total > 0, v / total).otherwise(1.0 / F.greatest(F.size(m), F.lit(1))))


def split_share(text) -> Column:
    """The share of a joint class that goes to the first of its two parts, by hint words; .45 without any."""
    a, b = T.keyword_hits(text, CHEM_HINTS), T.keyword_hits(text, CHEME_HINTS)
    return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.45))


def refine_span(toks, trim_words) -> Column:
    """(first, last): the tokens left when ``trim_words`` go from both ends; all, if none is left."""
    t = T.col(toks)
    kept = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: ~F.array_contains(words(*trim_words), F.lower(F.element_at(t, i))))
    return F.when(F.size(t) == 0, F.lit(None)).when(F.size(kept) > 0, F.struct(F.array_min(kept).alias("first"), F.array_max(kept).alias("last"))).otherwise(F.struct(F.lit(1).alias("first"), F.size(t).alias("last")))
