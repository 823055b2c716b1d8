"""Constants of the text-mining and reranking semantics."""

from __future__ import annotations

from dataclasses import dataclass

# Patterns and word lists that results depend on.
DEBUG_PATTERNS = (
    r"\[\s*updatedgpt[^\]]*\]",
    r"updatedgpt[_\-a-z0-9]*",
    r"\(\s*native\s*=\s*[^\)]*\)",
    r"\(\s*domain-specific concept\s*\)",
)
DEBUG_TERMS = ("updatedgpt", "native=", "domain-specific concept", "run-", "debug")
VERB_LIKE = ("use", "uses", "using", "reduce", "reduces", "preserve", "preserving", "improve", "improves")
CONNECTORS = ("to", "while", "under", "in", "for", "with", "and", "or")
ACADEMIC = (
    "model", "models", "method", "methods", "result", "results", "study", "studies", "approach", "approaches",
    "propose", "proposed", "demonstrate", "demonstrates", "show", "shows", "predict", "prediction", "predictions",
    "paper", "data", "dataset", "datasets", "system", "systems", "performance", "steps", "reduces", "using", "based",
    "analysis", "novel", "work", "framework", "introduction", "conclusion",
)
#: The shorter list of the annotation side.
ANNOTATION_ACADEMIC = (
    "model", "models", "method", "methods", "result", "results", "study", "studies", "approach", "approaches",
    "propose", "proposed", "demonstrate", "demonstrates", "show", "shows", "analysis", "framework", "introduction", "conclusion",
)
DOMAIN_GENERIC = ("system", "performance", "data", "dataset", "datasets", "paper", "papers", "task", "tasks", "general", "improve", "improves", "using", "based")
GENERIC_SCIENCE = (
    "temperature", "pressure", "reaction", "reactions", "adsorption", "uptake", "catalyst", "catalysts", "membrane",
    "membranes", "sample", "samples", "experiment", "experiments", "effect", "effects", "increase", "decrease",
    "process", "processes", "material", "materials", "energy",
)
BANNED_TERMS = ("model", "predict", "prediction", "steps", "reduces", "method", "methods", "results", "study", "approach", "propose", "show", "data", "system")
# English function words, without content of their own.
FUNCTION_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could", "did", "do", "does",
    "doing", "down", "during", "each", "either", "else", "ever", "every", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "however", "i", "if", "in", "into",
    "is", "it", "its", "itself", "just", "may", "me", "might", "more", "most", "much", "must", "my", "myself", "neither",
    "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "others", "our", "ours", "ourselves",
    "out", "over", "own", "perhaps", "rather", "same", "shall", "she", "should", "since", "so", "some", "such", "than", "that",
    "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "though", "through", "thus", "to",
    "too", "under", "until", "up", "upon", "us", "very", "was", "we", "were", "what", "when", "where", "whether", "which",
    "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you", "your", "yours",
)


@dataclass(frozen=True)
class Mining:
    min_df: int = 5
    max_df: float = 0.4
    top_n: int = 300
    simple_top_n: int = 200
    prior_mass: float = 1000.0
    z_weight: float = 0.7


@dataclass(frozen=True)
class Scoring:
    src_threshold: float = 0.35
    tgt_threshold: float = 0.45
    analog_threshold: float = 0.20
    top_analogs: int = 5
    evidence_hits: int = 2


@dataclass(frozen=True)
class Reward:
    semantic_floor: float = 0.55
    lex_weight: float = 0.35
    copy_weight: float = 0.5
    copy_limit: float = 0.86
    lex_clamp: float = 2.0
    z_clamp: float = 6.0
    strategy_weight: float = 0.15


@dataclass(frozen=True)
class Detection:
    min_words: int = 18
    min_confidence: float = 0.55
    min_gap: float = 0.10
    warning: float = 0.65
