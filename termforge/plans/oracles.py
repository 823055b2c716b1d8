"""DuckDB SQL of the queries."""

from .. import config


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_TOK = r"[a-z][a-z0-9\-_/]*"
_PUNCT = r"^[.,;:!?()\[\]{}\"'']+|[.,;:!?()\[\]{}\"'']+$"
_MARKED = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' (native = 0.00) updatedgpt_noself_v2 [ updatedgpt x ]' ELSE text END AS text FROM documents"


def _sanitize(c: str) -> str:
    for p in config.DEBUG_PATTERNS:
        c = f"regexp_replace({c}, '(?i){p}', ' ', 'g')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_ASCII_SHARE = r"length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
_SHARE = rf"CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 THEN {_ASCII_SHARE} END"

def _bad(c: str) -> str:
    return f"{c} NOT IN {_list(config.ACADEMIC + config.VERB_LIKE)} AND regexp_matches({c}, '^[a-z]')"


def _gap(c: str) -> str:
    return f"length({c}) = 1 AND NOT regexp_matches({c}, '^[a-z]')"


_PHRASES = rf"""
pw AS (SELECT doc_id, domain, i, p[i] AS w, p[i + 1] AS a1, p[i + 2] AS a2, p[i + 3] AS a3, p[i + 4] AS a4 FROM (
  SELECT doc_id, domain, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, lang AS domain, regexp_extract_all(lower(text), '[a-z][a-z0-9\-_/()]*|[^a-z]+') AS p FROM documents WHERE text IS NOT NULL))),
ph AS (
  SELECT DISTINCT doc_id, domain, w || ' ' || a2 AS phrase, 2 AS n FROM pw WHERE {_bad('w')} AND {_gap('a1')} AND {_bad('a2')}
  UNION ALL SELECT DISTINCT doc_id, domain, w || ' ' || a2 || ' ' || a4, 3 FROM pw WHERE {_bad('w')} AND {_gap('a1')} AND {_bad('a2')} AND {_gap('a3')} AND {_bad('a4')})
"""
_VALID = rf"""length(term) >= 3 AND NOT ({" OR ".join(f"contains(term, '{x}')" for x in config.DEBUG_TERMS)})
  AND len(list_filter(regexp_extract_all(term, '{_TOK}'), lambda x: x NOT IN {_list(config.ACADEMIC)})) > 0
  AND len(list_filter(regexp_extract_all(term, '{_TOK}'), lambda x: x IN {_list(config.VERB_LIKE + config.CONNECTORS)})) = 0
  AND term NOT IN {_list(config.ACADEMIC + config.DOMAIN_GENERIC)}"""
_GRID = rf"""
{_PHRASES.strip()},
one AS (SELECT doc_id, lang AS domain, unnest(list_distinct(regexp_extract_all(lower(text), '{_TOK}'))) AS term FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
all_terms AS (SELECT doc_id, domain, term FROM one UNION ALL SELECT doc_id, domain, phrase FROM ph WHERE domain IS NOT NULL),
often AS (SELECT term FROM all_terms GROUP BY term HAVING count(*) >= 5),
fine AS (SELECT term FROM often WHERE {_VALID}),
tok AS (SELECT doc_id, domain, term FROM all_terms SEMI JOIN fine USING (term)),
cnt AS (SELECT domain, term, count(*) AS c FROM tok GROUP BY ALL),
tot AS (SELECT term, CAST(sum(c) AS BIGINT) AS total FROM cnt GROUP BY term HAVING sum(c) >= 5),
voc AS (SELECT term, total FROM tot WHERE total <= floor((SELECT count(*) FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) * 0.4::DOUBLE)),
grid AS (SELECT d.domain, v.term, v.total, coalesce(cnt.c, 0) AS c FROM voc v CROSS JOIN (SELECT DISTINCT domain FROM cnt) d LEFT JOIN cnt ON cnt.domain = d.domain AND cnt.term = v.term),
s AS (SELECT *, sum(c) OVER (PARTITION BY domain) AS nd, sum(total) OVER (PARTITION BY domain) AS nt FROM grid),
y AS (SELECT *, c + total / nt * 1000::DOUBLE AS yd, total - c + total / nt * 1000::DOUBLE AS yo FROM s),
dl AS (SELECT *, ln(yd / greatest(nd + 1000::DOUBLE - yd, 1e-9)) - ln(yo / greatest(nt - nd + 1000::DOUBLE - yo, 1e-9)) AS delta FROM y),
mined AS (SELECT *, delta / sqrt(1 / greatest(yd, 1e-12) + 1 / greatest(yo, 1e-12)) AS z, c / greatest(nd::DOUBLE, 1e-12) * ln(1 + nt::DOUBLE / greatest(total, 1)) AS ctfidf FROM dl),
m6 AS (SELECT domain, term, c, total, round(delta, 6) AS delta, round(z, 6) AS z, ctfidf, 0.7 * z + (1 - 0.7::DOUBLE) * ln(1 + greatest(ctfidf, 0)) AS combined FROM mined)
"""
_TOPIC = f"CASE WHEN contains(term, ' ') THEN len(list_filter(string_split(term, ' '), lambda x: x IN {_list(config.GENERIC_SCIENCE)})) >= 2 ELSE term IN {_list(config.GENERIC_SCIENCE + config.ACADEMIC)} END"
_STYLE = f"style AS (SELECT domain, term, z, row_number() OVER (PARTITION BY domain ORDER BY len(string_split(term, ' ')) DESC, z DESC, term) AS rank FROM m6 WHERE NOT ({_TOPIC}) QUALIFY rank <= 300)"

_SIMPLE = rf"""
st0 AS (SELECT doc_id, lang AS domain, regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '{_PUNCT}', '', 'g') AS term FROM documents),
st AS (SELECT * FROM st0 WHERE regexp_matches(term, '^\p{{L}}+$') AND length(term) > 2),
sc AS (SELECT domain, term, count(*) AS c FROM st GROUP BY ALL),
sct AS (SELECT *, sum(c) OVER (PARTITION BY term) AS ct, sum(c) OVER (PARTITION BY domain) AS nd FROM sc),
lo AS (SELECT domain, term, c, ln(((c + 1) / (nd + v)) / ((ct - c + 1) / (nt - nd + v))) AS log_odds FROM sct, (SELECT sum(c) AS nt, count(DISTINCT term) AS v FROM sc) WHERE ct >= 5)
"""
_TFIDF = r"""
tt AS (SELECT * FROM (SELECT doc_id, lang AS domain, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL) WHERE term NOT IN """ + _list(config.FUNCTION_WORDS) + r"""),
tf AS (SELECT doc_id, domain, term, count(*) AS tf FROM tt GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
tw AS (SELECT doc_id, domain, tf.term, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
tn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM tw),
tm AS (SELECT domain, term, sum(u) / max(n) AS tfidf_mean FROM tn JOIN (SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang) l ON l.lang = tn.domain GROUP BY ALL)
"""
_PAIRS = """
pairs AS (SELECT conv_id, turn, text AS source, candidate FROM (
  SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS candidate FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant')
"""


def _set(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '{_TOK}'))"


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


_JAC = f"jac AS (SELECT conv_id, turn, round({_jac(_set('source'), _set('candidate'))}, 6) AS jaccard FROM pairs)"
_TRI = rf"""
btok AS (SELECT item_id, regexp_extract_all(lower(text), '{_TOK}') AS w FROM benchmark),
tri AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS term FROM btok)
"""


_HINTS = {"en": ("the ", " of "), "fr": (" de ", " la "), "de": ("der ", "ein"), "es": ("ción", " el ")}
_HIT = {k: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in v) for k, v in _HINTS.items()}
_ALL = " + ".join(_HIT.values())
_AMB = (
    "amb0 AS ("
    + " UNION ALL ".join(rf"SELECT doc_id, len(regexp_split_to_array(trim(text), '\s+')) AS words, '{k}' AS domain, round(CASE WHEN {_ALL} > 0 THEN ({h}) / ({_ALL}) ELSE 0.25 END, 6) AS p FROM documents" for k, h in _HIT.items())
    + """),
amb1 AS (SELECT *, row_number() OVER w AS k, lead(p) OVER w AS p2 FROM amb0 WINDOW w AS (PARTITION BY doc_id ORDER BY p DESC, domain)),
amb AS (SELECT doc_id, domain, p AS confidence, round(p - p2, 6) AS gap, CASE WHEN words < 18 THEN 'too_short' WHEN p < 0.55 THEN 'low_confidence' WHEN round(p - p2, 6) < 0.1 THEN 'small_gap' ELSE 'ok' END AS reason FROM amb1 WHERE k = 1)
"""
)
_EV = rf"""
lex AS (SELECT term, z FROM m6 WHERE domain = 'en' AND z > 0),
pt AS (SELECT conv_id, turn, regexp_extract_all(lower(candidate), '{_TOK}') AS w FROM pairs),
pg AS (SELECT conv_id, turn, unnest(list_distinct(w || list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) || list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS term FROM pt),
ev AS (SELECT conv_id, turn, least(2.0, sum(least(6.0, greatest(0.0, z)) * CASE len(string_split(term, ' ')) WHEN 1 THEN 0.25 WHEN 2 THEN 0.7 ELSE 1.0 END)) AS ev, count(*) AS hits FROM pg JOIN lex USING (term) GROUP BY ALL)
"""
_KIND = """
fr AS (SELECT term, delta FROM m6 WHERE domain = 'fr'),
kinds AS (SELECT term, native, symbols, CASE WHEN native >= 0.6 THEN 'equivalent' WHEN regexp_matches(term, 'tion$') OR symbols > 0.2 THEN 'intranslatable' ELSE 'unique' END AS kind FROM (
  SELECT term, round(CASE WHEN length(term) <= 2 THEN 0.8 ELSE 1 / (1 + exp(-delta)) END, 6) AS native, round(length(regexp_replace(term, '[A-Za-z0-9 ]', '', 'g')) / length(term), 6) AS symbols FROM fr))
"""

ORACLES = {
    "corpus_sanitize": rf"WITH c AS ({_MARKED}) SELECT doc_id, length({_sanitize('text')}) AS n_clean, regexp_matches(lower(text), 'updatedgpt|native\s*=') AS had_marker FROM c",
    "corpus_english_like": f"SELECT doc_id, round(coalesce({_SHARE}, 0), 6) AS share, coalesce({_SHARE} >= 0.95, false) AS english_like FROM documents",
    "corpus_filter_stages": f"SELECT lang, CASE WHEN length(text) < 400 THEN 'short' WHEN NOT coalesce({_SHARE} >= 0.95, false) THEN 'non_english' WHEN lang = 'en' AND NOT (contains(lower(text), 'the and') OR contains(lower(text), 'of the')) THEN 'keyword' ELSE 'kept' END AS stage, count(*) AS n FROM documents GROUP BY ALL",
    "corpus_counts_rollup": "SELECT lang AS domain, source AS src, count(*) AS n, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (lang, source)",
    "corpus_year_stats": "SELECT o_orderpriority, CAST(min(year(o_orderdate)) AS INTEGER) AS y_min, CAST(max(year(o_orderdate)) AS INTEGER) AS y_max, CAST(median(year(o_orderdate)) AS DOUBLE) AS y_median, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1",
    "corpus_balanced_size": "SELECT min(least(n, 120)) AS n FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "corpus_balanced_sample": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= (SELECT min(least(n, 60)) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))",
    "corpus_below_minimum": "SELECT domain, coalesce(n, 0) AS n, least FROM (VALUES ('en', 300), ('fr', 140), ('de', 140), ('es', 140), ('it', 10)) w(domain, least) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) h ON h.lang = w.domain WHERE coalesce(n, 0) < least",
    "corpus_length_stats": "SELECT lang, round(avg(length(text)), 6) AS avg_len, min(length(text)) AS min_len, max(length(text)) AS max_len, CAST(median(length(text)) AS DOUBLE) AS median_len FROM documents GROUP BY 1",
    "mine_token_counts": f"WITH {_SIMPLE} SELECT domain, term, c FROM sc",
    "mine_addone_logodds": f"WITH {_SIMPLE} SELECT domain, term, c, round(log_odds, 6) AS log_odds FROM lo",
    "mine_tfidf_mean": f"WITH {_TFIDF} SELECT domain, term, round(tfidf_mean, 6) AS tfidf_mean FROM tm",
    "mine_simple_lexicon": f"""WITH {_SIMPLE}, {_TFIDF},
      a AS (SELECT domain, term, 0 AS pool, row_number() OVER (PARTITION BY domain ORDER BY round(log_odds, 6) DESC, term) AS rank, round(log_odds, 6) AS log_odds FROM lo QUALIFY rank <= 600),
      b AS (SELECT domain, term, 1 AS pool, row_number() OVER (PARTITION BY domain ORDER BY round(tfidf_mean, 6) DESC, term) AS rank, 0::DOUBLE AS log_odds FROM tm QUALIFY rank <= 600),
      u AS (SELECT *, row_number() OVER (PARTITION BY domain, term ORDER BY pool, rank) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY k = 1)
      SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY pool, rank) AS INTEGER) AS pos, term, log_odds FROM u QUALIFY pos <= 200""",
    "mine_dirichlet_logodds": f"WITH {_GRID} SELECT domain, term, c, total, delta, z, CAST(row_number() OVER (PARTITION BY domain ORDER BY z DESC, term) AS INTEGER) AS rank FROM m6",
    "mine_ctfidf": f"WITH {_GRID} SELECT domain, term, c, round(ctfidf, 6) AS ctfidf FROM m6 WHERE c > 0",
    "mine_combined_topk": f"WITH {_GRID} SELECT domain, term, round(combined, 6) AS combined, CAST(row_number() OVER (PARTITION BY domain ORDER BY round(combined, 6) DESC, term) AS INTEGER) AS rank FROM m6 QUALIFY rank <= 50",
    "mine_vocab_removed": f"WITH {_GRID} SELECT term, total FROM tot WHERE total > floor((SELECT count(*) FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) * 0.4::DOUBLE)",
    "phrase_ngrams": f"WITH {_PHRASES} SELECT domain, n, count(*) AS occurrences, count(DISTINCT phrase) AS phrases FROM ph GROUP BY ALL",
    "phrase_style_topic": f"""WITH {_PHRASES}, g AS (SELECT domain, phrase, n, count(*) AS df FROM ph GROUP BY ALL HAVING count(*) >= 3)
      SELECT domain, phrase, n, df, CASE WHEN len(list_filter(string_split(phrase, ' '), lambda x: x IN {_list(config.GENERIC_SCIENCE)})) >= 2 THEN 'topic' ELSE 'style' END AS kind
      FROM g QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n * 1000000 + df DESC, phrase) <= 30""",
    "phrase_tech_patterns": r"""WITH t AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'A SE(3)-equivariant and SO(2)-equivariant-net k-space DFT inverse Fourier transform x-space ' || text ELSE text END AS t FROM documents)
      SELECT kind, m, count(*) AS n FROM (
        SELECT 'technical' AS kind, unnest(regexp_extract_all(t, '\b[A-Za-z]{1,4}\(\d+(?:,\d+)*\)-[A-Za-z]+(?:-[A-Za-z]+)*\b|\b[kK]-[sS][pP][aA][cC][eE]\b')) AS m FROM t
        UNION ALL SELECT 'special', unnest(regexp_extract_all(t, '(?i)SE\(3\)-equivariant|SE\(3\)|inverse Fourier transform|Fourier|\bDFT\b')) FROM t) GROUP BY ALL""",
    "phrase_valid": rf"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '{_TOK}') AS w FROM benchmark),
      p AS (SELECT DISTINCT item_id, regexp_replace(unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))), '{_PUNCT}', '', 'g') AS phrase FROM b),
      t AS (SELECT *, regexp_extract_all(phrase, '{_TOK}') AS k FROM p)
      SELECT item_id, phrase, length(phrase) >= 3 AND NOT ({" OR ".join(f"contains(phrase, '{x}')" for x in config.DEBUG_TERMS)})
        AND len(list_filter(k, lambda x: x NOT IN {_list(config.ACADEMIC)})) > 0 AND len(list_filter(k, lambda x: x IN {_list(config.VERB_LIKE + config.CONNECTORS)})) = 0
        AND phrase NOT IN {_list(config.ACADEMIC + config.DOMAIN_GENERIC)} AS ok FROM t""",
    "lexicon_overlap": f"""WITH {_GRID}, {_STYLE}, g AS (SELECT domain, list(term) AS s FROM style GROUP BY 1)
      SELECT a.domain AS a, b.domain AS b, round(len(list_intersect(a.s, b.s)) / greatest(len(list_distinct(list_concat(a.s, b.s))), 1), 6) AS jaccard FROM g a JOIN g b ON a.domain < b.domain""",
    "lexicon_gate": f"WITH {_GRID}, {_STYLE} SELECT domain, count(*) AS n_style, CAST(count_if(term IN {_list(config.BANNED_TERMS)}) AS BIGINT) AS n_banned, count(*) >= 30 AND count_if(term IN {_list(config.BANNED_TERMS)}) = 0 AS pass FROM style GROUP BY 1",
    "lexicon_keep_first": rf"WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '{_TOK}') AS w FROM benchmark), p AS (SELECT item_id, i - 1 AS pos, array_to_string(w[i:i + 1], ' ') AS term FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM b)) SELECT item_id, CAST(pos AS INTEGER) AS pos, term FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY item_id, pos) = 1",
    "term_score_flags": f"""WITH {_GRID}, l AS (SELECT domain, term FROM m6 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY z DESC, term) <= 50),
      per AS (SELECT term, coalesce(max(CASE WHEN domain = 'fr' THEN z END), 0) AS tz, coalesce(max(CASE WHEN domain = 'en' THEN z END), 0) AS sz, coalesce(max(CASE WHEN domain <> 'en' THEN z END), 0) AS oz FROM m6 GROUP BY term),
      x AS (SELECT per.*, EXISTS (SELECT 1 FROM l WHERE l.term = per.term AND l.domain = 'fr') AS in_t, EXISTS (SELECT 1 FROM l WHERE l.term = per.term AND l.domain = 'en') AS in_s FROM per),
      f AS (SELECT term, CASE WHEN tz <> 0 THEN 1 / (1 + exp(-tz / 2)) WHEN in_t THEN 0.6 ELSE 0.1 END AS fam, 1 / (1 + exp(-((CASE WHEN sz = 0 AND in_s THEN 0.8 ELSE sz END) - oz) / 2)) AS dist FROM x)
      SELECT term, round(fam, 4) AS familiarity, round(dist, 4) AS distinctiveness, fam <= 0.45 AND dist >= 0.35 AS flagged,
        CASE WHEN fam <= 0.45 AND dist >= 0.35 THEN 'src_distinctive+low_tgt_familiarity' WHEN dist >= 0.35 THEN 'src_distinctive' WHEN fam <= 0.45 THEN 'low_tgt_familiarity' ELSE 'not_flagged' END AS reason
      FROM f ORDER BY flagged DESC, distinctiveness DESC, familiarity, term LIMIT 200""",
    "term_strategy_class": f"WITH {_GRID}, {_KIND} SELECT * FROM kinds",
    "strategy_penalty": f"WITH {_GRID}, {_KIND} SELECT doc_id, round(least(0.35, sum(CASE kind WHEN 'unique' THEN 0.08::DOUBLE WHEN 'intranslatable' THEN 0.1::DOUBLE ELSE 0 END)), 6) AS penalty FROM tok JOIN kinds USING (term) WHERE domain = 'fr' GROUP BY 1",
    "analog_jaccard_topk": f"""WITH {_TRI}, a AS (SELECT DISTINCT term, list_distinct(string_split(term, ' ')) AS s FROM tri), b AS (SELECT DISTINCT term, list_distinct(string_split(term, ' ')) AS s FROM tri),
      ja AS (SELECT term, len(s) AS n, unnest(s) AS t FROM a), jb AS (SELECT term, len(s) AS n, unnest(s) AS t FROM b),
      sc AS (SELECT ja.term, jb.term AS candidate, round(count(*) / (max(ja.n) + max(jb.n) - count(*)), 6) AS score, count(*) / (max(ja.n) + max(jb.n) - count(*)) AS raw FROM ja JOIN jb USING (t) WHERE ja.term <> jb.term GROUP BY ALL)
      SELECT term, candidate, score, CAST(row_number() OVER (PARTITION BY term ORDER BY raw DESC, candidate) AS INTEGER) AS rank FROM sc WHERE raw >= 0.2 QUALIFY rank <= 5""",
    "analog_cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      s AS (SELECT p.vec_id AS probe, v.vec_id, round(list_dot_product(v.e, p.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(p.e, p.e))), 6) AS cosine FROM v JOIN v p ON p.vec_id % 50 = 0 AND p.vec_id <> v.vec_id)
      SELECT probe, vec_id, cosine, CAST(row_number() OVER (PARTITION BY probe ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "evidence_snippets": rf"""WITH {_TRI}, wt AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{_TOK}') AS w FROM documents),
      tk AS (SELECT doc_id, lang, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM wt),
      g3 AS (SELECT doc_id, lang, t || ' ' || lead(t) OVER v || ' ' || lead(t, 2) OVER v AS term FROM tk WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
      g AS (SELECT DISTINCT doc_id, lang, term FROM g3 WHERE term IN (SELECT term FROM tri)),
      c AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS c FROM documents)
      SELECT lang, term, doc_id, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY doc_id) AS INTEGER) AS k FROM g JOIN c USING (doc_id) WHERE contains(c, term) QUALIFY k <= 2""",
    "pair_jaccard": f"WITH {_PAIRS}, {_JAC} SELECT * FROM jac",
    "lex_evidence": f"WITH {_GRID}, {_PAIRS}, {_EV} SELECT p.conv_id, p.turn, coalesce(round(ev, 6), 0) AS evidence, coalesce(hits, 0) AS hits FROM pairs p LEFT JOIN ev USING (conv_id, turn)",
    "rerank_best": f"""WITH {_GRID}, {_PAIRS}, {_JAC}, {_EV},
      cand AS (SELECT conv_id, turn, jaccard AS semantic, round(coalesce(ev, 0), 6) AS evidence FROM jac LEFT JOIN ev USING (conv_id, turn)),
      t AS (SELECT *, round(CASE WHEN semantic >= 0.05 THEN 0.5 + 0.35 * evidence - 0.5 * greatest(0, semantic - 0.86) ELSE -1e9 END, 6) AS total FROM cand)
      SELECT *, total > -1e8 AS eligible FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, turn) = 1""",
    "autotune_grid": f"WITH {_PAIRS}, {_JAC} SELECT min_sem, weight, round(avg(jaccard * weight), 6) AS score, round(avg(CAST(jaccard < min_sem AS DOUBLE)), 6) AS fallback FROM jac, (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.15)) f(min_sem), (VALUES (0.2::DOUBLE), (0.35), (0.5), (0.8)) w(weight) GROUP BY ALL",
    "eval_rates": rf"SELECT role, count(*) AS turns, round(avg(CAST(n < 20 AS DOUBLE)), 6) AS short_rate, round(avg(n), 6) AS avg_tokens, round(CAST(median(n) AS DOUBLE), 6) AS median_tokens FROM (SELECT role, len(regexp_extract_all(lower(text), '{_TOK}')) AS n FROM conversations) GROUP BY 1",
    "eval_diversity": f"WITH c AS (SELECT conv_id, turn, {_set('text')} AS s FROM conversations WHERE role = 'assistant') SELECT a.conv_id, round(avg(round({_jac('a.s', 'b.s')}, 6)), 6) AS similarity, count(*) AS pairs FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1",
    "eval_route_matrix": "SELECT event_type, user_id % 4 AS route, count(*) AS n, CAST(count_if(value > 50) AS BIGINT) AS high, round(avg(value), 4) AS avg_value FROM events GROUP BY ALL",
    "eval_failures_topk": f"WITH {_PAIRS}, {_JAC} SELECT * FROM jac ORDER BY jaccard, conv_id, turn LIMIT 10",
    "eval_leak_flags": r"SELECT role, CAST(count_if(regexp_matches(lower(text), 'as an ai|system prompt|ignore previous')) AS BIGINT) AS leaks, CAST(count_if(regexp_matches(lower(text), 'updatedgpt|native\s*=')) AS BIGINT) AS debug, count(*) AS n FROM conversations GROUP BY 1",
    "source_ambiguity": f"WITH {_AMB} SELECT * FROM amb",
    "source_warning": f"WITH {_AMB} SELECT doc_id, domain <> lang AND confidence >= 0.65 AS warning FROM amb JOIN documents USING (doc_id)",
    "confidence_labels": f"WITH {_AMB} SELECT CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.55 THEN 'Medium' ELSE 'Low' END AS label, count(*) AS n FROM amb GROUP BY 1",
    "clf_stratified_split": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY lang) * 0.2::DOUBLE) AS is_val FROM documents",
    "clf_metrics": f"""WITH {_AMB}, p AS (SELECT lang AS label, domain AS guess FROM amb JOIN documents USING (doc_id)),
      t AS (SELECT label, count(*) AS support, count_if(label = guess) AS tp FROM p GROUP BY 1), g AS (SELECT guess, count(*) AS said FROM p GROUP BY 1),
      m AS (SELECT label, support, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS pr, tp / support AS rc FROM t LEFT JOIN g ON g.guess = t.label)
      SELECT label, support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM m""",
    "clf_confusion": f"WITH {_AMB} SELECT lang, domain, count(*) AS n FROM amb JOIN documents USING (doc_id) GROUP BY ALL",
    "resume_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "merge_keep_first": "SELECT md5(text) AS key, doc_id, CAST(CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS INTEGER) AS file_idx FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id % 2 DESC, doc_id) = 1",
    "sibling_reassign": "SELECT CASE WHEN lang = 'fr' AND contains(lower(text), 'tion') THEN 'fr_tion' ELSE lang END AS lang, count(*) AS n FROM documents GROUP BY 1",
    "duplicate_counts": "SELECT source, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY 1",
    "bandit_arms": "SELECT user_id AS route, event_type AS action, count(*) AS pulls, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "bandit_choice": "WITH a AS (SELECT user_id AS route, event_type AS action, round(avg(value), 6) AS mean FROM events GROUP BY ALL) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY route ORDER BY mean DESC, action) = 1",
    "bandit_running": "SELECT event_id, count(*) OVER w AS pulls, round(sum(value) OVER w, 3) AS total FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "feedback_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "stagnation_islands": "WITH e AS (SELECT user_id, CAST(value > 60 AS INTEGER) AS hi, sum(CAST(value > 60 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events), r AS (SELECT user_id, g, count(*) AS n FROM e WHERE hi = 0 GROUP BY ALL) SELECT user_id, max(n) AS longest FROM r GROUP BY 1",
    "time_slices": "SELECT strftime(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS slice, event_type, count(*) AS n FROM events GROUP BY ALL",
    "page_diagnostics": r"""WITH p AS (SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS b, lower(html) AS l FROM pages), v AS (SELECT *, CASE WHEN length(b) > 300 THEN substr(b, 1, 300) || '...' ELSE b END AS t FROM p)
      SELECT page_id, length(t) AS n_preview, starts_with(l, '<!doctype html') AS is_html, contains(l, 'nav') AS has_nav, regexp_matches(lower(t), 'attention required|cloudflare|captcha|challenge') AS waf, true AS waf_for_json FROM v""",
    "inverted_index_rebuild": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM documents",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS kinds FROM events GROUP BY 1",
    "cache_keys": "SELECT doc_id, sha256(doc_id || '|' || lang || '|en|4') AS key FROM documents",
    "temperature_schedule": "SELECT conv_id, total, step, round(least(1.0, greatest(0.2, CASE WHEN total <= 1 THEN 0.2 ELSE 0.2 + 0.7::DOUBLE * step / greatest(total - 1, 1) END)), 2) AS temperature FROM (SELECT conv_id, total, unnest(range(0, total)) AS step FROM (SELECT conv_id, count(*) AS total FROM conversations GROUP BY 1))",
    "policy_guard": "SELECT CASE WHEN contains(lower(text), 'this is') THEN 'banned_phrase' WHEN NOT contains(lower(text), 'th') THEN 'no_marker' ELSE 'ok' END AS verdict, count(*) AS n FROM conversations GROUP BY 1",
    "token_hits_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 30 GROUP BY 1",
}
