"""SQL of the further queries, for DuckDB; lists and patterns are written out here, so that they check those of the library."""

from .. import config
from .logs import SQL as LOG
from .oracles import _GRID, _TOPIC
from .oracles import ORACLES as _BASE

_TOK = "regexp_extract_all(lower({}), '[a-z][a-z0-9\\-_/]*')"
_JAC = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE ELSE 0.0 END"

_SIM = LOG + ", st AS (SELECT case_id, cand, list_distinct(" + _TOK.format("text") + """) AS s FROM cand JOIN good USING (case_id) WHERE cand.text <> ''),
sim AS (SELECT a.case_id, avg(""".replace("cand.text", "cand.text") + _JAC.format(a="a.s", b="b.s") + """) AS similarity FROM st a JOIN st b ON a.case_id = b.case_id AND a.cand < b.cand GROUP BY a.case_id),
tm AS (
  SELECT case_id, cand.term IS NOT NULL AS has, cand.term = 'the of' AS stop, regexp_matches(cand.term, '(?i)updatedgpt|run\\d{2,}|noself|debug') AS bug
  FROM cand JOIN good USING (case_id))
"""
_SIM = _SIM.replace("lower(text)", "lower(cand.text)")

ORACLES = {}
ORACLES["eval_summary"] = _SIM + """
, o AS (
  SELECT count(*) AS n, round(avg(used_fallback::INT::DOUBLE), 6) AS fallback_rate,
    round(avg(semantic), 6) AS semantic_avg, round(avg(copy), 6) AS copy_avg, round(avg(domain), 6) AS domain_avg, round(avg(lex), 6) AS lex_avg,
    round(median(semantic), 6) AS semantic_median, round(median(copy), 6) AS copy_median, round(median(domain), 6) AS domain_median, round(median(lex), 6) AS lex_median,
    round(avg(leak::INT::DOUBLE), 6) AS leak_rate, count(*) FILTER (WHERE lex > 1.0 AND semantic < 0.75) AS hacks
  FROM good JOIN leaky ON leaky.case_id = good.case_id AND leaky.cand = 0
), t AS (SELECT count(*) AS n_terms, count(*) FILTER (WHERE stop) AS n_stop, count(*) FILTER (WHERE bug) AS n_debug FROM tm),
m AS (SELECT round(avg(similarity), 6) AS similarity FROM sim)
SELECT o.*, t.*, m.*, round(n_terms / n::DOUBLE, 6) AS terms_avg, round(n_stop / n_terms::DOUBLE, 6) AS stop_share, round(n_debug / n_terms::DOUBLE, 6) AS debug_share,
  CASE WHEN hacks > 0 THEN 'YES' ELSE 'NO' END AS flag_hacks, CASE WHEN leak_rate > 0 THEN 'YES' ELSE 'NO' END AS flag_leaks,
  CASE WHEN n_stop + n_debug > 0 THEN 'YES' ELSE 'NO' END AS flag_noise, CASE WHEN similarity > 0.7 THEN 'YES' ELSE 'NO' END AS flag_alike
FROM o, t, m
"""
ORACLES["eval_routes"] = LOG + """
, r AS (
  SELECT src, tgt, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, coalesce(avg(used_fallback::INT::DOUBLE) FILTER (WHERE ok), 0.0) AS fallback,
    coalesce(avg(warned::INT::DOUBLE) FILTER (WHERE ok), 0.0) AS warned, coalesce(avg(semantic) FILTER (WHERE ok), 0.0) AS semantic, coalesce(avg(copy) FILTER (WHERE ok), 0.0) AS copy
  FROM cases GROUP BY src, tgt)
SELECT src, tgt, n, n_ok, round(fallback, 6) AS fallback, round(warned, 6) AS warned, round(semantic, 6) AS semantic, round(copy, 6) AS copy,
  concat_ws(',', CASE WHEN fallback >= 0.5 THEN 'fallback' END, CASE WHEN copy >= 0.9 THEN 'copy' END, CASE WHEN semantic < 0.55 THEN 'semantic' END) AS problems
FROM r
"""
ORACLES["eval_failure_lists"] = _SIM + """
, nz AS (SELECT case_id, -((count(*) FILTER (WHERE stop) + count(*) FILTER (WHERE bug)) / count(*)::DOUBLE) AS x FROM tm GROUP BY case_id),
l AS (
  SELECT 'low_semantic' AS list, case_id, semantic AS x FROM good UNION ALL SELECT 'high_copy', case_id, -copy FROM good
  UNION ALL SELECT 'low_diversity', case_id, -similarity FROM sim UNION ALL SELECT 'noise', case_id, x FROM nz
  UNION ALL SELECT 'hacks', case_id, 0.0 FROM good WHERE lex > 1.0 AND semantic < 0.75)
SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY x, case_id) AS INTEGER) AS rank, case_id FROM l QUALIFY rank <= 5
"""
ORACLES["autotune_settings"] = LOG + """
, g AS (
  SELECT CAST(row_number() OVER (ORDER BY a, b, c, e) - 1 AS INTEGER) AS setting, a AS min_sem, b AS lex_weight, c AS copy_weight, e AS lex_clamp
  FROM unnest([0.70::DOUBLE, 0.75, 0.80, 0.85]) x(a), unnest([0.0::DOUBLE, 0.1, 0.25, 0.5]) y(b), unnest([0.0::DOUBLE, 0.1, 0.25]) z(c), unnest([0.5::DOUBLE, 1.0, 2.0]) w(e)
), s AS (
  SELECT g.*, c.case_id, c.cand, c.domain, c.semantic, c.lex, c.copy, leak, c.semantic >= min_sem AS fine,
    CASE WHEN c.semantic >= min_sem THEN c.domain + lex_weight * least(c.lex, lex_clamp) - copy_weight * c.copy - c.penalty ELSE c.semantic END AS score
  FROM cand c JOIN good USING (case_id) JOIN leaky ON leaky.case_id = c.case_id AND leaky.cand = c.cand, g
), p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY setting, case_id ORDER BY fine DESC, score DESC, cand) = 1),
m AS (
  SELECT setting, min_sem, lex_weight, copy_weight, lex_clamp, avg(domain) AS domain, avg(semantic) AS semantic, avg(lex) AS lex, avg(copy) AS copy, avg(leak::INT::DOUBLE) AS leaks,
    avg((lex > 1.0 AND semantic < 0.75)::INT::DOUBLE) AS hacks, avg((NOT fine)::INT::DOUBLE) AS fallbacks FROM p GROUP BY ALL
), b AS (
  SELECT avg(domain) - 1.6 * avg((lex > 1.0 AND semantic < 0.75)::INT::DOUBLE) - 1.1 * avg(leak::INT::DOUBLE) - 0.2 * avg(copy) AS baseline
  FROM good JOIN leaky ON leaky.case_id = good.case_id AND leaky.cand = 0
), o AS (SELECT m.*, domain - 1.6 * hacks - 1.1 * leaks - 0.8 * fallbacks - 0.2 * copy AS objective, baseline FROM m, b)
SELECT setting, round(min_sem, 6) AS min_sem, round(lex_weight, 6) AS lex_weight, round(copy_weight, 6) AS copy_weight, round(lex_clamp, 6) AS lex_clamp,
  round(domain, 6) AS domain, round(semantic, 6) AS semantic, round(lex, 6) AS lex, round(copy, 6) AS copy, round(leaks, 6) AS leaks, round(hacks, 6) AS hacks,
  round(fallbacks, 6) AS fallbacks, round(objective, 6) AS objective, round(baseline, 6) AS baseline,
  objective > baseline AND row_number() OVER (ORDER BY round(objective, 9) DESC, setting) = 1 AS is_best
FROM o
"""
ORACLES["best_texts"] = LOG + """
, b AS (SELECT case_id, text, max(domain) AS score FROM cand GROUP BY case_id, text)
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, text) AS INTEGER) AS rank, text, score FROM b QUALIFY rank <= 2
"""
ORACLES["connector_diagnosis"] = r"""
WITH p AS (SELECT lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, coalesce(html, '') AS html FROM pages), t AS (SELECT host, html, trim(regexp_replace(html, '\s+', ' ', 'g')) AS b FROM p),
r AS (SELECT host, trim(html) = '' AS empty, lower(CASE WHEN length(b) > 300 THEN substr(b, 1, 300) || '...' ELSE b END) AS l FROM t),
w AS (SELECT *, regexp_matches(l, 'attention required|cloudflare|captcha|challenge') AS waf FROM r),
g AS (SELECT host, bool_or(NOT empty) AS ok, bool_or(empty) AS forbidden, false AS unauthorized, bool_or(waf) AS waf, bool_or(NOT waf AND regexp_matches(l, 'unauthorized|forbidden|login|authentication')) AS asks_login FROM w GROUP BY host)
SELECT *, CASE WHEN forbidden AND waf THEN 'Likely WAF block' WHEN asks_login THEN 'Likely needs auth' WHEN forbidden AND NOT ok THEN 'Likely platform-side block or API access policy'
  ELSE 'Endpoint reachable; likely client header/flow issue in failing mode' END AS conclusion FROM g
"""
_WORDS = "SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS term FROM benchmark) WHERE term <> ''"
_NORM = "regexp_replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), '[^a-z0-9\\-_/ ]+', '', 'g')"
_LONG = "CASE {0} WHEN 'dft' THEN 'density functional theory' WHEN 'pde' THEN 'partial differential equation' WHEN 'ode' THEN 'ordinary differential equation' WHEN 'gnn' THEN 'graph neural network' WHEN 'ml' THEN 'machine learning' ELSE {0} END"
_STOP = "['a', 'an', 'and', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'of', 'on', 'or', 'that', 'the', 'to', 'under', 'with', 'we', 'our']"
_NOISY = "('model', 'predict', 'prediction', 'steps', 'reduces', 'method', 'methods', 'result', 'results', 'study', 'approach', 'propose', 'show', 'data', 'system')"
_NOISE = "(len({0}) = 0 OR contains({1}, 'updatedgpt') OR contains({1}, 'native=') OR contains({1}, 'domain-specific concept') OR len(list_filter({0}, lambda x: NOT list_contains(" + _STOP + ", x))) = 0 OR len({0}) = 1 AND {0}[1] IN " + _NOISY + ")"
ORACLES["term_normalized"] = "WITH t AS (" + _WORDS + "), m AS (SELECT term, " + _NORM.format("term") + " AS raw FROM t), k AS (SELECT term, " + _LONG.format("raw") + """ AS normal FROM m),
s AS (SELECT *, list_filter(string_split(normal, ' '), lambda x: x <> '') AS w FROM k)
SELECT term, normal, """ + _NOISE.format("w", "normal") + " AS noise FROM s"
_BI = "lx AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS neighbor FROM bw)"
_TRI = "tr AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM bw)"
_ANCH = "('energy', 'diffusion', 'entropy', 'rate', 'stability', 'transport', 'barrier', 'functional', 'reaction', 'graph', 'constraint')"
ORACLES["concept_neighbors"] = "WITH bw AS (SELECT " + _TOK.format("text") + " AS w FROM benchmark), " + _BI + ", " + _TRI + """,
a AS (SELECT term, len(s) AS na, unnest(s) AS tok FROM (SELECT term, list_distinct(""" + _TOK.format("term") + """) AS s FROM tr)),
b AS (SELECT neighbor, len(s) AS nb, unnest(s) AS tok FROM (SELECT neighbor, list_distinct(""" + _TOK.format("neighbor") + """) AS s FROM lx)),
m AS (SELECT term, neighbor, na, nb, count(*) AS o, bool_or(tok IN """ + _ANCH + """) AS anchor FROM a JOIN b USING (tok) GROUP BY ALL),
r AS (SELECT term, neighbor, round(o / (na + nb - o)::DOUBLE + CASE WHEN anchor THEN 0.15 ELSE 0.0 END, 9) AS score FROM m),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, neighbor) = 1)
SELECT tr.term, CASE WHEN score >= 0.25 THEN neighbor END AS neighbor, CASE WHEN score >= 0.25 THEN round(least(1.0, score), 6) ELSE 0.0 END AS score FROM tr LEFT JOIN best USING (term)
"""
ORACLES["policy_verdicts"] = """
WITH t AS (SELECT lower(concat_ws(' ', text, CASE (conv_id + turn) % 4 WHEN 0 THEN 'It is Identical to that' WHEN 1 THEN 'This is analogous' WHEN 2 THEN 'It is conceptually similar' END)) AS t FROM conversations)
SELECT CASE WHEN contains(t, 'equivalent to') OR contains(t, 'identical to') OR contains(t, 'is the same as') THEN 'banned_phrase'
  WHEN NOT (contains(t, 'analogous') OR contains(t, 'conceptually similar') OR contains(t, 'shares structural similarity')) THEN 'no_analogy' ELSE 'ok' END AS verdict, count(*) AS n
FROM t GROUP BY 1
"""
ORACLES["leak_counts"] = """
WITH m AS (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN text || ' (native = 0.00) updatedgpt_noself_v2 [ updatedgpt x ]' ELSE text END AS t FROM documents)
SELECT lang, count(*) FILTER (WHERE regexp_matches(t, '(?i)\\(domain-specific concept\\)|\\(native=|\\[updatedgpt|native=0\\.00')) AS leaks,
  count(*) FILTER (WHERE regexp_matches(t, '(?i)updatedgpt|run\\d{2,}|noself|debug')) AS debug, count(*) AS n FROM m GROUP BY lang
"""
ORACLES["request_texts"] = """
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, md5(substr(t, 1, 300)) AS body_md5, length(substr(t, 1, 128)) AS n FROM t
"""
ORACLES["fallback_texts"] = """
WITH t AS (SELECT conv_id, turn, text, (['CSM', 'PM', 'CHEM', 'CHEME', 'CCE', 'BIO'])[conv_id % 6 + 1] AS tgt FROM conversations)
SELECT conv_id, turn, tgt, md5(CASE tgt WHEN 'CSM' THEN 'From a computational modeling perspective, ' WHEN 'PM' THEN 'From a physics-oriented interpretation, ' WHEN 'CHEM' THEN 'From a chemistry perspective, '
  WHEN 'CHEME' THEN 'From a chemical engineering standpoint, ' WHEN 'CCE' THEN 'From a process-engineering standpoint, ' ELSE 'In ' || tgt || ' terms, ' END
  || CASE WHEN length(text) > 1 THEN lower(substr(text, 1, 1)) || substr(text, 2) ELSE text END) AS text_md5 FROM t
"""
ORACLES["fallback_reasons"] = """
WITH r AS (SELECT user_id, (['other', 'filter_empty', 'api_error', 'timeout', 'no_key'])[event_id % 5 + 1] AS r FROM events WHERE value > 60)
SELECT user_id, arg_min(r, list_position(['no_key', 'timeout', 'api_error', 'filter_empty', 'other'], r)) AS reason FROM r GROUP BY user_id
"""
ORACLES["provider_errors"] = r"""
WITH t AS (SELECT trim(regexp_replace(html, '\s+', ' ', 'g')) AS b FROM pages), v AS (SELECT CASE WHEN length(b) > 300 THEN substr(b, 1, 300) || '...' ELSE b END AS t FROM t)
SELECT CASE WHEN contains(t, '429') OR contains(t, 'RESOURCE_EXHAUSTED') THEN 'api_error' WHEN regexp_matches(lower(t), 'timeout|timed out') THEN 'timeout' ELSE 'other' END AS kind,
  CASE WHEN regexp_matches(lower(t), 'api_key|not configured') THEN 'no_key' ELSE 'api_error' END AS not_set_up, count(*) AS n FROM v GROUP BY ALL
"""
ORACLES["keyphrase_filter"] = "WITH b AS (SELECT item_id, " + _TOK.format("text") + """ AS w FROM benchmark), t AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM b),
k AS (SELECT *, regexp_extract_all(term, '[a-z][a-z0-9\\-_/()]*') AS k FROM t)
SELECT item_id, term, length(trim(term)) >= 3 AND NOT (""" + " OR ".join(f"contains(term, '{x}')" for x in config.DEBUG_TERMS) + ") AND len(list_filter(k, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in config.ANNOTATION_ACADEMIC + config.DOMAIN_GENERIC + config.DEBUG_TERMS) + "))) > 0 AND len(list_filter(k, lambda x: x IN (" + ", ".join(f"'{w}'" for w in config.VERB_LIKE + config.CONNECTORS) + "))) = 0 AS ok FROM k"
ORACLES["source_row_fields"] = """
WITH t AS (
  SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN ['Physical Chemistry', 'Catalysis'] WHEN 1 THEN ['Process Control', 'Energy'] ELSE [] END AS c FROM pages
), j AS (SELECT *, coalesce(array_to_string(c, '|'), '') AS cats FROM t)
SELECT page_id, CASE WHEN page_id % 2 = 0 OR url IS NULL OR url = '' THEN 'page-' || CAST(page_id AS VARCHAR) ELSE url END AS id, cats AS categories, contains(lower(cats), 'catalysis') AS catalysis,
  CASE WHEN page_id % 3 IN (0, 1) OR (page_id % 7 >= page_id % 10 AND page_id % 7 > 0) THEN 'CHEME' ELSE 'CHEM' END AS domain, regexp_replace(cats, '[^A-Za-z0-9_\\-]', '_', 'g') AS file FROM j
"""
ORACLES["boolean_flags"] = """
WITH t AS (SELECT (['1', ' True ', 'yes', 'Y', 'on', 'off', '0', ''])[event_id % 8 + 1] AS value FROM events)
SELECT value, count(*) FILTER (WHERE lower(trim(value)) IN ('1', 'true', 'yes', 'y', 'on')) AS n_true, count(*) AS n FROM t GROUP BY value
"""
ORACLES["probability_split"] = """
WITH e AS (SELECT event_id, greatest(0.0::DOUBLE, (event_id % 9) / 10::DOUBLE - 0.1::DOUBLE) AS j, (event_id % 5) / 10::DOUBLE AS o, CASE event_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.45 END AS s FROM events),
p AS (SELECT event_id, o AS a, j * s AS b, j * (1 - s) AS c FROM e)
SELECT event_id, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 1 / 3::DOUBLE END, 6) AS csm, round(CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 1 / 3::DOUBLE END, 6) AS chem,
  round(CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 1 / 3::DOUBLE END, 6) AS cheme FROM p
"""
ORACLES["lexicon_coverage"] = "WITH lx AS (SELECT DISTINCT lower(term) AS w FROM (" + _WORDS + ") WHERE length(lower(term)) >= 9), d AS (SELECT doc_id, unnest(list_distinct(" + _TOK.format("text") + """)) AS w FROM documents),
h AS (SELECT doc_id, count(*) AS hits FROM d JOIN lx USING (w) GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(hits, 0) / greatest((SELECT count(*) FROM lx), 1)::DOUBLE, 6) AS coverage FROM documents d LEFT JOIN h USING (doc_id)
"""
ORACLES["action_slots"] = """
WITH k AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS k FROM conversations GROUP BY 1), s AS (SELECT conv_id, k, CAST(unnest(range(0, k)) AS INTEGER) AS slot FROM k)
SELECT conv_id, k, slot, (['literal', 'domain_steered', 'process_framing', 'educator'])[least(slot + 1, 4)] AS action FROM s
"""
ORACLES["stoplist_union"] = "SELECT unnest(" + _TOK.format("text") + ") AS term FROM benchmark UNION SELECT unnest(" + _TOK.format("text") + ") FROM conversations UNION SELECT unnest([" + ", ".join(f"'{w}'" for w in config.ACADEMIC + config.DOMAIN_GENERIC + config.GENERIC_SCIENCE) + "])"
ORACLES["case_grid"] = """
WITH d AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) SELECT a.lang AS src, b.lang AS tgt, item_id FROM d a, d b, benchmark WHERE a.lang <> b.lang
"""
ORACLES["backward_slices"] = """
WITH e AS (SELECT CAST(ts AS DATE) AS day FROM events), s AS (SELECT max(day) AS last, min(day) AS first FROM e),
g AS (SELECT last, CAST(unnest(range(0, (last - first) // 7 + 1)) AS INTEGER) AS slice FROM s),
p AS (SELECT CAST((last - day) // 7 AS INTEGER) AS slice, count(*) AS n FROM e, s GROUP BY 1)
SELECT g.slice, strftime(last - 7 * g.slice - 6, '%Y-%m-%d') AS "begin", strftime(last - 7 * g.slice, '%Y-%m-%d') AS "end", coalesce(n, 0) AS n FROM g LEFT JOIN p USING (slice)
"""
ORACLES["tfidf_features"] = r"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]{2,}')) AS w, unnest(range(len(regexp_extract_all(t, '[\p{L}\p{N}_]{2,}')))) AS i FROM d),
b AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM w),
g AS (
  SELECT doc_id, 'w' AS kind, w AS f FROM w
  UNION ALL
  SELECT doc_id, 'w', w || ' ' || y FROM b WHERE y IS NOT NULL
  UNION ALL
  SELECT doc_id, 'c', unnest(list_concat(
    list_transform(range(1, greatest(length(p) - 1, 2)), lambda i: p[i:i + 2]),
    CASE WHEN length(p) > 3 THEN list_transform(range(1, length(p) - 2), lambda i: p[i:i + 3]) ELSE [] END,
    CASE WHEN length(p) > 4 THEN list_transform(range(1, length(p) - 3), lambda i: p[i:i + 4]) ELSE [] END))
  FROM (SELECT doc_id, ' ' || unnest(string_split_regex(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) || ' ' AS p FROM d WHERE trim(t) <> '')
), tf AS (SELECT doc_id, kind, f, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT count(*) AS n FROM d),
v AS (SELECT kind, f, ln((1.0::DOUBLE + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY kind, f HAVING count(*) >= 3 AND (kind = 'c' OR count(*) <= 0.7::DOUBLE * any_value(n))),
x AS (SELECT doc_id, kind, (1 + ln(tf)) * idf AS x FROM tf JOIN v USING (kind, f))
SELECT doc_id, kind, count(*) AS n, round(sum(x) / sqrt(sum(x * x)), 6) AS total, round(max(x) / sqrt(sum(x * x)), 6) AS largest FROM x GROUP BY ALL
"""
_SECTIONS = "WITH " + _GRID + """, k AS (SELECT domain, term, z, round(combined, 6) AS combined, len(string_split(term, ' ')) AS n, """ + _TOPIC + """ AS topic FROM m6),
sec AS (
  SELECT domain, 'style' AS section, term, row_number() OVER (PARTITION BY domain ORDER BY n DESC, z DESC, term) AS rank FROM k WHERE NOT topic
  UNION ALL SELECT domain, 'topic', term, row_number() OVER (PARTITION BY domain ORDER BY combined DESC, term) FROM k WHERE topic
  UNION ALL SELECT domain, CASE n WHEN 2 THEN 'bigrams' ELSE 'trigrams' END, term, row_number() OVER (PARTITION BY domain, n ORDER BY z DESC, term) FROM k WHERE NOT topic AND n IN (2, 3)
), lx AS (SELECT domain, section, CAST(rank AS INTEGER) AS rank, term FROM sec WHERE rank <= 300)
"""
ORACLES["lexicon_sections"] = _SECTIONS + "SELECT * FROM lx"
ORACLES["artifact_gates"] = _SECTIONS + """, t AS (
  SELECT DISTINCT domain, term FROM (SELECT domain, term, row_number() OVER (PARTITION BY domain ORDER BY list_position(['style', 'bigrams', 'trigrams'], section), rank, term) AS k FROM lx WHERE section <> 'topic') WHERE k <= 200
), doms AS (SELECT DISTINCT domain FROM t), p AS (SELECT a.domain AS a, b.domain AS b FROM doms a JOIN doms b ON a.domain < b.domain),
o AS (SELECT a, b, (SELECT count(*) FROM t x JOIN t y ON x.term = y.term WHERE x.domain = a AND y.domain = b) / (SELECT count(DISTINCT term) FROM t WHERE domain IN (a, b))::DOUBLE AS v FROM p),
n AS (SELECT domain, count(*) FILTER (WHERE section = 'style') AS n FROM lx GROUP BY 1),
w AS (SELECT domain, count(*) FILTER (WHERE term IN (""" + ", ".join(f"'{x}'" for x in config.BANNED_TERMS) + """)) AS n FROM t GROUP BY 1),
g AS (SELECT count(*) AS n FROM m6 WHERE regexp_matches(term, '(?i)updatedgpt|native=|domain-specific concept'))
SELECT 'banned' AS gate, domain AS subject, n::DOUBLE AS value, 0::DOUBLE AS "limit", n = 0 AS passed FROM w
UNION ALL SELECT 'style', domain, n, 30, n >= 30 FROM n
UNION ALL SELECT 'overlap', a || '-' || b, round(v, 6), 0.25, v <= 0.25 FROM o
UNION ALL SELECT 'debug_rows', '', n, 0, n = 0 FROM g
"""
ORACLES["evidence_lookups"] = r"""
WITH x AS (SELECT lang, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS word, doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND NOT regexp_matches(text, '[#$%&*|]')),
r AS (SELECT lang, word, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY doc_id) <= 2) GROUP BY ALL),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
SELECT l.lang, w.word, coalesce(ids, '') AS doc_ids, CAST(coalesce(n, 0) AS INTEGER) AS n FROM w CROSS JOIN l LEFT JOIN r ON r.lang = l.lang AND r.word = w.word
"""
ORACLES["detection_scores"] = "WITH s AS (" + _BASE["source_ambiguity"] + """), j AS (SELECT d.lang AS label, s.domain AS guess FROM s JOIN documents d ON d.doc_id = s.doc_id),
l AS (SELECT DISTINCT label FROM (SELECT label FROM j UNION ALL SELECT guess FROM j)),
c AS (SELECT l.label, (SELECT count(*) FROM j WHERE j.label IS NOT DISTINCT FROM l.label) AS n, (SELECT count(*) FROM j WHERE guess IS NOT DISTINCT FROM l.label) AS said, (SELECT count(*) FROM j WHERE j.label = l.label AND guess = l.label) AS tp FROM l),
f AS (SELECT *, CASE WHEN said > 0 THEN tp / said::DOUBLE ELSE 0 END AS p, CASE WHEN n > 0 THEN tp / n::DOUBLE ELSE 0 END AS r FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(tp) / sum(n)::DOUBLE, 6) AS accuracy, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1 FROM f
"""
