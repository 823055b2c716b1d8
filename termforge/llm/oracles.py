"""The queries that SQL can express, for DuckDB."""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n
), hit AS (
  SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN win ON win.n = dw.n AND array_to_string(dw.w[i:i + dw.n - 1], ' ') = win.s
), pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, pos, line, list_filter(regexp_split_to_array(lower(line), '[ \t\r\f\v]+'), lambda x: x <> '') AS w FROM l
), s AS (
  SELECT doc_id, pos, line, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w
), k AS (
  SELECT *, CASE WHEN len(g) > 0 THEN row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) ELSE 1 END AS nth FROM s
), t AS (SELECT doc_id, pos, len(g) AS n, unnest(g) AS g FROM k WHERE nth = 1),
alike AS (
  SELECT DISTINCT doc_id, pos FROM (
    SELECT a.doc_id, a.pos FROM t a JOIN t b ON a.g = b.g AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)
    GROUP BY a.doc_id, a.pos, b.doc_id, b.pos, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*)))
), bad AS (SELECT g FROM k JOIN alike USING (doc_id, pos)),
gone AS (SELECT doc_id, pos, line, nth > 1 OR len(g) > 0 AND g IN (SELECT g FROM bad) AS gone FROM k),
out AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM gone GROUP BY doc_id
)
SELECT d.doc_id, out.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN out USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sh),
t AS (SELECT doc_id, unnest(s) AS g FROM sh),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
SELECT n.doc_id, n.n AS n_shingles, m.component_id
FROM n JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = n.doc_id
"""

_URL = {
    "rest": "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END",
}
_ATTR = r"""\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
OP8 = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, split_part({_URL["rest"]}, '#', 1) AS rest FROM pages
), p AS (
  SELECT page_id, url, html, {_ASCII.format("regexp_extract(coalesce(rest, ''), '^([^/?]*)', 1)")} AS host,
         coalesce(regexp_extract(split_part(rest, '?', 1), '(/.*)$', 1, 's'), '') AS path,
         coalesce(regexp_extract(rest, '(\?.*)$', 1, 's'), '') AS query
  FROM u
), rules(h, r, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), tags AS (
  SELECT url AS src, split_part(url, '://', 1) AS scheme, host, path, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE instr(url, '://') > 0
), attr AS (
  SELECT *, """ + ", ".join(f"""concat(regexp_extract(tag, '(?is)\\b{name}{_ATTR}', 1), regexp_extract(tag, '(?is)\\b{name}{_ATTR}', 2), regexp_extract(tag, '(?is)\\b{name}{_ATTR}', 3)) AS a_{alias}""" for name, alias in (("rel", "rel"), ("href", "href"), ("http-equiv", "equiv"), ("content", "content"))) + rf""" FROM tags
), aim AS (
  SELECT src, scheme, host, path, regexp_replace(path, '[^/]*$', '') AS folder,
         trim(replace(CASE WHEN list_contains(regexp_split_to_array(lower(a_rel), '\s+'), 'canonical') THEN a_href
                           WHEN lower(a_equiv) = 'refresh' THEN regexp_extract(a_content, '(?is)url\s*=\s*[''"]?([^''"]+)', 1) END, '&amp;', '&')) AS aim FROM attr
), node AS (
  SELECT src, CASE WHEN regexp_matches(aim, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN aim WHEN starts_with(aim, '//') THEN scheme || ':' || aim WHEN starts_with(aim, '/') THEN scheme || '://' || host || aim
         WHEN substr(aim, 1, 1) IN ('?', '#') THEN scheme || '://' || host || path || aim ELSE scheme || '://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || aim END AS dst
  FROM aim WHERE aim <> ''
), addr AS (
  SELECT DISTINCT x AS url, {_ASCII.format("regexp_extract(split_part(substr(x, instr(x, '://') + 3), '#', 1), '^([^/?]*)', 1)")} AS host,
         regexp_replace(regexp_extract(split_part(substr(x, instr(x, '://') + 3), '#', 1), '^[^/?]*(.*)$', 1, 's'), '^(\?|$)', '/\1') AS tail
  FROM (SELECT src AS x FROM node UNION SELECT dst FROM node)
), step AS (SELECT a.host || a.tail AS x, b.host || b.tail AS y FROM node JOIN addr a ON a.url = node.src JOIN addr b ON b.url = node.dst),
edge AS (SELECT x, y FROM step UNION SELECT y, x FROM step),
bad AS (
  SELECT DISTINCT host || tail AS x FROM (
    SELECT host, tail, arg_max(v, length(h || r)) AS v FROM addr JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(split_part(tail, '?', 1), r) GROUP BY host, tail)
  WHERE v = 'block'
), spread AS (SELECT x FROM bad UNION SELECT edge.y FROM spread JOIN edge ON edge.x = spread.x),
best AS (
  SELECT page_id, url, arg_max(h || r, length(h || r)) AS rule, arg_max(v, length(h || r)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r) GROUP BY page_id, url
)
SELECT p.page_id, p.host, p.path, best.rule,
       coalesce(best.v, CASE WHEN p.host || CASE WHEN p.path = '' THEN '/' ELSE p.path END || p.query IN (SELECT x FROM spread) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.page_id = p.page_id AND best.url = p.url
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d
), r AS (
  SELECT doc_id, x, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), c AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM r
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM c
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT doc_id, part, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+', 0, 's') AS w, min(doc_id) OVER (PARTITION BY x) AS first_id FROM d
), f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(x, '[^A-Z]', '', 'gs')) > 2 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d, coalesce(first_id < doc_id, false) AS e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id AS l, max(quality) FILTER (WHERE quality = 1) AS quality, max(toxic) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY doc_id) ON l = doc_id
), n AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), fails AS (
  SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS which FROM n
), steps AS (
  SELECT part, filter_order, unnest(range(1, 6)) AS step, which, n, good, toxic,
         CASE WHEN which = '' THEN 6 ELSE list_min(list_transform(string_split(which, ''), lambda y: instr(filter_order, y))) END AS gone FROM fails, o
), marked AS (
  SELECT *, contains(which, filter_order[step]) AS hit FROM steps
), report AS (
  SELECT part, filter_order, step, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN which = filter_order[step] THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM marked GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM report
"""

ORACLES = {"op3_topk_search": OP3, "op5_decontamination": OP5, "op6_line_dedup": OP6, "op7_ngram_join": OP7, "op8_url_filter": OP8, "op12_fill_in_middle": OP12, "op13_filter_audit": OP13}
