"""DuckDB SQL for the results of the queries that SQL can express."""

op10_exact_dedup = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

op7_decontamination = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM bw), keys AS (SELECT DISTINCT n, g FROM bw),
starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n
), found AS (
  SELECT s.r, s.k, s.n, s.g FROM (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM starts) s SEMI JOIN keys USING (n, g)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, n, g FROM found) JOIN bw USING (n, g) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

op5_line_dedup = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS l FROM documents),
o AS (SELECT r, doc_id, source, trim(l[k]) AS line, k FROM (SELECT r, doc_id, source, l, unnest(range(1, len(l) + 1)) AS k FROM d) WHERE trim(l[k]) <> ''),
b AS (SELECT line, min(doc_id) AS stays FROM o GROUP BY line HAVING count(DISTINCT source) >= 10),
f AS (SELECT line, stays, min(k) AS stays_k FROM o JOIN b USING (line) WHERE o.doc_id = b.stays GROUP BY line, stays),
g AS (SELECT r, list(k) AS gone, count(*) AS n FROM o JOIN f USING (line) WHERE NOT (o.doc_id = f.stays AND o.k = f.stays_k) GROUP BY r),
c AS (
  SELECT doc_id, len(l) AS n_lines, coalesce(n, 0) AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda k: NOT list_contains(gone, k)), lambda k: l[k]), chr(10)) END AS clean
  FROM d LEFT JOIN g USING (r)
)
SELECT doc_id, n_lines, n_removed, length(clean) AS n_chars_kept, sha256(clean) AS text_sha256 FROM c
"""

op2_url_filter = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), best AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN best USING (r)
"""

op12_source_divergence = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(DISTINCT term) AS v, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang),
g AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // (g.total + l.v) AS p
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (SELECT c.lang, c.term, 1 + (1000000000 * CAST(sum(c.n) + 1 AS HUGEINT)) // (any_value(l.total) + any_value(l.v)) AS q FROM c JOIN l USING (lang) GROUP BY c.lang, c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _places(kind: str, k: int, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT r, '{kind}' AS kind, {k} AS k, s, s + length(m) AS e, m FROM (
    SELECT r, w[i] AS m, o[i] AS own, CAST(list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS o FROM d))
  ) WHERE length(own) >= {least}"""


_assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_characters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

op11_secret_scan = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_places("assign", 0, _assign, 2, 6)} UNION ALL {_places("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_places("hex", 2, "[0-9a-f]+", 0, 24)}),
runs AS ({_places("random", 3, "[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20)}),
chosen AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 300),
cut AS (SELECT regexp_replace(regexp_replace(regexp_replace(text, '{_assign}', ' ', 'g'), 'AKIA[A-Z0-9]+', ' ', 'g'), '[0-9a-f]{{24,}}', ' ', 'g') AS t FROM documents SEMI JOIN chosen USING (doc_id)),
words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9]+')) AS w FROM cut) WHERE length(w) < 20),
named AS (SELECT w, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS n FROM words),
digest AS (SELECT id, to_base64(unhex(sha256('random ' || CAST(id AS VARCHAR)))) AS b FROM range(6000) x(id)),
samples AS (
  SELECT false AS random, unnest([w, upper(w), w || n || n, '_' || w || '_', '-' || w || '-', '/' || w || '/', '+' || w || '+', '=' || w || '=']) AS x FROM named
  UNION ALL SELECT false, repeat(c, 1000) FROM (SELECT unnest(['_', '-', '/', '+', '=']) AS c) WHERE (SELECT count(*) FROM words) > 0
  UNION ALL SELECT true, CASE id % 3 WHEN 0 THEN b WHEN 1 THEN regexp_replace(b, '[^A-Za-z0-9]', '', 'g') ELSE upper(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) END FROM digest
), seen AS (SELECT random, substr(x, i, 1) AS a, substr(x, i + 1, 1) AS b, count(*) AS n FROM (SELECT random, x, unnest(range(1, length(x))) AS i FROM samples) GROUP BY ALL),
letters AS (SELECT unnest(string_split('{_characters}', '')) AS c),
filled AS (
  SELECT r.random, x.c AS a, y.c AS b, coalesce(n, 0) + 1 AS n FROM (SELECT unnest([true, false]) AS random) r, letters x, letters y LEFT JOIN seen s ON s.random = r.random AND s.a = x.c AND s.b = y.c
), likely AS (SELECT random, a, b, n / sum(n) OVER (PARTITION BY random, a) AS p FROM filled),
model AS (SELECT x.a || x.b AS pair, CAST(round(1000 * ln(x.p / y.p)) AS BIGINT) AS ratio FROM likely x JOIN likely y USING (a, b) WHERE x.random AND NOT y.random AND (SELECT count(*) FROM words) > 0),
scored AS (SELECT m, sum(ratio) AS score FROM (SELECT m, substr(m, i, 2) AS pair FROM (SELECT m, unnest(range(1, length(m))) AS i FROM (SELECT DISTINCT m FROM runs))) JOIN model USING (pair) GROUP BY m),
likeliest AS (
  SELECT * FROM runs SEMI JOIN (SELECT m FROM scored WHERE score >= 10000 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')) USING (m)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = runs.r AND b.s <= runs.s AND runs.e <= b.e)
),
listed AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM likeliest) GROUP BY r),
of_base AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS b, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex FROM base GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN of_base USING (r) LEFT JOIN listed USING (r)
"""
