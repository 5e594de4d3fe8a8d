"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from folioscope.operators.search import EXCERPT_CHARS

from .changes import CIRCLES, GAPS, RULES, rules_sql
from .projection import markdown_sql, raw_sql


RAW = f"raw AS ({raw_sql()})"
MD = f"md AS ({markdown_sql('n', '(SELECT d.*, c.n FROM documents d CROSS JOIN (SELECT count(*) AS n FROM documents) c)')})"
AREA = "CASE WHEN path LIKE 'notes/%' THEN 'notes' WHEN path LIKE 'ideas/%' THEN 'ideas' WHEN path LIKE 'projects/%' THEN 'projects' WHEN path LIKE 'sdd/%' THEN 'sdd' END"
RANK = f"coalesce(list_position(['notes', 'ideas', 'projects', 'sdd'], {AREA}) - 1, 4)"
LINES = "(CASE WHEN ends_with(text, chr(10)) THEN list_resize(regexp_split_to_array(text, '\\r?\\n'), len(regexp_split_to_array(text, '\\r?\\n')) - 1) ELSE regexp_split_to_array(text, '\\r?\\n') END)"


def hits(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def ranked(where: str, phrase: str, tokens: str, tail: str = "") -> str:
    return f"WITH {RAW} SELECT path, CAST({RANK} AS INTEGER) AS area_rank, CAST({phrase} AS BIGINT) AS phrase_hits, CAST({tokens} AS BIGINT) AS token_hits FROM raw WHERE {where} {tail}"


LINK_ROWS = f"""{MD}, clean AS (SELECT doc_id, path, regexp_replace(text, '```[^`]*```', '', 'g') AS t FROM md),
m AS (SELECT doc_id, path, regexp_extract_all(t, '\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]', 1) AS a, regexp_extract_all(t, '\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]', 2) AS b FROM clean),
links AS (SELECT doc_id, path, k - 1 AS ordinal, a[k] AS target_path, nullif(b[k], '') AS link_text FROM (SELECT *, unnest(range(1, len(a) + 1)) AS k FROM m))"""
EDGES = f"""{LINK_ROWS}, nodes AS (SELECT regexp_replace(path, '\\.md$', '') AS name FROM md),
edges AS (SELECT regexp_replace(path, '\\.md$', '') AS source, split_part(target_path, '#', 1) AS target, link_text, EXISTS (SELECT 1 FROM nodes WHERE name = split_part(target_path, '#', 1)) AS resolved FROM links)"""
# the planted entities of each page, all in its last section
ENTITIES = f"""{MD}, found AS (
  SELECT 'doc:' || path AS document_id, len(string_split(regexp_extract(text, '(?s)^(.*)fn handler_', 1), chr(10))) AS start_line, unnest([
    {{'k': 'function', 'n': regexp_extract(text, 'fn (handler_[0-9]+)', 1), 'x': 'rule:rust-function', 'c': 0.95}}, {{'k': 'identifier', 'n': regexp_extract(text, '`(Svc_[0-9]+)`', 1), 'x': 'rule:inline-identifier', 'c': 0.72}},
    {{'k': 'config', 'n': regexp_extract(text, '`(cfg.key_[0-9]+)`', 1), 'x': 'rule:inline-config', 'c': 0.8}}, {{'k': 'path', 'n': regexp_extract(text, 'in (src/m_[0-9]+.rs)', 1), 'x': 'rule:path', 'c': 0.9}}]) AS e FROM md
), ment AS (SELECT document_id, start_line, e.k AS entity_type, e.n AS canonical_name, e.x AS extractor, CAST(e.c AS DOUBLE) AS confidence, 'entity:' || sha256(e.k || ':' || e.n) AS id FROM found)"""
PAIRS = f"""{ENTITIES}, pairs AS (SELECT a.document_id, a.start_line, a.id AS subject_entity_id, b.id AS object_entity_id, least(a.confidence, b.confidence) AS confidence,
  'relation:' || sha256(a.id || ':co_occurs_in_chunk:' || b.id) AS relation_id FROM ment a JOIN ment b ON a.document_id = b.document_id AND a.id < b.id)"""
POSTS = f"""{RAW}, toks AS (SELECT 'doc:' || path AS chunk_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM raw),
posts AS (SELECT chunk_id, t[k] AS term, k - 1 AS pos FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM toks)), lens AS (SELECT chunk_id, count(*) AS len FROM posts GROUP BY 1), facts AS (SELECT count(*) AS total, avg(len) AS mean FROM lens)"""


def bm25(words: list[list[str]]) -> str:
    """The CTEs f0, f1 ... of phrase counts, and the score."""
    ctes, score = [], []
    for k, w in enumerate(words):
        joins = " ".join(f"JOIN posts p{j} ON p{j}.chunk_id = p0.chunk_id AND p{j}.pos = p0.pos + {j} AND p{j}.term = '{x}'" for j, x in enumerate(w) if j)
        ctes.append(f"f{k} AS (SELECT p0.chunk_id, count(*) AS f FROM posts p0 {joins} WHERE p0.term = '{w[0]}' GROUP BY 1)")
        n = f"(SELECT count(*) FROM f{k})"
        score.append(f"greatest(ln((total - {n} + 0.5) / ({n} + 0.5)), 1e-6) * f{k}.f * 2.2 / (f{k}.f + 1.2 * (0.25 + 0.75 * len / mean))")
    joins = " ".join(f"JOIN f{k} USING (chunk_id)" for k in range(1, len(words)))
    return f"{', '.join(ctes)}, scored AS (SELECT f0.chunk_id, -({' + '.join(score)}) AS bm25 FROM f0 {joins} JOIN lens USING (chunk_id) CROSS JOIN facts)"


SIGNALS = f"""{RAW}, sig AS (
  SELECT 'doc:' || path AS chunk_id, 'word: idiot' AS reason, 'lexical' AS kind, 0.82::DOUBLE AS boost FROM raw WHERE contains(text, 'idiot')
  UNION SELECT 'doc:' || path, 'word: scum', 'lexical', 0.7 FROM raw WHERE contains(text, 'scum')
  UNION SELECT 'doc:' || path, 'area: ' || coalesce({AREA}, 'none'), 'graph', 0.36 FROM raw
  UNION SELECT 'doc:' || path, 'long', 'graph', 0.28 FROM raw WHERE length(text) > 1000
), fused AS (SELECT chunk_id, coalesce(max(boost) FILTER (kind = 'lexical'), 0) AS lex, least(0.6, coalesce(sum(boost) FILTER (kind = 'graph'), 0)) AS gra, string_agg(reason, ';' ORDER BY reason) AS reasons FROM sig GROUP BY 1)"""

MD_POSTS = POSTS.replace(RAW, MD).replace("FROM raw", "FROM md")
ONE_SEED = "SELECT 'doc:ideas/doc-1.md' AS chunk_id"


def best_chunks(words: list[list[str]], most: int) -> str:
    """The chunks of full text over Markdown pages, the best first."""
    return f"WITH {MD_POSTS}, {bm25(words)} SELECT chunk_id FROM scored ORDER BY bm25, chunk_id LIMIT {most}"


def page_signals(seeds: str, depth: int) -> str:
    return f"""WITH RECURSIVE {LINK_ROWS}, e AS (SELECT DISTINCT 'doc:' || l.path AS a, 'doc:' || m.path AS b FROM links l JOIN md m ON m.path = target_path || '.md' WHERE m.path <> l.path),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, distance) AS (SELECT chunk_id, 0 FROM ({seeds}) UNION SELECT b, distance + 1 FROM walk JOIN both_ ON a = node WHERE distance < {depth})
SELECT node AS chunk_id, 'page-link depth ' || min(distance) AS reason, 'graph' AS kind, 0.36::DOUBLE / min(distance) AS boost FROM walk GROUP BY node HAVING min(distance) >= 1"""


def entity_signals(seeds: str) -> str:
    return f"""WITH {PAIRS}, names AS (SELECT DISTINCT id, canonical_name FROM ment), own AS (SELECT DISTINCT id, canonical_name FROM ment WHERE document_id IN ({seeds})),
rel AS (SELECT DISTINCT subject_entity_id AS a, object_entity_id AS b FROM pairs),
hop AS (SELECT b AS id, a AS seed, a, b FROM rel WHERE a IN (SELECT id FROM own) AND b NOT IN (SELECT id FROM own) UNION ALL SELECT a, b, a, b FROM rel WHERE b IN (SELECT id FROM own) AND a NOT IN (SELECT id FROM own)),
best AS (SELECT id, seed FROM hop QUALIFY row_number() OVER (PARTITION BY id ORDER BY a, b) = 1),
scopes AS (SELECT * FROM (SELECT id, 'entity-mention: ' || canonical_name AS reason, 0.28::DOUBLE AS boost FROM own
  UNION ALL SELECT best.id, 'candidate relation from ' || s.canonical_name || ': co_occurs_in_chunk -> ' || n.canonical_name, 0.2 FROM best JOIN names s ON s.id = seed JOIN names n ON n.id = best.id) ORDER BY id LIMIT 64),
of_ AS (SELECT DISTINCT scopes.id, document_id, reason, boost FROM scopes JOIN ment USING (id))
SELECT document_id AS chunk_id, reason, 'graph' AS kind, boost FROM of_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY document_id) <= 8"""


# chunks line by line: the state is the open chunk (its size, lines, and where its last line that is not blank ends), e_ what a step closes
CHUNKS = f"""{MD}, l AS (SELECT 'doc:' || path AS doc, {LINES} AS lines FROM md),
ln AS (SELECT doc, k, length(lines[k]) + 1 AS cost, NOT regexp_matches(lines[k], '\\S') AS blank, regexp_matches(lines[k], '^\\s*#{{1,6}} ') AS head FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM l)),
w(doc, k, size, held, chars, last_line, last_chars, e_line, e_chars) AS (
  SELECT DISTINCT doc, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM ln UNION ALL
  SELECT doc, k, CASE WHEN shut THEN 0 ELSE size END, CASE WHEN shut THEN 0 ELSE held END, CASE WHEN shut THEN 0 ELSE chars END, CASE WHEN NOT shut THEN last_line END, CASE WHEN NOT shut THEN last_chars END,
    CASE WHEN shut THEN last_line ELSE e_line END, CASE WHEN shut THEN last_chars ELSE e_chars END FROM (
    SELECT *, blank AND held > 1 AND size >= 600 AS shut FROM (
      SELECT doc, k, blank, s.size + cost AS size, s.held + 1 AS held, s.chars + cost AS chars, CASE WHEN blank THEN s.last_line ELSE k END AS last_line, CASE WHEN blank THEN s.last_chars ELSE s.chars + cost - 1 END AS last_chars, e_line, e_chars FROM (
        SELECT ln.*, CASE WHEN opens THEN {{'size': 0::BIGINT, 'held': 0::BIGINT, 'chars': 0::BIGINT, 'last_line': NULL::BIGINT, 'last_chars': NULL::BIGINT}} ELSE st END AS s, CASE WHEN opens THEN st.last_line END AS e_line, CASE WHEN opens THEN st.last_chars END AS e_chars FROM (
          SELECT w.doc, w.k + 1 AS upto, n.head OR (w.size > 0 AND w.size + n.cost > 1200) AS opens, {{'size': w.size, 'held': w.held, 'chars': w.chars, 'last_line': w.last_line, 'last_chars': w.last_chars}} AS st FROM w JOIN ln n ON n.doc = w.doc AND n.k = w.k + 1) x JOIN ln ON ln.doc = x.doc AND ln.k = x.upto)))),
closed AS (SELECT doc, e_line AS line, e_chars AS chars FROM w WHERE e_line IS NOT NULL UNION ALL SELECT doc, last_line, last_chars FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k DESC) = 1) WHERE last_line IS NOT NULL)"""


def starts(pattern: str) -> str:
    """Character places (from 0) of the matches of a pattern."""
    pieces, found = f"regexp_split_to_array(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}')"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda j: CAST({size(pieces + '[1:j]')} + {size(found + '[1:j - 1]')} AS BIGINT))"


ORACLES: dict[str, str] = {
    "search_literal_and": ranked("regexp_matches(text, '(?i)worthless') AND regexp_matches(text, '(?i)clown')", hits("(?i)worthless[\\s\\p{P}\\p{S}/_-]*clown"), hits("(?i)worthless") + " + " + hits("(?i)clown")),
    "search_phrase_rank": ranked("regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)of')", hits("(?i)the[\\s\\p{P}\\p{S}/_-]*of"), hits("(?i)the") + " + " + hits("(?i)of"), "ORDER BY area_rank, phrase_hits DESC, token_hits DESC, path LIMIT 50"),
    "search_regex": ranked("regexp_matches(text, '[0-9]{3}-[0-9]{4}')", "0", hits("[0-9]{3}-[0-9]{4}")),
    "search_files": f"WITH {RAW} SELECT path FROM raw WHERE regexp_matches(text, '(?i)trash') ORDER BY path LIMIT 50",
    "search_category": ranked("path LIKE 'ideas/%' AND regexp_matches(text, '(?i)idiot')", "0", hits("(?i)idiot")),
    "search_content_context": f"""WITH {RAW}, l AS (SELECT path, {LINES} AS lines FROM raw WHERE regexp_matches(text, '(?i)disgusting')),
n AS (SELECT path, k, lines[k] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM l)),
h AS (SELECT DISTINCT path, k + o AS k FROM n, (VALUES (-1), (0), (1)) v(o) WHERE regexp_matches(line, '(?i)disgusting'))
SELECT path, k AS line_number, line FROM n SEMI JOIN h USING (path, k)""",
    "search_excerpts": f"""WITH {RAW}, m AS (SELECT path, text, {starts("(?i)licensed[\\s\\p{P}\\p{S}/_-]*under")} AS whole, list_sort(list_distinct(list_concat({starts('(?i)licensed')}, {starts('(?i)under')}))) AS words
  FROM raw WHERE regexp_matches(text, '(?i)licensed') AND regexp_matches(text, '(?i)under')),
s AS (SELECT path, text, (CASE WHEN len(whole) > 0 THEN whole ELSE words END)[1:5] AS places FROM m), x AS (SELECT path, text, unnest(range(1, len(places) + 1)) AS j, places FROM s),
y AS (SELECT path, j - 1 AS ordinal, string_split(text, chr(10)) AS lines, len(string_split(substr(text, 1, places[j]), chr(10))) - 1 AS k FROM x),
z AS (SELECT path, ordinal, CASE WHEN k > 0 THEN array_to_string(list_transform(lines[greatest(k - 1, 1):k], lambda l: l || chr(10) || chr(10)), '') ELSE '' END || lines[k + 1] || chr(10) AS body FROM y)
SELECT path, ordinal, CASE WHEN length(body) > EXCERPT THEN substr(body, 1, EXCERPT) || '...' ELSE body END AS body FROM z""".replace("EXCERPT", str(EXCERPT_CHARS)),
    "chunk_stats": f"WITH RECURSIVE {CHUNKS} SELECT doc AS document_id, count(*) AS chunks, max(line) AS end_line, max(chars) AS longest FROM closed GROUP BY doc",
    "lines_explode": f"WITH {RAW}, l AS (SELECT path, {LINES} AS lines FROM raw) SELECT path, k AS line_number, lines[k] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM l)",
    "headings": f"""WITH {MD}, l AS (SELECT path, {LINES} AS lines FROM md), n AS (SELECT path, k, lines[k] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM l)),
h AS (SELECT path, k AS line_number, length(regexp_extract(line, '^\\s*(#{{1,6}}) ', 1)) AS level, trim(regexp_extract(line, '^\\s*#{{1,6}} (.*)$', 1)) AS heading FROM n WHERE regexp_matches(line, '^\\s*#{{1,6}} '))
SELECT path, line_number, level, heading, CASE WHEN level = 1 THEN heading ELSE first_value(heading) OVER (PARTITION BY path ORDER BY line_number) || ' > ' || heading END AS heading_path FROM h""",
    "titles": f"WITH {MD} SELECT 'doc:' || path AS id, path, 'Doc ' || doc_id AS title, split_part(path, '/', 1) AS category, {AREA} AS area, sha256(text) AS sha256 FROM md",
    "wiki_links": f"WITH {LINK_ROWS} SELECT 'doc:' || path AS source_document_id, ordinal, target_path, link_text, 'wiki' AS link_kind FROM links",
    "link_resolution": f"WITH {EDGES} SELECT * FROM edges",
    "graph_stats": f"WITH {EDGES} SELECT (SELECT count(*) FROM md) AS nodes, count(*) AS links, count(DISTINCT (source, target)) AS distinct_edges, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS dangling FROM edges",
    "graph_neighbors_d2": f"""WITH {EDGES}, one AS (
  SELECT 1 AS depth, 'outgoing' AS direction, source, target, link_text, resolved, CASE WHEN resolved THEN target END AS nxt FROM edges WHERE source = 'ideas/doc-1'
  UNION SELECT 1, 'incoming', source, target, link_text, resolved, source FROM edges WHERE resolved AND target = 'ideas/doc-1'
), front AS (SELECT DISTINCT nxt AS node FROM one WHERE nxt IS NOT NULL AND nxt <> 'ideas/doc-1'), two AS (
  SELECT 2 AS depth, 'outgoing' AS direction, source, target, link_text, resolved FROM edges SEMI JOIN front ON source = node
  UNION SELECT 2, 'incoming', source, target, link_text, resolved FROM edges SEMI JOIN front ON target = node WHERE resolved
) SELECT depth, direction, source, target, link_text, resolved FROM one UNION SELECT * FROM two""",
    "graph_path": f"""WITH RECURSIVE {EDGES}, walk(node, steps) AS (
  SELECT 'notes/doc-0', [] :: STRUCT(source VARCHAR, target VARCHAR, link_text VARCHAR)[] UNION ALL
  SELECT target, list_append(steps, {{'source': source, 'target': target, 'link_text': link_text}}) FROM walk JOIN edges ON source = node WHERE resolved AND len(steps) < 4
), best AS (SELECT steps FROM walk WHERE node = 'sdd/doc-8' ORDER BY len(steps), CAST(steps AS VARCHAR) LIMIT 1)
SELECT k AS step, steps[k].source AS source, steps[k].target AS target, steps[k].link_text AS link_text FROM (SELECT steps, unnest(range(1, len(steps) + 1)) AS k FROM best)""",
    "graph_distance": f"""WITH RECURSIVE {LINK_ROWS}, e AS (SELECT DISTINCT 'doc:' || l.path AS a, 'doc:' || m.path AS b FROM links l JOIN md m ON m.path = target_path || '.md' WHERE m.path <> l.path),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, distance) AS (SELECT 'doc:ideas/doc-1.md', 0 UNION SELECT b, distance + 1 FROM walk JOIN both_ ON a = node WHERE distance < 3)
SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM walk GROUP BY node""",
    "entities": f"WITH {ENTITIES} SELECT id, canonical_name, entity_type, max(confidence) AS confidence, count(*) AS mentions FROM ment GROUP BY ALL",
    "entity_mentions": f"WITH {ENTITIES} SELECT document_id, entity_type, canonical_name, canonical_name AS surface, start_line, extractor, confidence FROM ment",
    "cooccurrence": f"WITH {PAIRS} SELECT relation_id AS id, subject_entity_id, object_entity_id, max(confidence) AS confidence FROM pairs GROUP BY ALL",
    "entity_neighbors": f"""WITH {PAIRS}, n AS (SELECT subject_entity_id AS id, object_entity_id AS neighbor_id, 'outgoing' AS direction, confidence, document_id FROM pairs UNION ALL SELECT object_entity_id, subject_entity_id, 'incoming', confidence, document_id FROM pairs)
SELECT n.id, neighbor_id, direction, max(n.confidence) AS confidence, any_value(m.canonical_name) AS neighbor_name, count(DISTINCT n.document_id) AS n_evidence FROM n JOIN (SELECT DISTINCT id, canonical_name FROM ment) m ON m.id = neighbor_id GROUP BY 1, 2, 3""",
    "relation_evidence": f"WITH {PAIRS} SELECT relation_id, count(*) AS n, min(start_line - 2) AS start_line FROM pairs GROUP BY 1",
    "postings": f"WITH {POSTS} SELECT term, count(*) AS n, count(DISTINCT chunk_id) AS df, CAST(sum(pos) AS BIGINT) AS places FROM posts GROUP BY term",
    "fts_and_phrase": f"WITH {POSTS}, {bm25([['apache'], ['version', '2', '0']])} SELECT chunk_id, round(bm25, 6) AS bm25 FROM scored",
    "bm25_topk": f"WITH {POSTS}, {bm25([['worthless'], ['clown']])} SELECT chunk_id, round(bm25, 6) AS bm25 FROM (SELECT * FROM scored ORDER BY bm25, chunk_id LIMIT 50)",
    "bm25_stored": f"WITH {POSTS}, {bm25([['worthless'], ['clown']])} SELECT chunk_id, round(bm25, 6) AS bm25 FROM (SELECT * FROM scored ORDER BY bm25, chunk_id LIMIT 50)",
    "bm25_blocks": f"WITH {POSTS}, {bm25([['from'], ['this']])} SELECT chunk_id, round(bm25, 6) AS bm25 FROM (SELECT * FROM scored ORDER BY bm25, chunk_id LIMIT 10)",
    "index_after_refresh": f"""WITH {ENTITIES} SELECT id, canonical_name, entity_type, max(confidence) AS confidence, count(*) AS mentions FROM ment
WHERE document_id IN (SELECT 'doc:' || md.path FROM md JOIN documents d ON d.doc_id = md.doc_id WHERE d.lang <> 'de') GROUP BY ALL""",
    "like_fallback": f"WITH {RAW} SELECT 'doc:' || path AS id, length(text) AS n FROM raw WHERE text ILIKE '%tr_sh%moron%'",
    "regex_chunks": f"WITH {RAW} SELECT 'doc:' || path AS id FROM raw WHERE regexp_matches(text, '(?i)pathetic|sc[u]m')",
    "term_fallback": f"WITH {POSTS} SELECT DISTINCT chunk_id, 'query-term: ' || term AS reason, CAST(round(least(0.9, 0.52 + 0.035 * (length(term) - 2)), 6) AS DOUBLE) AS boost FROM posts WHERE term IN ('pathetic', 'clown', 'idiot')",
    "vector_topk": "SELECT vec_id, round(sim, 5) AS sim FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS sim FROM embeddings) ORDER BY sim DESC, vec_id LIMIT 100",
    "score_fusion": f"WITH {SIGNALS} SELECT chunk_id, round(lex, 6) AS lexical_score, round(gra * 0.5, 6) AS graph_score, round(lex + gra * 0.5, 6) AS score, reasons FROM fused",
    "context_budget": f"""WITH {SIGNALS}, best AS (SELECT chunk_id, lex + gra AS score FROM fused ORDER BY score DESC, chunk_id LIMIT 100),
x AS (SELECT chunk_id, score, array_to_string(list_filter(list_transform({LINES}, lambda l: trim(l)), lambda l: l <> ''), ' ') AS e FROM best JOIN raw ON chunk_id = 'doc:' || path),
s AS (SELECT chunk_id, score, CASE WHEN length(e) > 360 THEN 363 ELSE length(e) END AS n FROM x),
c AS (SELECT chunk_id, n, CAST(coalesce(sum(n) OVER (ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s)
SELECT chunk_id, before, least(n, 8000 - before) AS taken FROM c WHERE before < 8000""",
    "overview_areas": f"WITH {RAW} SELECT area, rank, count(path) AS pages FROM (VALUES ('notes', 0), ('ideas', 1), ('projects', 2), ('sdd', 3)) a(area, rank) LEFT JOIN raw ON path LIKE area || '/%' GROUP BY ALL",
    "newest_page": f"WITH {RAW} SELECT path, length(text) * 1000 AS modified_at, strftime(to_timestamp(length(text) * 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS modified FROM raw ORDER BY modified_at DESC, path LIMIT 1",
    "incremental_diff": """WITH n AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE lang <> 'de'), o AS (SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN 'old ' || text ELSE text END) AS s FROM documents WHERE lang <> 'fr')
SELECT 'doc:doc-' || coalesce(n.doc_id, o.doc_id) || '.md' AS id, 'doc-' || coalesce(n.doc_id, o.doc_id) || '.md' AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.s = o.s THEN 'unchanged' ELSE 'updated' END AS status FROM n FULL JOIN o ON n.doc_id = o.doc_id""",
    "orphans_anti": f"""WITH {PAIRS}, gone AS (SELECT document_id FROM ment WHERE canonical_name = 'handler_3') SELECT DISTINCT relation_id AS id, 'relation' AS kind FROM pairs WHERE relation_id NOT IN (SELECT relation_id FROM pairs WHERE document_id NOT IN (FROM gone))
UNION SELECT id, 'entity' FROM ment WHERE id NOT IN (SELECT id FROM ment WHERE document_id NOT IN (FROM gone))""",
    "page_expansion": f"SELECT chunk_id, reason, kind, round(boost, 6) AS boost FROM ({page_signals(ONE_SEED, 2)})",
    "entity_expansion": f"SELECT chunk_id, reason, kind, round(boost, 6) AS boost FROM ({entity_signals(ONE_SEED)})",
    "lexical_cascade": f"""SELECT chunk_id, 'fts5' AS reason, 'lexical' AS kind, 1.0::DOUBLE AS boost, 'worthless clown' AS query FROM ({best_chunks([['worthless'], ['clown']], 500)})
UNION ALL SELECT chunk_id, 'substring', 'lexical', 0.82, 'rthless' FROM (WITH {MD} SELECT 'doc:' || path AS chunk_id FROM md WHERE text ILIKE '%rthless%' ORDER BY 1 LIMIT 500)
""" + "\n".join(f"UNION ALL SELECT chunk_id, 'query-term: {t}', 'lexical', {min(0.9, 0.52 + 0.035 * (len(t) - 2)):.6f}, 'What is the pathetic clown, and why the Idiot?' FROM ({best_chunks([[t]], 500)})" for t in ("pathetic", "clown", "idiot")),
    "rag_search": f"""WITH seeds AS ({best_chunks([['worthless'], ['clown']], 500)}), sig AS (
  SELECT chunk_id, 'fts5' AS reason, 'lexical' AS kind, 1.0::DOUBLE AS boost FROM seeds UNION ({page_signals('SELECT chunk_id FROM seeds', 1)}) UNION ({entity_signals('SELECT chunk_id FROM seeds')})
), fused AS (SELECT chunk_id, coalesce(max(boost) FILTER (kind = 'lexical'), 0) AS lex, least(0.6, coalesce(sum(boost) FILTER (kind = 'graph'), 0)) AS gra, string_agg(reason, ';' ORDER BY reason) AS reasons FROM sig GROUP BY 1)
SELECT chunk_id, substr(chunk_id, 5) AS path, 'Doc ' || regexp_extract(chunk_id, 'doc-([0-9]+)', 1) AS title, round(lex, 6) AS lexical_score, round(gra, 6) AS graph_score, round(lex + gra, 6) AS score, reasons FROM fused ORDER BY round(lex + gra, 9) DESC, path LIMIT 100""",
    "vector_signal": "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'own:embeddings' AS reason, 'vector' AS kind, round(greatest(0, sim), 5) AS boost FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS sim FROM embeddings) ORDER BY sim DESC, CAST(vec_id AS VARCHAR) LIMIT 100",
    "embedding_cache": f"WITH {RAW} SELECT 'doc:' || path AS chunk_id, 'local-hash' AS provider, 'token-ngram-v1' AS model, 384::BIGINT AS size FROM raw WHERE doc_id % 3 <> 0",
    "log_tail": """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS path, entry, '## [' || turn || '] ' || role || chr(10) || CASE WHEN entry = n THEN regexp_replace(t, '\\r?\\n$', '') ELSE t END AS body FROM c WHERE entry > n - 2""",
    "spec_coverage_gaps": rules_sql(GAPS),
    "spec_cycles": rules_sql(CIRCLES),
    "spec_issues": rules_sql(RULES),
}
