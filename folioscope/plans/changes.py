"""Specification files of changes out of the documents table, and the SQL of the rules over them.

Ten documents make a change; each gives a requirement that holds its text, and a task. Which of them break
which rule follows from their ids, so that the SQL states what the parsed tables hold without parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# -- what a document d of change c at place k gives, read alike by Spark and DuckDB ------------------

BASE = "SELECT doc_id AS d, doc_id // 10 AS c, doc_id % 10 AS k, coalesce(text, '') AS text FROM {source}"
REQ_FILE = "CASE WHEN d % 17 = 6 THEN 'part-' || d ELSE 'REQ-' || d END"
REQ_ID = "CASE WHEN d % 17 = 6 THEN 'part-' || d WHEN d % 19 = 4 THEN 'REQ-' || (d - 1) ELSE 'REQ-' || d END"
REQ_PRIORITY = "CASE WHEN d % 23 = 9 THEN 'often' WHEN d % 5 = 1 THEN 'MUST' WHEN d % 5 = 2 THEN 'should' WHEN d % 5 = 3 THEN 'may' ELSE 'must' END"
REQ_STATUS = "CASE WHEN d % 29 = 7 THEN 'new' WHEN d % 6 = 0 THEN 'Verified' ELSE 'proposed' END"
FIRST_AC = "CASE WHEN d % 31 = 2 THEN 'AC-' || (d - 1) || '-1' ELSE 'AC-' || d || '-1' END"
REQ_DEP = "CASE WHEN k < 9 THEN 'REQ-' || (d + 1) WHEN c % 3 = 0 THEN 'REQ-' || (c * 10) WHEN c % 3 = 1 THEN 'REQ-' || d ELSE 'REQ-' || d || 'x' END"
TASK_ID = "CASE WHEN d % 41 = 3 THEN 'TASK-' || (d - 1) ELSE 'TASK-' || d END"
TASK_PRIORITY = "CASE WHEN d % 43 = 1 THEN 'urgent' WHEN d % 4 = 2 THEN 'should' ELSE 'must' END"
TASK_STATUS = "CASE WHEN d % 47 = 5 THEN 'later' WHEN d % 5 = 0 THEN 'done' WHEN d % 5 = 1 THEN 'todo' WHEN d % 5 = 2 THEN 'blocked' WHEN d % 5 = 3 THEN 'dropped' ELSE 'Doing' END"
TASK_TYPE = "CASE WHEN d % 53 = 6 THEN 'magic' WHEN d % 2 = 0 THEN 'test' ELSE 'code' END"
TASK_DEP = "CASE WHEN k > 0 THEN 'TASK-' || (d - 1) WHEN c % 5 = 0 THEN 'TASK-' || (d + 9) WHEN c % 5 = 1 THEN 'TASK-' || d END"
HAS_ACS, HAS_TASK, HAS_TASK_ID, HAS_REFS, DEFINED = "d % 13 <> 5", "c % 7 <> 5", "d % 37 <> 11", "d % 12 <> 7", "d % 14 <> 9"
WITHOUT_TASKS, HAS_INDEX, HAS_TASK_INDEX, BLANK_INDEX = "(c % 7 = 4 OR c % 14 = 5)", "c % 11 <> 3", "c % 13 <> 6", "c % 11 = 7"
ROW_TASK = "CASE WHEN d % 16 = 5 THEN 'TASK-' || (d + 1000000) ELSE 'TASK-' || d END"
ROW_AC = "CASE WHEN d % 21 = 10 THEN 'AC-' || d || '-9' ELSE 'AC-' || d || '-1' END"

NL = "chr(10)"
REQ_TEXT = " || ".join([
    "'# '", f"CASE WHEN d % 17 = 6 THEN 'Part' WHEN d % 19 = 4 THEN 'REQ-' || (d - 1) || ' again' ELSE 'REQ-' || d || ' Wanted' END", NL, NL, "'- Priority: '", REQ_PRIORITY, "' | Status: '", REQ_STATUS, NL, "'- Dependencies: '", REQ_DEP, NL, NL,
    "CASE WHEN d % 13 = 8 THEN '' ELSE '## 验收条件' || chr(10) || chr(10) END", f"CASE WHEN {HAS_ACS} THEN '### ' || {FIRST_AC} || chr(10) || CASE WHEN d % 3 <> 0 THEN '### ACC-' || d || '-2' || chr(10) ELSE '' END ELSE '' END", NL, "'Text'", NL, NL, "text", NL,
])
TASK_TEXT = " || ".join([
    "'# '", f"CASE WHEN {HAS_TASK_ID} THEN {TASK_ID} ELSE 'Nameless' END", NL, NL, "'- Priority: '", TASK_PRIORITY, NL, "'- Status: '", TASK_STATUS, NL, f"CASE WHEN d % 2 = 0 OR d % 53 = 6 THEN '- Type: ' || {TASK_TYPE} || chr(10) ELSE '' END",
    f"CASE WHEN {HAS_REFS} THEN '- Requirement refs: REQ-' || d || CASE WHEN d % 9 = 1 THEN ', REQ-' || (d + 1000000) ELSE '' END || chr(10) ELSE '' END", "'- Acceptance refs: AC-'", "d", "'-1'", "CASE WHEN d % 3 = 1 THEN ' ACC-' || d || '-2' ELSE '' END", NL,
    f"coalesce('- Depends on: ' || {TASK_DEP} || chr(10), '')", "CASE WHEN d % 2 = 0 THEN '- Blocked reason: waits' || chr(10) ELSE '' END", "CASE WHEN d % 4 = 2 THEN '- Unblock condition: none' || chr(10) WHEN d % 4 = 0 THEN '- Unblock condition:  ' || chr(10) ELSE '' END",
    "CASE WHEN d % 10 = 3 THEN '- Dropped reason: old' || chr(10) ELSE '' END", f"CASE WHEN NOT ({DEFINED}) THEN '' WHEN d % 2 = 0 THEN '## 完成定义' || chr(10) ELSE '## Completion Definition' || chr(10) END",
])
ROW_TEXT = f"'| REQ-' || d || ' | ' || {ROW_AC} || ' | ' || {ROW_TASK} || ' |' || chr(10) || CASE WHEN d % 6 = 4 THEN '| REQ-' || d || ' | ACC-' || d || '-2 | TASK-' || d || ' |' || chr(10) ELSE '' END"
INDEX_TEXT = f"CASE WHEN {BLANK_INDEX} THEN '  ' || chr(10) ELSE '# Change ' || c || chr(10) || '- [CODE] E-' || c || '-1 and E-' || c || '-2' || chr(10) || 'E-' || c || '-3 has no mark' || chr(10) || CASE WHEN c % 4 = 0 THEN '[CMD] E-' || c || '-1' || chr(10) ELSE '' END END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, path, text of all changes; a change has at most ten documents, so its index of tasks is short."""
    base = spark.sql(BASE.replace("//", "DIV").format(source="{documents}"), documents=table(spark, sf_dir, "documents"))
    change = "'change-' || c AS change_id"
    rows = base.where("d % 8 <> 3").selectExpr("c", "d", f"{ROW_TEXT} AS line")
    per_change = base.groupBy("c").agg(F.count("*").alias("documents")).join(rows.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "line"))), lambda x: x["line"]), "").alias("rows")), "c", "left")
    parts = [
        base.selectExpr(change, f"'spec/requirements/' || {REQ_FILE} || '.md' AS path", f"{REQ_TEXT} AS text"),
        base.where(HAS_TASK).selectExpr(change, "'tasks/TASK-' || d || '.md' AS path", f"{TASK_TEXT} AS text"),
        per_change.where(HAS_INDEX).selectExpr(change, "'spec/index.md' AS path", f"{INDEX_TEXT} AS text"),
        per_change.where(HAS_TASK_INDEX).selectExpr(change, "'tasks/index.md' AS path", f"'# Tasks' || chr(10) || 'Has tasks: ' || CASE WHEN {WITHOUT_TASKS} THEN 'FALSE' ELSE 'true' END || chr(10) || '|---|---|---|' || chr(10) || coalesce(rows, '') AS text"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# -- the same in DuckDB: parsed tables, then the rules -----------------------------------------------

PARSED = f"""base AS ({BASE.format(source='documents')}), change AS (SELECT DISTINCT c FROM base),
req AS (SELECT c, d, {REQ_ID} AS id, {REQ_PRIORITY} AS priority, {REQ_STATUS} AS status, {REQ_DEP} AS dep FROM base),
acs AS (SELECT c, id, priority, {FIRST_AC} AS ac FROM req WHERE {HAS_ACS} UNION ALL SELECT c, id, priority, 'ACC-' || d || '-2' FROM req WHERE {HAS_ACS} AND d % 3 <> 0),
task AS (SELECT c, d, {TASK_ID} AS id, {TASK_PRIORITY} AS priority, {TASK_STATUS} AS status, {TASK_TYPE} AS kind, CASE WHEN d % 2 = 0 THEN 'waits' END AS reason, CASE WHEN d % 4 = 2 THEN 'none' END AS unblock, CASE WHEN d % 10 = 3 THEN 'old' END AS dropped, {TASK_DEP} AS dep FROM base WHERE {HAS_TASK} AND {HAS_TASK_ID}),
task_reqs AS (SELECT c, d, id, priority, status, 'REQ-' || d AS req FROM task WHERE {HAS_REFS} UNION ALL SELECT c, d, id, priority, status, 'REQ-' || (d + 1000000) FROM task WHERE {HAS_REFS} AND d % 9 = 1),
task_acs AS (SELECT c, d, id, 'AC-' || d || '-1' AS ac FROM task UNION ALL SELECT c, d, id, 'ACC-' || d || '-2' FROM task WHERE d % 3 = 1),
pairs AS (SELECT r.c, r.id, r.status, r.req, a.ac FROM task_reqs r JOIN task_acs a ON a.c = r.c AND a.d = r.d),
matrix AS (SELECT c, 'REQ-' || d AS req, {ROW_AC} AS ac, {ROW_TASK} AS task FROM base WHERE d % 8 <> 3 AND {HAS_TASK_INDEX} UNION ALL SELECT c, 'REQ-' || d, 'ACC-' || d || '-2', 'TASK-' || d FROM base WHERE d % 8 <> 3 AND d % 6 = 4 AND {HAS_TASK_INDEX}),
evidence AS (SELECT c, 'E-' || c || '-1' AS e FROM change WHERE {HAS_INDEX} AND NOT {BLANK_INDEX} UNION ALL SELECT c, 'E-' || c || '-2' FROM change WHERE {HAS_INDEX} AND NOT {BLANK_INDEX} UNION ALL SELECT c, 'E-' || c || '-1' FROM change WHERE {HAS_INDEX} AND NOT {BLANK_INDEX} AND c % 4 = 0),
req_walk(c, a, b) AS (SELECT c, id, dep FROM req WHERE id <> dep UNION SELECT w.c, w.a, r.dep FROM req_walk w JOIN req r ON r.c = w.c AND r.id = w.b WHERE r.id <> r.dep),
task_walk(c, a, b) AS (SELECT c, id, dep FROM task WHERE id <> dep UNION SELECT w.c, w.a, t.dep FROM task_walk w JOIN task t ON t.c = w.c AND t.id = w.b WHERE t.id <> t.dep),
need AS (SELECT DISTINCT c, id AS req, ac FROM acs WHERE lower(priority) = 'must')"""
GAPS = """SELECT c, 'UNCOVERED' AS code, req || ' ' || ac AS message FROM need ANTI JOIN (SELECT * FROM pairs WHERE lower(status) <> 'dropped') USING (c, req, ac)
UNION ALL SELECT c, 'NOT_IN_MATRIX', req || ' ' || ac FROM need ANTI JOIN matrix USING (c, req, ac)"""
CIRCLES = """SELECT c, 'REQUIREMENT_CYCLE' AS code, '' AS message FROM req_walk WHERE a = b UNION SELECT c, 'SDD_TASK_DEPENDENCY_CYCLE', '' FROM task_walk WHERE a = b"""
PRIORITY, STATE, TASK_STATE = "('must', 'should', 'may')", "('proposed', 'implemented', 'verified', 'dropped')", "('todo', 'doing', 'blocked', 'done', 'dropped')"
RULES = f"""{GAPS} UNION ALL {CIRCLES}
UNION ALL SELECT c, 'MISSING', 'spec/index.md' FROM change WHERE NOT {HAS_INDEX} UNION ALL SELECT c, 'MISSING', 'tasks/index.md' FROM change WHERE NOT {HAS_TASK_INDEX} UNION ALL SELECT c, 'EMPTY', 'spec/index.md' FROM change WHERE {HAS_INDEX} AND {BLANK_INDEX}
UNION ALL SELECT c, 'NO_ACCEPTANCE', 'spec/requirements/' || {REQ_FILE} || '.md' FROM base WHERE d % 13 = 8 UNION ALL SELECT c, 'NO_REQUIREMENT_ID', 'spec/requirements/' || {REQ_FILE} || '.md' FROM base WHERE d % 17 = 6
UNION ALL SELECT c, 'TASKS_DECLARED_ABSENT', '' FROM change WHERE {WITHOUT_TASKS} AND {HAS_TASK_INDEX} AND {HAS_TASK} UNION ALL SELECT c, 'NO_TASKS', '' FROM change WHERE NOT ({WITHOUT_TASKS} AND {HAS_TASK_INDEX}) AND NOT {HAS_TASK}
UNION ALL SELECT c, 'BAD_PRIORITY', id FROM req WHERE lower(priority) NOT IN {PRIORITY} UNION ALL SELECT c, 'BAD_STATUS', id FROM req WHERE lower(status) NOT IN {STATE} UNION ALL SELECT c, 'BAD_PRIORITY', id FROM task WHERE lower(priority) NOT IN {PRIORITY}
UNION ALL SELECT c, 'BAD_STATUS', id FROM task WHERE lower(status) NOT IN {TASK_STATE} UNION ALL SELECT c, 'BAD_TYPE', id FROM task WHERE kind = 'magic' UNION ALL SELECT c, 'NO_DEFINITION', id FROM task WHERE NOT ({DEFINED})
UNION ALL SELECT c, 'SDD_DUPLICATE_ID', id FROM req GROUP BY c, id HAVING count(*) > 1 UNION ALL SELECT c, 'SDD_DUPLICATE_ID', id FROM task GROUP BY c, id HAVING count(*) > 1
UNION ALL SELECT c, 'SDD_DUPLICATE_ID', ac FROM acs GROUP BY c, ac HAVING count(*) > 1 UNION ALL SELECT c, 'SDD_DUPLICATE_ID', e FROM evidence GROUP BY c, e HAVING count(*) > 1
UNION ALL SELECT c, 'SDD_REQUIREMENT_UNCOVERED', id FROM req WHERE lower(priority) = 'must' AND NOT ({HAS_ACS}) UNION ALL SELECT c, 'SELF_DEPENDENCY', id FROM req WHERE id = dep UNION ALL SELECT c, 'UNKNOWN_REQUIREMENT', id || ' ' || dep FROM req WHERE (c, dep) NOT IN (SELECT c, id FROM req)
UNION ALL SELECT c, 'NO_REQUIREMENT_REFS', id FROM task WHERE NOT ({HAS_REFS}) UNION ALL SELECT c, 'UNKNOWN_REQUIREMENT', id || ' ' || req FROM task_reqs WHERE (c, req) NOT IN (SELECT c, id FROM req) UNION ALL SELECT c, 'UNKNOWN_ACCEPTANCE', id || ' ' || ac FROM task_acs WHERE (c, ac) NOT IN (SELECT c, ac FROM acs)
UNION ALL SELECT c, 'NO_BLOCKED_REASON', id FROM task WHERE status = 'blocked' AND reason IS NULL UNION ALL SELECT c, 'NO_UNBLOCK_CONDITION', id FROM task WHERE status = 'blocked' AND unblock IS NULL UNION ALL SELECT c, 'NO_DROPPED_REASON', id FROM task WHERE status = 'dropped' AND dropped IS NULL
UNION ALL SELECT c, 'WEAK_COVER', id || ' ' || req FROM task_reqs WHERE priority <> 'must' AND (c, req) IN (SELECT c, id FROM req WHERE lower(priority) = 'must')
UNION ALL SELECT c, 'SDD_TASK_SELF_DEPENDENCY', id FROM task WHERE id = dep UNION ALL SELECT c, 'SDD_UNKNOWN_TASK_REFERENCE', id || ' ' || dep FROM task WHERE id <> dep AND (c, dep) NOT IN (SELECT c, id FROM task)
UNION ALL SELECT c, 'MATRIX_UNKNOWN_TASK', task FROM matrix WHERE (c, task) NOT IN (SELECT c, id FROM task) UNION ALL SELECT c, 'MATRIX_UNKNOWN', req || ' ' || ac FROM matrix WHERE (c, req, ac) NOT IN (SELECT c, id, ac FROM acs)
UNION ALL SELECT c, 'MATRIX_MISMATCH', task || ' ' || req || ' ' || ac FROM matrix WHERE (c, task) IN (SELECT c, id FROM task) AND (c, req, ac, task) NOT IN (SELECT c, req, ac, id FROM pairs)
UNION ALL SELECT c, 'NOT_DECLARED', id || ' ' || ac FROM pairs WHERE (c, req, ac) IN (SELECT c, id, ac FROM acs) AND (c, req, ac, id) NOT IN (SELECT c, req, ac, task FROM matrix)
UNION ALL SELECT c, 'UNFINISHED', id FROM task WHERE lower(status) NOT IN ('done', 'dropped')"""


def rules_sql(rules: str) -> str:
    return f"WITH RECURSIVE {PARSED} SELECT DISTINCT 'change-' || c AS change_id, code, message FROM ({rules})"
