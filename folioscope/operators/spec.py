"""Specification documents: parsing, the rules as DataFrames, and the change lifecycle."""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Vocabularies, marks and the envelope's version.
PRIORITIES, REQUIREMENT_STATES = ("must", "should", "may"), ("proposed", "implemented", "verified", "dropped")
TASK_STATES = ("todo", "doing", "blocked", "done", "dropped")
TASK_TYPES = ("code", "test", "config", "data", "docs", "review", "release")
ACCEPTANCE_HEADING, DEFINITION_HEADINGS = "## 验收条件", ("## completion definition", "## 完成定义")
TASK_FIELDS = ("priority", "status", "type", "requirement refs", "acceptance refs", "depends on", "blocked reason", "unblock condition", "dropped reason")
EVIDENCE_MARKS = ("[CODE]", "[SDD]", "[CMD]")
VERSION, MOST_INPUT = "wiki.sdd/v1", 1_048_576

REQUIREMENTS = "change_id string, id string, priority string, status string, acceptance_ids array<string>, dependencies array<string>"
TASKS = "change_id string, id string, priority string, status string, task_type string, requirement_refs array<string>, acceptance_refs array<string>, dependencies array<string>, blocked_reason string, unblock_condition string, dropped_reason string, has_definition boolean"
COVERAGE = "change_id string, requirement string, acceptance string, task string"
EVIDENCE = "change_id string, evidence_id string"


# -- parsing ---------------------------------------------------------------------------------------


def ids_in(text: Column, *prefixes: str) -> Column:
    """Identifiers by prefix, sorted, without repetitions."""
    pattern = rf"(?<![A-Za-z0-9_-])((?:{'|'.join(prefixes)})[A-Za-z0-9_-]+)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def field(text: Column, name: str) -> Column:
    """The value of the first ``name: value``, in lines cut at bars, with or without leading dashes."""
    segments = F.split(text, "\r?\n|[|｜]", -1)
    key = rf"(?iu)^[\s-]*{re.escape(name)}\s*[:：](.*)$"
    hit = F.filter(segments, lambda s: s.rlike(key))
    return F.when(F.size(hit) > 0, T.trimmed(F.regexp_extract(hit[0], key, 1)))


def narrowed(text: Column, *names: str) -> Column:
    """The lines of a text that may be headings or hold one of the fields, with their ends, and its last line: one fast pass, after which the patterns of
    each field and heading read a few lines in the place of the whole text."""
    parts, of_field = F.split(text, "\n", -1), rf"(?iu)(?:^|[|｜])[\s-]*(?:{'|'.join(map(re.escape, names))})\s*[:：]"
    may = lambda line: line.contains("#") | ((line.contains(":") | line.contains("：")) & line.rlike(of_field))
    return F.array_join(F.concat(F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), may), F.array(F.element_at(parts, -1))), "\n")


def headings_of(text: Column) -> Column:
    return F.array_join(F.filter(T.lines(text), lambda line: line.rlike(r"^\s*#")), "\n")


def requirements(files: DataFrame) -> DataFrame:
    """requirements of files (change_id, path, text) below spec/requirements."""
    t, rows = F.col("short"), files.where(F.col("path").rlike(r"^spec/requirements/[^/]+\.md$"))
    rows = rows.select("change_id", "path", narrowed(F.col("text"), "priority", "status", "dependencies").alias("short"))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    first = F.get(F.regexp_extract_all(headings_of(t), F.lit(r"(?<![A-Za-z0-9_-])(REQ-[A-Za-z0-9_-]+)"), F.lit(1)), F.lit(0))
    return rows.select("change_id", F.coalesce(first, stem).alias("id"), F.coalesce(field(t, "priority"), F.lit("must")).alias("priority"), F.coalesce(field(t, "status"), F.lit("proposed")).alias("status"), ids_in(headings_of(t), "AC-", "ACC-").alias("acceptance_ids"), F.coalesce(ids_in(field(t, "dependencies"), "REQ-"), F.array().cast("array<string>")).alias("dependencies"))


def tasks(files: DataFrame) -> DataFrame:
    t, rows = F.col("short"), files.where(F.col("path").rlike(r"^tasks/[^/]+\.md$") & (F.col("path") != "tasks/index.md"))
    none = F.array().cast("array<string>")
    first = F.get(F.regexp_extract_all(headings_of(t), F.lit(r"(?<![A-Za-z0-9_-])(TASK-[A-Za-z0-9_-]+)"), F.lit(1)), F.lit(0))
    text = F.col("text")
    defined = F.lower(text).contains(DEFINITION_HEADINGS[0]) | text.contains(DEFINITION_HEADINGS[1])
    rows = rows.select("change_id", defined.alias("defined"), narrowed(text, *TASK_FIELDS).alias("short"))
    return rows.select(
        "change_id", first.alias("id"), F.coalesce(field(t, "priority"), F.lit("must")).alias("priority"), F.coalesce(field(t, "status"), F.lit("todo")).alias("status"), F.coalesce(field(t, "type"), F.lit("code")).alias("task_type"),
        F.coalesce(ids_in(field(t, "requirement refs"), "REQ-"), none).alias("requirement_refs"), F.coalesce(ids_in(field(t, "acceptance refs"), "AC-", "ACC-"), none).alias("acceptance_refs"), F.coalesce(ids_in(field(t, "depends on"), "TASK-"), none).alias("dependencies"),
        field(t, "blocked reason").alias("blocked_reason"), field(t, "unblock condition").alias("unblock_condition"), field(t, "dropped reason").alias("dropped_reason"), F.col("defined").alias("has_definition"),
    ).where("id is not null")


def coverage(files: DataFrame) -> DataFrame:
    """Rows ``| REQ | AC | TASK |`` of tasks/index.md."""
    rows = files.where("path = 'tasks/index.md'").select("change_id", F.explode(T.lines(F.col("text"))).alias("line")).where(F.col("line").rlike(r"^\s*\|"))
    cell = F.transform(F.split("line", r"\|", -1), T.trimmed)
    out = rows.select("change_id", F.get(cell, F.lit(1)).alias("requirement"), F.get(cell, F.lit(2)).alias("acceptance"), F.get(cell, F.lit(3)).alias("task"))
    return out.where(F.col("requirement").startswith("REQ-") & F.col("acceptance").rlike("^ACC?-") & F.col("task").startswith("TASK-"))


def evidence_ids(files: DataFrame) -> DataFrame:
    marked = lambda c: reduce(lambda a, b: a | b, [F.col(c).contains(m) for m in EVIDENCE_MARKS])
    rows = files.where(marked("text")).select("change_id", F.explode(T.lines(F.col("text"))).alias("line")).where(marked("line"))
    return rows.select("change_id", F.explode(ids_in(F.col("line"), "E-")).alias("evidence_id"))


# -- rules -----------------------------------------------------------------------------------------


def issue(rows: DataFrame, code: str, *parts: Column) -> DataFrame:
    return rows.select("change_id", F.lit(code).alias("code"), F.concat_ws(" ", *parts).alias("message"))


def repeated(rows: DataFrame, column: str) -> DataFrame:
    return issue(rows.where(F.col(column) != "").groupBy("change_id", column).count().where("count > 1"), "SDD_DUPLICATE_ID", F.col(column))


def missing(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (change_id, id, ref) whose ref is not among known (change_id, ref)."""
    return refs.join(known.select("change_id", "ref").distinct(), ["change_id", "ref"], "left_anti")


def cycles(refs: DataFrame, code: str) -> DataFrame:
    """Changes whose references (change_id, id, ref) run in a circle, found for all changes at once."""
    from .graph import cyclic

    return issue(cyclic(refs.select("change_id", F.col("id").alias("a"), F.col("ref").alias("b")), "change_id"), code)


def coverage_gaps(req: DataFrame, task: DataFrame, matrix: DataFrame) -> DataFrame:
    """Acceptance conditions of must-requirements that no live task, or no row of the matrix, covers."""
    need = req.where(F.lower("priority") == "must").select("change_id", F.col("id").alias("requirement"), F.explode("acceptance_ids").alias("acceptance")).distinct()
    live = task.where(F.lower("status") != "dropped").select("change_id", F.explode("requirement_refs").alias("requirement"), "acceptance_refs").select("change_id", "requirement", F.explode("acceptance_refs").alias("acceptance")).distinct()
    keys = ["change_id", "requirement", "acceptance"]
    return issue(need.join(live, keys, "left_anti"), "UNCOVERED", F.col("requirement"), F.col("acceptance")).unionByName(issue(need.join(matrix, keys, "left_anti"), "NOT_IN_MATRIX", F.col("requirement"), F.col("acceptance")))


def structure_issues(files: DataFrame) -> DataFrame:
    """Missing, empty and incomplete files of each change."""
    changes = files.select("change_id").distinct()
    has = lambda pattern: files.where(F.col("path").rlike(pattern)).select("change_id").distinct()
    lacks = lambda pattern, what: issue(changes.join(has(pattern), "change_id", "left_anti"), "MISSING", F.lit(what))
    reqs = files.where(F.col("path").rlike(r"^spec/requirements/[^/]+\.md$"))
    empty = files.where(F.col("path").rlike(r"^(spec/index|spec/requirements/[^/]+|tasks/[^/]+)\.md$") & ~F.col("text").rlike(r"(?U)\S"))
    index = files.where("path = 'tasks/index.md'").select("change_id", (F.lower(F.coalesce(field(F.col("text"), "has tasks"), F.lit(""))) == "false").alias("without"))
    task_files = has(r"^tasks/TASK-[^/]*\.md$")
    parts = [
        lacks(r"^spec/index\.md$", "spec/index.md"), lacks(r"^spec/requirements/", "spec/requirements"), lacks(r"^tasks/index\.md$", "tasks/index.md"), issue(empty, "EMPTY", F.col("path")),
        issue(reqs.where(~F.col("text").contains(ACCEPTANCE_HEADING)), "NO_ACCEPTANCE", F.col("path")), issue(reqs.where(~F.col("path").rlike("/REQ-[^/]+$")).where(~headings_of(F.col("text")).rlike(r"REQ-[A-Za-z0-9_-]")), "NO_REQUIREMENT_ID", F.col("path")),
        issue(index.where("without").join(task_files, "change_id", "left_semi"), "TASKS_DECLARED_ABSENT"), issue(changes.join(index.where("without"), "change_id", "left_anti").join(task_files, "change_id", "left_anti"), "NO_TASKS"),
    ]
    return reduce(DataFrame.unionByName, parts)


def issues(req: DataFrame, task: DataFrame, matrix: DataFrame, evidence: DataFrame) -> DataFrame:
    """(change_id, code, message) of all rules over the parsed tables."""
    low = lambda c: F.lower(F.col(c))
    blank = lambda c: T.trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    refs = lambda df, c: df.select("change_id", "id", F.explode(c).alias("ref"))
    req_ids, task_ids = req.select("change_id", F.col("id").alias("ref")), task.select("change_id", F.col("id").alias("ref"))
    acceptance = refs(req, "acceptance_ids")
    req_deps, task_deps = refs(req, "dependencies"), refs(task, "dependencies")
    must = req.where(low("priority") == "must").select("change_id", F.col("id").alias("ref"))
    pairs = task.select("change_id", "id", F.explode("requirement_refs").alias("requirement"), "acceptance_refs").select("change_id", "id", "requirement", F.explode("acceptance_refs").alias("acceptance"))
    known_pairs = acceptance.select("change_id", F.col("id").alias("requirement"), F.col("ref").alias("acceptance"))
    declared = pairs.join(known_pairs, ["change_id", "requirement", "acceptance"], "left_semi").withColumnRenamed("id", "task")
    row = ["change_id", "requirement", "acceptance", "task"]
    parts = [
        issue(req.where(~low("priority").isin(*PRIORITIES)), "BAD_PRIORITY", F.col("id")), issue(req.where(~low("status").isin(*REQUIREMENT_STATES)), "BAD_STATUS", F.col("id")), repeated(req, "id"), repeated(task, "id"), repeated(evidence, "evidence_id"),
        repeated(acceptance.select("change_id", F.col("ref").alias("acceptance_id")), "acceptance_id"), issue(req.where((low("priority") == "must") & (F.size("acceptance_ids") == 0)), "SDD_REQUIREMENT_UNCOVERED", F.col("id")),
        issue(req_deps.where("id = ref"), "SELF_DEPENDENCY", F.col("id")), issue(missing(req_deps, req_ids), "UNKNOWN_REQUIREMENT", F.col("id"), F.col("ref")), cycles(req_deps, "REQUIREMENT_CYCLE"),
        issue(task.where(F.size("requirement_refs") == 0), "NO_REQUIREMENT_REFS", F.col("id")), issue(task.where(~F.col("has_definition")), "NO_DEFINITION", F.col("id")), issue(task.where(~low("status").isin(*TASK_STATES)), "BAD_STATUS", F.col("id")),
        issue(task.where(~low("priority").isin(*PRIORITIES)), "BAD_PRIORITY", F.col("id")), issue(task.where(~low("task_type").isin(*TASK_TYPES)), "BAD_TYPE", F.col("id")), issue(task.where((low("status") == "blocked") & blank("blocked_reason")), "NO_BLOCKED_REASON", F.col("id")),
        issue(task.where((low("status") == "blocked") & blank("unblock_condition")), "NO_UNBLOCK_CONDITION", F.col("id")), issue(task.where((low("status") == "dropped") & blank("dropped_reason")), "NO_DROPPED_REASON", F.col("id")),
        issue(refs(task.where(low("priority") != "must"), "requirement_refs").join(must, ["change_id", "ref"], "left_semi"), "WEAK_COVER", F.col("id"), F.col("ref")), issue(missing(refs(task, "requirement_refs"), req_ids), "UNKNOWN_REQUIREMENT", F.col("id"), F.col("ref")),
        issue(missing(refs(task, "acceptance_refs"), acceptance.select("change_id", "ref")), "UNKNOWN_ACCEPTANCE", F.col("id"), F.col("ref")), issue(task_deps.where("id = ref"), "SDD_TASK_SELF_DEPENDENCY", F.col("id")),
        issue(missing(task_deps.where("id <> ref"), task_ids), "SDD_UNKNOWN_TASK_REFERENCE", F.col("id"), F.col("ref")), cycles(task_deps, "SDD_TASK_DEPENDENCY_CYCLE"), coverage_gaps(req, task, matrix),
        issue(matrix.join(task_ids.select("change_id", F.col("ref").alias("task")), ["change_id", "task"], "left_anti"), "MATRIX_UNKNOWN_TASK", F.col("task")), issue(matrix.join(known_pairs, ["change_id", "requirement", "acceptance"], "left_anti"), "MATRIX_UNKNOWN", F.col("requirement"), F.col("acceptance")),
        issue(matrix.join(pairs.withColumnRenamed("id", "task"), row, "left_anti").join(task_ids.select("change_id", F.col("ref").alias("task")), ["change_id", "task"], "left_semi"), "MATRIX_MISMATCH", F.col("task"), F.col("requirement"), F.col("acceptance")), issue(declared.join(matrix, row, "left_anti"), "NOT_DECLARED", F.col("task"), F.col("acceptance")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def unfinished(task: DataFrame) -> DataFrame:
    return task.where(~F.lower("status").isin("done", "dropped")).select("change_id", "id", "status")


def passes(word: str | None) -> bool:
    """pass and passed say the same, in any case."""
    return (word or "").lower() in ("pass", "passed")


def check_counts(result: dict) -> dict[str, int]:
    """How many checks passed, and how many did not."""
    checks = result.get("checks") or []
    passed = sum(passes(c.get("status")) for c in checks)
    return {"checks": len(checks), "passed": passed, "failed": len(checks) - passed}


def evidence_issues(result: dict, structure: dict) -> list[str]:
    """Problems of a verification input (schema, vocabularies, references, coverage); small, on the driver.

    structure: requirements (id, priority, acceptance_ids), tasks (id, priority, status) and evidence ids of the change.
    """
    out: list[str] = []
    if result.get("schemaVersion") != 1:
        out.append("schemaVersion must be 1")
    if str(result.get("result")).lower() not in ("pass", "passed", "fail", "failed"):
        out.append("result must be pass or fail")
    checks, wants_pass = result.get("checks") or [], passes(result.get("result"))
    if not checks:
        out.append("at least one check is needed")
    tasks_ = {t["id"]: t for t in structure["tasks"]}
    known = {
        "requirementRefs": {r["id"] for r in structure["requirements"]}, "acceptanceRefs": {x for r in structure["requirements"] for x in r["acceptance_ids"]},
        "taskRefs": set(tasks_), "evidenceRefs": set(structure["evidence"]),
    }
    # the states of tasks when the evidence was taken must be those of now
    snapshots = {t.get("id"): t for t in result.get("tasks") or []}
    for name, t in tasks_.items():
        if name not in snapshots:
            out.append(f"no state of {name} in the evidence")
        elif str(snapshots[name].get("status")).lower() != t["status"].lower():
            out.append(f"{name} was {snapshots[name].get('status')} in the evidence and is {t['status']}")
    for name, t in snapshots.items():
        if name not in tasks_:
            out.append(f"the evidence has a state of an unknown {name}")
        out += [f"{name}: unknown {r}" for r in t.get("evidenceRefs") or [] if r not in known["evidenceRefs"]]
    seen: set[str] = set()
    for c in checks:
        label = c.get("id") or c.get("name")
        if str(c.get("status")).lower() not in ("pass", "passed", "fail", "failed", "blocked"):
            out.append(f"check {label}: bad status")
        if c.get("id") in seen:
            out.append(f"SDD_DUPLICATE_ID: {c['id']}")
        seen |= {c["id"]} if c.get("id") else set()
        out += [f"check {label}: no {key}" for key in ("acceptanceRefs", *(["taskRefs"] if tasks_ else [])) if not c.get(key)]
        out += [f"check {label}: unknown {r}" for key, own in known.items() for r in c.get(key) or [] if r not in own]
    if wants_pass:
        if any(not passes(c.get("status")) for c in checks):
            out.append("SDD_VERIFICATION_RESULT_MISMATCH: a passing result needs every check passed")
        checked = {key: {r for c in checks for r in c.get(key) or []} for key in ("acceptanceRefs", "taskRefs")}
        out += [f"no check of {x}" for r in structure["requirements"] if r["priority"].lower() == "must" for x in r["acceptance_ids"] if x not in checked["acceptanceRefs"]]
        out += [f"no check of {t['id']}" for t in tasks_.values() if t["priority"].lower() == "must" and t["status"].lower() != "dropped" and t["id"] not in checked["taskRefs"]]
    return out


# -- lifecycle: thin functions of the driver -------------------------------------------------------


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    staged = path.with_name(path.name + ".new")
    staged.write_text(text, encoding="utf-8")
    os.replace(staged, path)


def front_matter(text: str) -> dict[str, str]:
    """Flat ``key: value`` pairs between the two marks at the start."""
    m = re.match(r"---\n(.*?)\n---", text, re.S)
    if not m:
        raise ValueError("no front matter")
    pairs = (line.split(":", 1) for line in m[1].splitlines() if ":" in line)
    return {k.strip(): json.loads(v) if v.strip().startswith('"') else v.strip() for k, v in pairs}


def _save(folder: Path, meta: dict) -> None:
    body = "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False) if isinstance(v, str) else v}" for k, v in meta.items())
    _write(folder / "change.md", f"---\n{body}\n---\n\n# {meta['title']}\n")


def new_change(root: str, title: str) -> dict:
    title = title.strip()
    if not title:
        raise ValueError("SDD_INVALID_TITLE: the title must not be empty")
    base = Path(root) / "sdd" / "changes"
    slug = "-".join(re.findall("[a-z0-9]+", title.lower().encode("ascii", "replace").decode().replace("?", "-"))) or "change"
    stem = f"{datetime.now(UTC):%Y%m%d}-{slug}-{hashlib.sha256(title.encode()).hexdigest()[:8]}"
    used = lambda i: (base / i).exists() or (base.parent / "archives" / i).exists()
    name = next(i for n in range(1, 10_000) if not used(i := stem if n == 1 else f"{stem}-{n}"))
    meta = {"sdd_version": 1, "change_id": name, "title": title, "status": "draft", "phase": "spec", "created_at": _now(), "updated_at": _now()}
    _save(base / name, meta)
    return {"schemaVersion": VERSION, "command": "sdd.new", "change": meta}


def list_changes(root: str, archived: bool = False) -> list[dict]:
    places = ["changes", *(["archives"] if archived else [])]
    found = [front_matter(f.read_text(encoding="utf-8")) | {"path": str(f.parent)} for p in places for f in (Path(root) / "sdd" / p).glob("*/change.md")]
    return sorted(found, key=lambda m: (m["change_id"], m["path"]))


def fingerprint(folder: Path) -> str:
    """SHA-256 over the sorted files of spec/ and tasks/: name, zero byte, content, zero byte."""
    h = hashlib.sha256()
    files = sorted((str(f.relative_to(folder)).replace(os.sep, "/"), f) for d in ("spec", "tasks") for f in (folder / d).rglob("*") if f.is_file())
    for name, f in files:
        h.update(name.encode() + b"\0" + f.read_bytes() + b"\0")
    return h.hexdigest()


def files_of(spark: SparkSession, folder: Path, change: str) -> DataFrame:
    rows = [(change, str(f.relative_to(folder)).replace(os.sep, "/"), f.read_text(encoding="utf-8", errors="replace")) for f in sorted(folder.rglob("*.md"))]
    return spark.createDataFrame(pa.table({c: [r[k] for r in rows] for k, c in enumerate(("change_id", "path", "text"))}) if rows else [], "change_id string, path string, text string")


def verify(spark: SparkSession, root: str, change: str, result: dict | None = None) -> dict:
    """Checks a change, writes verify.md, and sets its status to verified or needs_fix."""
    folder = Path(root) / "sdd" / "changes" / change
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", change) or not folder.is_dir():
        raise LookupError(f"SDD_CHANGE_NOT_FOUND: {change}")
    files = files_of(spark, folder, change)
    req, task, matrix, evidence = requirements(files), tasks(files), coverage(files), evidence_ids(files)
    found = [f"{r['code']}: {r['message']}" for r in structure_issues(files).unionByName(issues(req, task, matrix, evidence)).orderBy("code", "message").collect()]
    found += [f"UNFINISHED: {r['id']}" for r in unfinished(task).orderBy("id").collect()]
    if result is not None:
        own = {"requirements": [r.asDict() for r in req.collect()], "tasks": [r.asDict() for r in task.collect()], "evidence": [r["evidence_id"] for r in evidence.collect()]}
        found += evidence_issues(result, own)
        found += [] if passes(result.get("result")) or found else ["the evidence asks for a failure"]
    status = "needs_fix" if found else "verified"
    meta = front_matter((folder / "change.md").read_text(encoding="utf-8"))
    meta |= {"status": status, "phase": "verify", "updated_at": _now()} | ({"verified_fingerprint": fingerprint(folder)} if not found else {})
    _save(folder, meta)
    lines = [f"# Verification of {change}", "", f"Status: {status}", *([f"Requested: {result.get('result')}"] if result else []), "", *(f"- {i}" for i in found)]
    counts = check_counts(result) if result is not None else {}
    if result is not None:
        lines += ["", "## Checks", "", f"{counts['passed']} of {counts['checks']} passed", "", *(f"- {c.get('id') or c.get('name')}: {c.get('status')}" for c in result.get("checks") or [])]
    _write(folder / "verify.md", "\n".join(lines) + "\n")
    return {"schemaVersion": VERSION, "command": "sdd.verify", "status": status, "issues": found} | counts


def archive(root: str, change: str) -> dict:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", change):
        raise LookupError(f"SDD_CHANGE_NOT_FOUND: {change}")
    source, target = Path(root) / "sdd" / "changes" / change, Path(root) / "sdd" / "archives" / change
    if target.exists() and not source.exists():
        return {"schemaVersion": VERSION, "command": "sdd.archive", "status": "archived"}
    meta = front_matter((source / "change.md").read_text(encoding="utf-8"))
    if meta["status"] != "verified" or not meta.get("verified_fingerprint"):
        raise ValueError("SDD_NOT_VERIFIED: verify the change first")
    if meta["verified_fingerprint"] != fingerprint(source):
        raise ValueError("SDD_STALE: the change was edited after its verification")
    if target.exists():
        raise ValueError("SDD_ARCHIVE_EXISTS")
    _save(source, meta | {"status": "archived", "phase": "archive", "updated_at": _now()})
    target.parent.mkdir(parents=True, exist_ok=True)
    os.replace(source, target)
    return {"schemaVersion": VERSION, "command": "sdd.archive", "status": "archived"}
