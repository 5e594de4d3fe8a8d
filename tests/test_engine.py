"""Trees, the index and what stands on it."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from folioscope import cli, config, seed
from folioscope.functions import text as T
from folioscope.functions.embedding import cosine
from folioscope.operators import answer, fts, graph, index, overview, rag, spec
from folioscope.plans.tables import written
from folioscope.sources import tree
from folioscope.streaming import refresh

FILES = {
    "notes/service.md": "# Cache service\n\nThe cache service uses `Cache_Key` values.\n\nSee [[ideas/guide|guide]] and [[missing/page]].\n",
    "ideas/guide.md": "# Guide\n\nSteps for operators. [[projects/related#top]]\n",
    "projects/related.md": "# Related\n\nAlso `Cache_Key` and `Other_Id`.\n\n```\n[[fenced]]\n```\n`[[inline]]`\n",
    "AGENTS.md": "# Agents\n\nservice rules\n", "log.md": "# Log\n\n## [1] a\nx\n## [2] b\ny\n## [3] c\nz\n", "_draft.md": "# Draft\n\n[[notes/service.md]]\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    df = spark.createDataFrame([(k, v.encode(), 1) for k, v in FILES.items()], tree.SCHEMA)
    return {k: written(v, k) for k, v in index.build(tree.pages(df)).items()}


def test_tree_source(spark, root):
    (root / ".wiki").mkdir()
    (root / ".wiki/in.md").write_text("x")
    (root / "target/deep").mkdir(parents=True)
    (root / "target/deep/no.md").write_text("x")
    (root / ".github").mkdir()
    (root / ".github/UP.MD").write_bytes(b"\xff\xfe bad")
    (root / "empty.md").write_text("")
    got = {r.path: r for r in tree.pages(tree.read_tree(spark, str(root))).collect()}
    assert set(got) == {*FILES, ".github/UP.MD", "empty.md"} and "�" in got[".github/UP.MD"].text and got["empty.md"].title == "empty"
    searched = {r.path for r in tree.read_tree(spark, str(root), "search").collect()}
    assert searched == {*FILES, ".wiki/in.md", "empty.md"}
    with pytest.raises(Exception, match="directory"):
        tree.read_tree(spark, str(root / "none")).collect()


def test_refresh_is_incremental_and_equals_a_rebuild(spark, root, tmp_path):
    store = index.Index(spark, str(tmp_path / "store"))
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.tables()
    read = lambda: tree.pages(tree.read_tree(spark, str(root)))
    pick = lambda c: (c["added"], c["updated"], c["unchanged"], c["removed"])
    assert pick(store.refresh(read())) == (6, 0, 0, 0)
    assert pick(store.refresh(read())) == (0, 0, 6, 0)
    (root / "ideas/guide.md").write_text("# Guide\n\nNew text with `New_Name`. [[notes/service]]\n", encoding="utf-8")
    (root / "_draft.md").unlink()
    (root / "new.md").write_text("# New\n")
    assert pick(store.refresh(read())) == (1, 1, 4, 1)
    drop = {"documents": ["indexed_at"]}
    rows = lambda t: {k: sorted(map(str, v.drop(*drop.get(k, [])).select(*sorted(c for c in v.columns if c not in drop.get(k, []))).collect())) for k, v in t.items()}
    now = rows(store.tables())
    assert now == rows(index.build(read()))
    assert store.refresh(read(), chunk_chars=40)["added"] == 6 and store.refresh(read(), rebuild=True)["removed"] == 6


def test_links_and_graph(spark, built):
    pages, links = built["documents"], built["wiki_links"]
    assert {(r.target_path, r.link_text) for r in links.collect()} == {("ideas/guide", "guide"), ("missing/page", None), ("projects/related#top", None), ("notes/service", None)}
    edges = written(graph.edges(pages, links), "edges")
    assert graph.stats(pages, links).first().asDict() == {"nodes": 6, "links": 4, "distinct_edges": 4, "resolved": 3, "dangling": 1}
    steps = graph.shortest_path(edges, "_draft", "projects/related", 4)
    assert [(s["source"], s["target"]) for s in steps] == [("_draft", "notes/service"), ("notes/service", "ideas/guide"), ("ideas/guide", "projects/related")]
    assert graph.shortest_path(edges, "projects/related", "_draft", 4) is None and graph.shortest_path(edges, "_draft", "projects/related", 2) is None
    near = {(r.depth, r.direction, r.source, r.target) for r in graph.neighbors(edges, "ideas/guide", 2).collect()}
    assert (1, "incoming", "notes/service", "ideas/guide") in near and (2, "outgoing", "notes/service", "missing/page") in near and (2, "incoming", "_draft", "notes/service") in near
    assert graph.resolve(pages, "cache SERVICE") == "notes/service" and graph.resolve(pages, "./ideas/guide.md") == "ideas/guide"
    with pytest.raises(LookupError):
        graph.resolve(pages, "nothing")
    nodes, out = graph.export(pages, links)
    dot = graph.dot([r.asDict() for r in nodes.collect()], [r.asDict() for r in out.collect()])
    assert '"missing/page" [style=dashed]' in dot and 'label="guide"' in dot
    # the retrieval rule keeps anchors, so that link dangles
    assert graph.retrieval_edges(pages, links).count() == 2


def test_entity_list_without_a_limit(spark, monkeypatch):
    from folioscope.plans import queries

    rows = [(f"e{k:04}", f"Name_{k}", "identifier", 1.0) for k in range(700)]
    entities = spark.createDataFrame(rows, "id string, canonical_name string, entity_type string, confidence double")
    mentions = spark.createDataFrame([(r[0],) for r in rows] + [("e0650",)], "entity_id string")
    every = graph.entity_list(entities, mentions, limit=None).collect()
    assert len(every) == 700 and (every[0].id, every[0].mentions) == ("e0650", 2)
    assert graph.entity_list(entities, mentions, limit=900).count() == 500 and graph.entity_list(entities, mentions).count() == 50
    monkeypatch.setattr(queries, "mentions_of", lambda *_: mentions)
    monkeypatch.setattr(queries.index, "entities", lambda _: entities)
    assert queries.entities(spark, "").count() == 700


def test_entities_and_neighbours(spark, built):
    listed = graph.entity_list(built["entities"], built["entity_mentions"], "cache").collect()
    assert [(r.canonical_name, r.mentions) for r in listed] == [("Cache_Key", 2)]
    one = spark.createDataFrame([(graph.resolve_entity(built["entities"], "cache_key"),)], "id string")
    rows = graph.entity_neighbors(built["relations"], built["relation_evidence"], built["entities"], one).collect()
    assert [r.neighbor_name for r in rows] == ["Other_Id"] and len(rows[0].evidence) == 1
    gone, nameless = index.orphans(built["relations"], built["relation_evidence"], built["entities"], built["entity_mentions"])
    assert gone.isEmpty() and nameless.isEmpty()


def test_cycles(spark):
    df = lambda rows: spark.createDataFrame(rows, "a string, b string")
    assert graph.has_cycle(df([("a", "b"), ("b", "c"), ("c", "a")])) and not graph.has_cycle(df([("a", "b"), ("b", "c"), ("a", "c")]))


def test_full_text_equals_sqlite(spark):
    rows = [("1", "Alpha beta gamma, alpha", "Head alpha"), ("2", "beta-alpha snake_case café", ""), ("3", "城池任务 only", "x"), ("4", "gamma", "alpha beta"), ("5", "nothing", "")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, text, heading_path)")
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", rows)
    posts = written(fts.postings(spark.createDataFrame(rows, "id string, text string, heading_path string")), "posts")
    for query in ("alpha", "alpha beta", "beta-alpha", "snake_case", "cafe", "CAFÉ", "城池", "城池任务", "gamma alpha"):
        q = " AND ".join('"' + w + '"' for w in query.split())
        want = {r[0]: round(r[1], 6) for r in db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (q,))}
        found = fts.fts(posts, query)
        assert {r.chunk_id: round(r.bm25, 6) for r in found.collect()} == want, query
    assert fts.fts(posts, "alpha !!") is None


def test_hybrid_search(spark, built):
    hits = rag.hits_of(rag.search(built, rag.Options("cache service", 8, 2)))
    by_path = {h["path"]: h for h in hits}
    assert hits[0]["path"] == "notes/service.md" and "fts5" in hits[0]["reasons"]
    assert "page-link depth 1" in by_path["ideas/guide.md"]["reasons"] and any(r.startswith("entity-mention: Cache_Key") for r in by_path["projects/related.md"]["reasons"])
    assert by_path["ideas/guide.md"]["score"] == pytest.approx(0.36)
    assert all(h["graph_score"] <= rag.MOST_GRAPH for h in hits)
    assert rag.hits_of(rag.search(built, rag.Options("ervice us", 8, 0)))[0]["reasons"][-1] == "substring"
    terms = rag.hits_of(rag.search(built, rag.Options("How does the operators thing work?", 8, 0)))
    assert terms[0]["reasons"] == ["query-term: operators"]
    assert {h["path"] for h in rag.hits_of(rag.search(built, rag.Options("Cache_.ey|Steps", 8, 0, regex=True)))} == {"notes/service.md", "ideas/guide.md", "projects/related.md"}
    with pytest.raises(ValueError):
        rag.search(built, rag.Options(" "))
    with pytest.raises(ValueError):
        rag.search(built, rag.Options("x", weights=rag.Weights(0, -1, float("nan"))))


def test_vectors_and_their_cache(spark, built):
    every, rows = rag.vectors(built, rag.DEFAULT_EMBEDDING)
    cache = written(rows, "vectors")
    assert cache.count() == built["chunks"].count() == every.count()
    assert rag.vectors(built, rag.DEFAULT_EMBEDDING, cache)[1].isEmpty()
    stale = cache.withColumn("text_hash", F.when(F.col("chunk_id").contains("guide"), F.lit("old")).otherwise(F.col("text_hash")))
    assert rag.vectors(built, rag.DEFAULT_EMBEDDING, stale)[1].count() == 1
    hits = rag.hits_of(rag.search(built, rag.Options("steps operators", 8, 0, embedding=rag.DEFAULT_EMBEDDING), cache))
    assert hits[0]["path"] == "ideas/guide.md" and hits[0]["vector_score"] > 0 and "local-hash:token-ngram-v1" in hits[0]["reasons"]


def test_context_answer_harness(spark, built):
    hits = rag.hits_of(rag.search(built, rag.Options("cache service", 8, 2)))
    c = rag.context("q", hits, 180)
    assert len(c.text) == 180 and c.truncated and c.text.startswith("[1] notes/service.md:1-")
    a = answer.ask(built, "What does the cache service use?", rag.Options(""))
    assert not a.uncertain and a.answer.startswith(answer.DIRECT) and "[1]" in a.answer
    none = answer.ask(built, "xylophone?", rag.Options(""))
    assert none.uncertain and none.answer == answer.NO_EVIDENCE
    related = answer.Extractive().answer("q", rag.Context("q", "", [h | {"provenance": [{"kind": "graph", "source": "x", "score": 1}]} for h in hits], False), 500)
    assert related.uncertain and related.answer.startswith(answer.RELATED)
    seen = {}

    def post(url, body, key, timeout):
        seen.update(url=url, key=key)
        return {"choices": [{"message": {"content": [{"text": "It uses keys"}]}}]}

    m = answer.ChatCompletions("http://x", "m", "k", 900, post).answer("q", rag.context("q", hits), 400)
    assert m.uncertain and "Warning" in m.answer and seen == {"url": "http://x/v1/chat/completions", "key": "k"}
    p = answer.harness(built, "overview", "service", max_chars=400)
    assert not {"AGENTS.md", "log.md"} & {h["path"] for h in p["hits"]} and len(p["overview"]) + len(p["evidence"]) <= 400 and p["version"] == answer.VERSION


def test_overview(spark, root):
    pages = tree.pages(tree.read_tree(spark, str(root), "search"))
    s = overview.summary(pages).first()
    assert (s.pages, s.categories, s.has_agents, s.has_index, s.truncated) == (4, ["ideas", "notes", "projects"], True, False, False)
    assert {r.area: r.pages for r in overview.areas(pages).collect()} == {"notes": 1, "ideas": 1, "projects": 1, "sdd": 0}
    assert [r.body for r in overview.log_tail(pages.where("path = 'log.md'"), 2).orderBy("entry").collect()] == ["## [2] b\ny", "## [3] c\nz"]
    plain = tree.pages_of_table(spark.createDataFrame([("log.md", "a\r\nb\nc\n")], "path string, text string"))
    assert overview.log_tail(plain, 2).first().body == "b\nc"
    assert overview.head(pages, "AGENTS.md", 1).first().asDict() == {"body": "# Agents", "partial": True}
    assert "Pages: 4" in overview.text(pages, 1) and "## [3] c" in overview.text(pages, 1)


def test_stream_refreshes_the_index(spark, tmp_path):
    source, store = tmp_path / "in", index.Index(spark, str(tmp_path / "idx"))
    write = lambda rows: spark.createDataFrame(rows, tree.SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: refresh.refresh_stream(spark.readStream.schema(tree.SCHEMA).parquet(str(source)), str(tmp_path / "versions"), store, str(tmp_path / "cp")).awaitTermination()
    write([("a.md", b"# One", 1), ("b.md", b"# Two", 1)])
    run()
    write([("a.md", b"# Uno", 2)])
    run()
    assert {r.path: r.title for r in store.tables()["documents"].collect()} == {"a.md": "Uno", "b.md": "Two"}


REQ = "# REQ-1 Cache\n\nPriority: must | Status: proposed\n\n## 验收条件\n\n### AC-1\n"
TASK = "# TASK-1 Do\n\n- Status: done\n- Requirement refs: REQ-1\n- Acceptance refs: AC-1\n\n## Completion definition\n"
MATRIX = "# Tasks\n\n| Requirement | Acceptance | Task |\n|---|---|---|\n| REQ-1 | AC-1 | TASK-1 |\n"


def test_specification_lifecycle(spark, tmp_path):
    root = str(tmp_path)
    change = spec.new_change(root, "Add a Cache!")["change"]["change_id"]
    assert spec.new_change(root, "Add a Cache!")["change"]["change_id"] == change + "-2"
    folder = tmp_path / "sdd/changes" / change

    def put(name, text):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")

    first = spec.verify(spark, root, change)
    assert first["status"] == "needs_fix" and "MISSING: spec/index.md" in first["issues"]
    with pytest.raises(ValueError, match="NOT_VERIFIED"):
        spec.archive(root, change)
    for name, text in (("spec/index.md", "# Spec\n"), ("spec/requirements/REQ-1.md", REQ), ("tasks/index.md", MATRIX), ("tasks/TASK-1.md", TASK)):
        put(name, text)
    assert spec.verify(spark, root, change) == {"schemaVersion": spec.VERSION, "command": "sdd.verify", "status": "verified", "issues": []}
    bad = spec.verify(spark, root, change, {"schemaVersion": 1, "result": "pass", "checks": [{"name": "t", "status": "failed", "taskRefs": ["TASK-9"]}]})
    for want in ("unknown TASK-9", "no acceptanceRefs", "RESULT_MISMATCH", "no state of TASK-1", "no check of AC-1", "no check of TASK-1"):
        assert any(want in i for i in bad["issues"]), want
    assert (bad["checks"], bad["passed"], bad["failed"]) == (1, 0, 1) and "0 of 1 passed" in (folder / "verify.md").read_text(encoding="utf-8")
    status = spec.tasks(spec.files_of(spark, folder, change)).first()["status"]
    good = {"schemaVersion": 1, "result": "Passed", "tasks": [{"id": "TASK-1", "status": status.upper()}], "checks": [{"name": "t", "status": "PASS", "acceptanceRefs": sorted(spec.requirements(spec.files_of(spark, folder, change)).first()["acceptance_ids"]), "taskRefs": ["TASK-1"]}]}
    assert spec.verify(spark, root, change, good)["issues"] == []
    with pytest.raises(LookupError, match="NOT_FOUND"):
        spec.archive(root, "../" + change)
    spec.verify(spark, root, change)
    put("tasks/TASK-1.md", TASK + "edit")
    with pytest.raises(ValueError, match="STALE"):
        spec.archive(root, change)
    spec.verify(spark, root, change)
    assert spec.archive(root, change)["status"] == "archived" == spec.archive(root, change)["status"]
    assert [m["status"] for m in spec.list_changes(root, True)] == ["archived", "draft"] or len(spec.list_changes(root, True)) == 2


def test_specification_rules(spark):
    req = spark.createDataFrame([("c", "REQ-1", "must", "proposed", ["AC-1"], ["REQ-1", "REQ-9"]), ("c", "REQ-2", "often", "new", ["AC-1"], []), ("c", "REQ-3", "must", "proposed", [], ["REQ-4"]), ("c", "REQ-4", "may", "dropped", [], ["REQ-3"])], spec.REQUIREMENTS)
    task = spark.createDataFrame([("c", "TASK-1", "may", "blocked", "x", ["REQ-1", "REQ-8"], ["AC-1", "AC-7"], ["TASK-1", "TASK-5"], None, " ", None, False), ("c", "TASK-1", "must", "dropped", "code", [], [], [], None, None, None, True)], spec.TASKS)
    matrix = spark.createDataFrame([("c", "REQ-1", "AC-6", "TASK-1"), ("c", "REQ-1", "AC-1", "TASK-4")], spec.COVERAGE)
    evidence = spark.createDataFrame([("c", "E-1"), ("c", "E-1")], spec.EVIDENCE)
    codes = {(r.code, r.message) for r in spec.issues(req, task, matrix, evidence).collect()}
    for want in [("BAD_PRIORITY", "REQ-2"), ("BAD_STATUS", "REQ-2"), ("SDD_DUPLICATE_ID", "TASK-1"), ("SDD_DUPLICATE_ID", "AC-1"), ("SDD_DUPLICATE_ID", "E-1"), ("SDD_REQUIREMENT_UNCOVERED", "REQ-3"), ("SELF_DEPENDENCY", "REQ-1"), ("UNKNOWN_REQUIREMENT", "REQ-1 REQ-9"), ("REQUIREMENT_CYCLE", ""), ("NO_DEFINITION", "TASK-1"), ("BAD_TYPE", "TASK-1"), ("NO_BLOCKED_REASON", "TASK-1"), ("NO_UNBLOCK_CONDITION", "TASK-1"), ("NO_DROPPED_REASON", "TASK-1"), ("NO_REQUIREMENT_REFS", "TASK-1"), ("WEAK_COVER", "TASK-1 REQ-1"), ("UNKNOWN_REQUIREMENT", "TASK-1 REQ-8"), ("UNKNOWN_ACCEPTANCE", "TASK-1 AC-7"), ("SDD_TASK_SELF_DEPENDENCY", "TASK-1"), ("SDD_UNKNOWN_TASK_REFERENCE", "TASK-1 TASK-5"), ("MATRIX_UNKNOWN_TASK", "TASK-4"), ("MATRIX_UNKNOWN", "REQ-1 AC-6"), ("MATRIX_MISMATCH", "TASK-1 REQ-1 AC-6"), ("NOT_DECLARED", "TASK-1 AC-1")]:
        assert want in codes, want


def test_commands(spark, root, capsys, monkeypatch):
    do = lambda *a: cli.run(cli.parser().parse_args(["--path", str(root), *a]), spark)
    assert "added: 6" in do("index") and "unchanged: 6" in do("index")
    assert json.loads(do("graph", "stats"))["dangling"] == 1 and json.loads(do("graph", "neighbors", "Guide"))[0]["depth"] == 1
    assert len(json.loads(do("graph", "path", "_draft", "Guide"))) == 2 and do("graph", "export", "--format", "dot").startswith("digraph")
    assert json.loads(do("graph", "entities", "--type", "identifier"))[0]["canonical_name"] == "Cache_Key" and json.loads(do("graph", "entity-neighbors", "Cache_Key"))
    assert "notes/service.md" in {h["path"] for h in json.loads(do("rag", "search", "-q", "cache", "--limit", "3", "--format", "json"))}
    assert "Evidence:" in do("rag", "context", "-q", "cache", "--format", "prompt") and "[1]" in do("rag", "ask", "-q", "cache service")
    assert json.loads(do("harness", "-q", "cache", "--format", "json"))["version"] == answer.VERSION
    assert "notes/service.md" in do("search", "cache service") and do("search", "cache", "--mode", "files") == "notes/service.md\nprojects/related.md"
    assert "notes/service.md:3: " in do("search", "uses", "--mode", "content", "--category", "notes") and "Pages: 4" in do("read")
    assert "create: index.md" in do("init", "--dir", str(root / "kb")) and "keep: index.md" in do("init", "--dir", str(root / "kb"))
    monkeypatch.setattr(cli, "run", lambda a: (_ for _ in ()).throw(LookupError("no such page")))
    assert cli.main(["read"]) == 1 and "no such page" in capsys.readouterr().err


def test_config_and_seed(tmp_path):
    assert config.load(str(tmp_path / "none")) == config.Config(endpoint=os.environ.get("OPENAI_BASE_URL"), model=os.environ.get("OPENAI_MODEL"), api_key=os.environ.get("OPENAI_API_KEY"))
    (tmp_path / "folioscope.yaml").write_text('ask:\n  provider: openai\n  timeout: 5\nrag:\n  embedding: "local-hash"\n')
    c = config.load(str(tmp_path / "folioscope.yaml"))
    assert (c.answer_provider, c.timeout, c.embedding) == ("openai", 5.0, "local-hash")
    with pytest.raises(ValueError, match="line 1"):
        config.parse("- x")
    steps = seed.plan(str(tmp_path / "kb"))
    assert seed.commit(str(tmp_path / "kb"), steps) == 4 and seed.commit(str(tmp_path / "kb"), seed.plan(str(tmp_path / "kb"))) == 0
    assert {s.action for s in seed.plan(str(tmp_path / "kb"), force=True) if s.content} == {"overwrite"}


def test_category_must_be_below_the_root(spark, root):
    from folioscope.operators import search

    with pytest.raises(ValueError):
        search.searchable(tree.pages(tree.read_tree(spark, str(root))), "../x")
    assert T.Matcher("a b").tokens == ["a", "b"]


def test_commands_report_errors_and_counts(spark, root, tmp_path, capsys):
    do = lambda *a: cli.run(cli.parser().parse_args([*a]), spark)
    assert "4 documents to write, 0 to keep" in do("init", "--dir", str(tmp_path / "new"), "--dry-run")
    do("index", "--path", str(root))
    with pytest.raises(ValueError, match="invalid regular expression"):
        do("search", "[", "--regex", "--path", str(root))
    package = json.loads(do("harness", "-q", "cache", "--embedding", "local-hash", "--vector-weight", "0.5", "--format", "json", "--path", str(root)))
    assert package["version"] == answer.VERSION
    own = index.Index(spark, f"{root}/{cli.INDEX}")
    n = own.vectors().count()
    assert n > 0
    do("rag", "search", "-q", "cache", "--limit", "3", "--embedding", "local-hash", "--path", str(root))
    assert own.vectors().count() == n
    (tmp_path / "plain" / "sub").mkdir(parents=True)
    (tmp_path / "plain" / "sub" / "page.md").write_text("# Page\n", encoding="utf-8")
    with pytest.raises(LookupError, match="no-strict"):
        do("--path", str(tmp_path / "plain"), "read")
    assert "Pages: 1" in do("--path", str(tmp_path / "plain"), "read", "--no-strict")


def test_finite_vectors_and_newest_of_equals(spark):
    inf, nan = float("inf"), float("nan")
    rows = [([inf, 1.0], [1.0, 1.0]), ([nan, 1.0], [1.0, 1.0]), ([None, 1.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [None] * 3 and abs(got[3] - 1) < 1e-9
    pages = spark.createDataFrame([(p, 5, "t") for p in ("notes/b.md", "notes/a.md", "ideas/z.md")], "path string, modified_at long, text string")
    assert overview.summary(pages).first()["newest"] == overview.newest_page(pages).first()["path"] == "ideas/z.md"


def test_vectors_of_rewrites_are_stored_once(spark, root, tmp_path):
    """A question of several rewrites on a fresh index stores a row for each chunk, and no later search loses a hit."""
    own = index.Index(spark, str(tmp_path / "idx"))
    own.refresh(tree.pages(tree.read_tree(spark, str(root))))
    tables = own.tables()
    n = tables["chunks"].count()
    answer.ask(tables, "xylophone quartz zeppelin", rag.Options("", embedding=rag.DEFAULT_EMBEDDING, depth=0), cache=own.vectors(), keep=own.keep_vectors)
    assert own.vectors().count() == n
    _, fresh = rag.vectors(tables, rag.DEFAULT_EMBEDDING)
    fresh.write.mode("append").parquet(f"{own.folder}/vectors")  # as a search at the same time would
    own.keep_vectors(fresh)
    assert own.vectors().count() == 2 * n
    every, missing = rag.vectors(tables, rag.DEFAULT_EMBEDDING, own.vectors())
    assert missing.isEmpty() and every.count() == n == rag.vector_signals(every, rag.DEFAULT_EMBEDDING.embed("cache"), "x", n).select("chunk_id").distinct().count()


def test_circles_of_all_groups_at_once(spark):
    ways = {"line": ["ab", "bc", "cd"], "ring": ["ab", "bc", "ca", "da", "ae", "ef"], "self": ["aa", "ab"], "two": ["ab", "ba", "bc", "cd", "dc"], "twice": ["ab", "ab"], "long": [f"{chr(97 + k)}{chr(98 + k)}" for k in range(9)] + ["ja"]}
    edges = spark.createDataFrame([(g, e[0], e[1]) for g, es in ways.items() for e in es] + [("none", None, "a"), ("none", "a", None)], "g string, a string, b string")
    assert {r.g for r in graph.cyclic(edges, "g").collect()} == {"ring", "two", "long"}
    assert graph.cyclic(edges.where("false"), "g").collect() == []
    assert graph.has_cycle(edges.where("g = 'ring'")) and not graph.has_cycle(edges.where("g = 'line'"))


def test_text_forms(spark, root):
    from folioscope.operators import report

    do = lambda *a: cli.run(cli.parser().parse_args(["--path", str(root), *a]), spark)
    do("index")
    said = do("search", "cache service")
    assert said.startswith('Search for "cache service" (all of 2 words in any order, the phrase first: cache, service)') and "## notes/service.md (notes)" in said and said.endswith("all matching pages are shown\n")
    assert "more than 1 pages match" in do("search", "cache", "--head", "1") and "1 page, " in do("search", "cache", "--head", "1") and "no page matches" in do("search", "zzzz")
    assert "(literal, case as given)" in do("search", "cache", "--case-sensitive") and "(regular expression, any case)" in do("search", "c.che", "--regex")
    content = do("search", "uses", "--mode", "content")
    assert "\nnotes/service.md\nnotes/service.md:" in content and "no line matches" in do("search", "zzzz", "--mode", "content")
    assert do("search", "cache", "--most-pages", "1", "--mode", "files") in ("", "notes/service.md")
    stats = json.loads(do("graph", "stats"))
    assert f"to no page: {stats['dangling']}\n" in do("graph", "stats", "--format", "text")
    near = do("graph", "neighbors", "Guide", "--format", "text")
    assert near.startswith("Around ") and "1 incoming: " in near
    assert "2 steps" in do("graph", "path", "_draft", "Guide", "--format", "text")
    assert report.path("a", "a", []) == "From a to a: the same page\n" and report.path("a", "b", None).endswith("no way over links\n")
    assert "Cache_Key (identifier): " in do("graph", "entities", "--format", "text") and " in " in do("graph", "entity-neighbors", "Cache_Key", "--format", "text")
    assert report.neighbors("x", 1, "in", []) == "Around x, 1 step, direction in\nno links\n" and report.entities([]) == "no entities\n"


def test_export_is_written_by_the_tasks(spark, tmp_path):
    pages = spark.createDataFrame([("doc:a.md", "a.md", 'A "one"'), ("doc:b.md", "b.md", "B\\")], "id string, path string, title string")
    links = spark.createDataFrame([("doc:a.md", "b", "next"), ("doc:a.md", "none", None), ("doc:b.md", "a", "")], "source_document_id string, target_path string, link_text string")
    nodes, edges = graph.export(pages, links)
    want = graph.dot([r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()])
    assert "\n".join(r.line for r in graph.dot_lines(pages, links).collect()) + "\n" == want
    graph.write_export(pages, links, str(tmp_path / "dot"), "dot")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "dot")).collect()) == sorted(want.splitlines())
    graph.write_export(pages, links, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json/nodes")).count() == 2 and spark.read.json(str(tmp_path / "json/edges")).count() == 3


def test_vectors_of_all_chunks_unless_bounded(spark):
    rows = spark.createDataFrame([(f"c{k}", [1.0, float(k)]) for k in range(9)], "chunk_id string, vector array<float>")
    assert rag.Options("q").most_vectors is None
    assert rag.vector_signals(rows, [0.0, 1.0], "own", 1).first()["chunk_id"] == "c8"
    assert rag.vector_signals(rows, [0.0, 1.0], "own", 1, 3).first()["chunk_id"] == "c2"


def test_answers_name_their_sources():
    one = {"index": 1, "path": "notes/a.md", "title": "A", "heading_path": "", "start_line": 3, "end_line": 9, "score": 1.0, "reasons": [], "quote": "q"}
    a = answer.Answer("q", "extractive", "It is so [1].\n", [one], True, False, True)
    assert answer.answer_text(a) == "It is so [1].\n\n(uncertain)\n\nSources:\n[1] notes/a.md:3-9 A\n\n(cut to the budget)"
    assert answer.answer_text(answer.Answer("q", "extractive", "No.", [], False, False, False)) == "No."


def test_specification_fields_read_few_lines(spark):
    """What fields and headings give is that of the whole text, and the patterns are not run over prose."""
    odd = ["# REQ-1 x\r\n- Priority: must | Status: new\r\n", "prose\n" * 500 + "status：a\rb", "｜status: x\r", "ſtatus: long", "\n \n-- PRIORITY : p\r\r\nstatus: s\r\r", "status\n: no", "  # AC-2 late\rPriority: q", "", None, "a: b\nhttp://status: u | priority: v", "priority: x\n# ACC-3\r"]
    rows = spark.createDataFrame(list(enumerate(odd)), "k int, text string").withColumn("short", spec.narrowed(F.col("text"), "priority", "status"))
    of = lambda c: [spec.field(F.col(c), "priority"), spec.field(F.col(c), "status"), spec.headings_of(F.col(c))]
    got = rows.select("k", F.array(*of("text")).alias("whole"), F.array(*of("short")).alias("short"), F.char_length("short").alias("n")).collect()
    for r in got:
        assert r["whole"] == r["short"], odd[r["k"]]
    assert [r["n"] for r in got if r["k"] == 1] == [len("status：a\rb")]


def test_links_are_not_broadcast(spark):
    """Neither links nor names of pages are sent through the driver, however small their files are."""
    pages = spark.createDataFrame([(f"doc:{k}.md", f"{k}.md", f"t{k}") for k in range(4)], "id string, path string, title string")
    links = spark.createDataFrame([("doc:0.md", "1"), ("doc:1.md", "2"), ("doc:2.md", "2"), ("doc:3.md", "9")], "source_document_id string, target_path string")
    found = graph.retrieval_edges(written(pages, "pages"), written(links, "links"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("doc:0.md", "doc:1.md"), ("doc:1.md", "doc:2.md")]


def test_scores_by_known_lengths(spark):
    """With all lengths given, the rows of a query's terms are enough, and the scores are the same."""
    chunks = spark.createDataFrame([("a", "red fox and red hen", "H"), ("b", "fox", ""), ("c", "hen hen fox red", "Fox"), ("d", "", "")], "id string, text string, heading_path string")
    posts = fts.postings(chunks)
    for q in ("red", "red fox", "fox-and hen", "none"):
        few = posts.where(F.col("term").isin(fts.query_tokens(q)))
        assert sorted(map(tuple, fts.fts(few, q, fts.lengths(posts)).collect())) == sorted(map(tuple, fts.fts(posts, q).collect()))
