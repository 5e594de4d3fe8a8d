"""The index on disk: refreshes by buckets, counted support, full text in segments, upgrades, expiry."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import fts, index, inverted, rag
from folioscope.operators.store import bucket_of
from folioscope.plans.tables import written
from folioscope.sources import tree

WORDS = ["cache", "service", "`Cache_Key`", "`Other_Id`", "`Third_Name`", "fn handler_1()", "src/m_1.rs", "[[notes/p1]]", "[[ideas/p2|two]]", "alpha beta", "城池", "\n\n## Part\n\n"]


def page(k, rng):
    return f"# Page {k}\n\n" + " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 60))) + "\n"


def pages_of(spark, texts):
    return tree.pages(spark.createDataFrame([(p, t.encode(), 1) for p, t in texts.items()], tree.SCHEMA))


def contents(tables, without=("documents.indexed_at",)):
    out = {}
    for name, df in tables.items():
        columns = sorted(c for c in df.columns if f"{name}.{c}" not in without)
        out[name] = sorted(map(str, df.select(*columns).collect()))
    return out


def size_of(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def scores(tables, query):
    stored, posts = tables.inverted.fts(query), fts.fts(tables["postings"], query)
    if stored is None or posts is None:
        assert stored is None and posts is None
        return None
    got = {r.chunk_id: round(r.bm25, 6) for r in tables.inverted.named(stored).collect()}
    assert got == {r.chunk_id: round(r.bm25, 6) for r in posts.collect()}, query
    return got


def test_refreshes_equal_a_rebuild_after_edits(spark, tmp_path, monkeypatch):
    """Random edits: all tables, and full text over segments with documents that went, are those of an index built anew."""
    monkeypatch.setattr(inverted, "MOST_GONE", 10.0)
    rng = random.Random(11)
    texts = {f"{rng.choice(['notes', 'ideas'])}/p{k}.md": page(k, rng) for k in range(40)}
    own = index.Index(spark, str(tmp_path / "idx"), buckets=16)
    own.refresh(pages_of(spark, texts))
    for step in range(3):
        for p in rng.sample(sorted(texts), 5):
            if rng.random() < 0.4:
                del texts[p]
            else:
                texts[p] = page(step, rng)
        texts[f"notes/new{step}.md"] = page(step, rng) + f" `Only_{step}`"
        texts.pop(f"notes/new{step - 1}.md", None)
        counts = own.refresh(pages_of(spark, texts))
        assert counts["added"] == 1 and counts["removed"] >= (step > 0)
    tables, pages = own.tables(), pages_of(spark, texts)
    assert contents(tables) == contents(index.build(pages))
    assert own.meta()["rows"] == {t: tables[t].count() for t in own.meta()["rows"]}
    names = {r.canonical_name for r in tables["entities"].collect()}
    assert "Only_2" in names and "Only_0" not in names  # an entity goes with its last mention
    assert len(own.meta()["segments"]) == 4 and own.meta()["gone"] > 0
    for query in ("cache", "alpha beta", "alpha-beta service", "cache_key", "城池", "nothing", "!!", "page 2"):
        scores(tables, query)
    hits = rag.hits_of(rag.search(tables, rag.Options("alpha cache", 8, 0)))
    plain = rag.hits_of(rag.search(dict(tables), rag.Options("alpha cache", 8, 0)))
    assert hits == plain and hits


def test_a_refresh_of_one_page_writes_a_small_part(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"notes/p{k}.md": page(k, rng) * 8 for k in range(400)}
    own = index.Index(spark, str(tmp_path / "idx"), buckets=64)
    own.refresh(pages_of(spark, texts))
    before, old = size_of(own.folder), own.meta()
    texts["notes/p7.md"] += "more `Brand_New`\n"
    own.refresh(pages_of(spark, texts))
    now = own.meta()
    for t in index.OF_DOCUMENT:
        moved = {b for b, g in now["tables"][t].items() if old["tables"][t].get(b) != g}
        assert moved == {str(spark.range(1).select(bucket_of(F.lit("doc:notes/p7.md"), 64)).first()[0])}
    assert size_of(own.folder) - before < 0.1 * before
    assert scores(own.tables(), "brand_new") and own.meta()["gone"] == 1


def test_segments_are_merged_and_old_buckets_expire(spark, tmp_path):
    texts = {f"notes/p{k}.md": f"# P{k}\n\ncommon word{k}\n" for k in range(8)}
    own = index.Index(spark, str(tmp_path / "idx"), buckets=4)
    own.refresh(pages_of(spark, texts))
    for k in range(3):
        texts[f"notes/p{k}.md"] = f"# P{k}\n\ncommon again{k}\n"
        own.refresh(pages_of(spark, texts))
    meta = own.meta()
    assert len(meta["segments"]) == 1 or meta["gone"] <= 0.2 * sum(s["documents"] for s in meta["segments"])
    assert len(scores(own.tables(), "common")) == 8 and scores(own.tables(), "word1") == {} and len(scores(own.tables(), "again2")) == 1
    own.refresh(pages_of(spark, texts), rebuild=True)
    texts["notes/p1.md"] += "x"
    own.refresh(pages_of(spark, texts))
    texts["notes/p1.md"] += "y"
    own.refresh(pages_of(spark, texts))
    named = {g for at in own.meta()["tables"].values() for g in at.values()} | {g for s in own.meta()["segments"] for g in s["at"].values()}
    left = {n for n in os.listdir(own.folder) if n.startswith("generation-")}
    assert named <= left and len(left - named) <= 1
    assert contents(own.tables()) == contents(index.build(pages_of(spark, texts)))


def test_queries_read_the_asked_terms_alone(spark, tmp_path):
    texts = {f"notes/p{k}.md": f"# P{k}\n\ncommon word{k} and other things\n" for k in range(50)}
    own = index.Index(spark, str(tmp_path / "idx"), buckets=4)
    own.refresh(pages_of(spark, texts))
    plan = own.tables().inverted.rows(["word7"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [word7])]" in plan or "EqualTo(term,word7)" in plan
    assert len(own.tables().inverted.rows(["word7"]).inputFiles()) == 1


def test_an_index_of_version_3_opens_upgraded(spark, tmp_path):
    """The layout of version 3: whole tables in one generation. Pages are not parsed again."""
    rng = random.Random(5)
    texts = {f"notes/p{k}.md": page(k, rng) for k in range(12)}
    pages, folder = pages_of(spark, texts), tmp_path / "idx"
    built = index.build(pages)
    for t in ("documents", "chunks", "wiki_links", "entity_mentions", "postings"):
        built[t].write.parquet(f"{folder}/generation-old/{t}")
    meta = {"generation": "generation-old", "schema_version": 3, "indexer": index.INDEXER_VERSION, "chunk_chars": 1200, "rows": {"documents": 12}}
    (folder / "current.json").write_text(json.dumps(meta))
    own = index.Index(spark, str(folder))
    assert contents(own.tables()) == contents(built) and own.meta()["schema_version"] == index.SCHEMA_VERSION
    scores(own.tables(), "cache service")
    assert own.refresh(pages)["unchanged"] == 12
    own.store.point(own.meta() | {"schema_version": 99})
    with pytest.raises(ValueError, match="newer schema"):
        own.refresh(pages)


def test_support_counts(spark):
    """Counts of old rows and of what came and went: only keys with something left stay, with the highest confidence of what is left."""
    old = spark.createDataFrame([("a", [(0.8, 2), (0.95, 1)]), ("b", [(0.9, 1)]), ("c", [(0.7, 1)])], f"id string, {index.SUPPORT}")
    delta = spark.createDataFrame([("a", 0.95, -1), ("b", 0.9, -1), ("d", 0.72, 3), ("c", 0.9, 1)], "id string, confidence double, n bigint")
    got = {r.id: (r.confidence, [tuple(s) for s in r.support]) for r in index.merged_support(old, delta, ["id"]).collect()}
    assert got == {"a": (0.8, [(0.8, 2)]), "c": (0.9, [(0.7, 1), (0.9, 1)]), "d": (0.72, [(0.72, 3)])}


def test_an_empty_index(spark, tmp_path):
    own = index.Index(spark, str(tmp_path / "idx"))
    assert own.refresh(pages_of(spark, {"a.md": "x"}).where("false"))["scanned"] == 0
    tables = own.tables()
    assert all(df.isEmpty() for df in tables.values()) and tables.inverted.fts("x").isEmpty()
    assert own.refresh(pages_of(spark, {"a.md": "# A\n\nword"}))["added"] == 1 and len(scores(own.tables(), "word")) == 1
    assert written(own.tables()["documents"], "documents").count() == 1
