"""What grows with the input alone: batches that Python holds, rows that are shuffled."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import chunking, fts, index, inverted, rag
from folioscope.operators.store import Store
from folioscope.plans import tables
from folioscope.plans.tables import BATCH_ROWS

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def wide(spark):
    """The session as it is made, with batches of 10,000 rows."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    yield spark
    spark.conf.set(ROWS, before)


def batch_sizes(df):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return [r.n for r in df.mapInArrow(sizes, "n long").collect()]


def test_chunks_and_mentions_pass_few_rows_at_once(wide):
    pages = wide.range(0, 2000, 1, 1).select(F.concat(F.lit("doc:"), "id").alias("id"), F.lit("# T\n\nfn run() and `Svc_1`\n").alias("text"))
    chunks = chunking.chunks(pages)
    assert max(batch_sizes(chunks)) <= BATCH_ROWS
    sizes = batch_sizes(chunking.mentions(chunks))
    assert max(sizes) <= BATCH_ROWS and sum(sizes) == 4000
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], names=["x"])
    assert [b.num_rows for b in chunking._pieces(iter([batch, batch.slice(0, 0)]))] == [256, 256, 88, 0]


def test_vectors_are_made_of_few_texts_at_once(wide):
    chunks = wide.createDataFrame([("a:chunk:0", "x", "some text")], "id string, text_hash string, text string")
    every, _ = rag.vectors({"chunks": chunks}, rag.DEFAULT_EMBEDDING)
    assert int(wide.conf.get(ROWS)) <= BATCH_ROWS and len(every.first()["vector"]) == 384


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_full_text_is_made_without_sending_tokens(spark):
    chunks = spark.createDataFrame([(7, 0, "b a, b c", "A x"), (8, 0, "", ""), (70, 1, "a", "")], "doc_no long, ordinal long, text string, heading_path string")
    rows = inverted.entries(chunks)
    assert exchanges(rows) == 0
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [("a", 7, 0, 6, [1], [0]), ("a", 70, 1, 1, [0], []), ("b", 7, 0, 6, [0, 2], []), ("c", 7, 0, 6, [3], []), ("x", 7, 0, 6, [], [1])]
    for parts in (1, 3):
        of = inverted.blocks(rows, parts)
        assert exchanges(of) == 1
        assert sorted((r.term, r.block, r.n, r.most, r.tightest) for r in of.collect()) == [("a", 0, 1, 2, 3.0), ("a", 1, 1, 1, 1.0), ("b", 0, 1, 2, 3.0), ("c", 0, 1, 1, 6.0), ("x", 0, 1, 1, 6.0)]


def test_terms_are_counted_without_sending_them_by_chunk(spark):
    chunks = spark.createDataFrame([("p", "b a b", "a"), ("p", "a", ""), ("q", "", ""), (None, "b", "")], "id string, text string, heading_path string")
    got = fts.term_counts(chunks)
    sent = re.findall(r"Exchange hashpartitioning\(([^()]*),", got._jdf.queryExecution().executedPlan().toString())
    assert sorted(re.sub(r"#\d+", "", s).split(",")[0] for s in sent) == ["id", "term"] and all("id" not in s or "term" not in s for s in sent)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 3, 1, 1), ("b", 3, 1, 2)]


def test_a_refresh_that_merges_writes_its_full_text_once(spark, tmp_path, monkeypatch):
    calls, write = [], inverted.write
    monkeypatch.setattr(inverted, "write", lambda *a: calls.append(a[3]) or write(*a))
    page = lambda k, text: (f"doc:{k}.md", f"{k}.md", str(k), str(k), text, text, 0)
    pages = lambda *rows: spark.createDataFrame(list(rows), "id string, path string, title string, category string, text string, sha256 string, modified_at long")
    own = index.Index(spark, str(tmp_path), 2)
    own.refresh(pages(page(1, "red fox"), page(2, "red hen")))
    own.refresh(pages(page(1, "red fox"), page(3, "red old cow")))
    meta = own.meta()
    assert calls == [2, 2] and len(meta["segments"]) == 1 and meta["gone"] == 0 and (meta["chunks"], meta["tokens"]) == (2, 5)
    stored = own.tables().inverted
    assert {r.chunk_id for r in stored.named(stored.fts("red")).collect()} == {"doc:1.md:chunk:0", "doc:3.md:chunk:0"}


def test_full_text_sends_texts_once_and_neither_rows_nor_blocks(spark, tmp_path, monkeypatch):
    """Rows and the blocks they tell are those made with an exchange each, lie sorted in their buckets, and take the one of the texts."""
    monkeypatch.setattr(inverted, "BLOCK_BITS", 2)
    monkeypatch.setattr(inverted, "CHARS_PER_TASK", 200)
    chunks = spark.createDataFrame([(k, j, " ".join(f"w{(k * 7 + j * i) % 11}" for i in range(5 + k % 3)) if k % 9 else "", "Top" if k % 4 else "") for k in range(40) for j in range(2)], "doc_no long, ordinal long, text string, heading_path string")
    rows = inverted.told(inverted.entries(inverted.by_blocks(chunks, 5)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "regexp" not in plan[plan.index("Exchange") :]
    store = Store(spark, str(tmp_path), index.SCHEMAS)
    segment = inverted.write(store, chunks, "generation-0", 40)
    assert set(segment) == {"at", "documents"}
    stored = store.read("inverted", segment["at"])
    plain = ["term", "doc_no", "ordinal", "len", "text_at", "heading_at"]
    want = sorted(map(str, inverted.entries(chunks).collect()))
    assert sorted(map(str, stored.select(*plain).collect())) == want and len(want) > 100
    told = sorted(tuple(r) for r in inverted.blocks_told(stored).collect())
    assert told == sorted((r.term, r.block, r.n, r.most, r.tightest) for r in inverted.blocks(inverted.entries(chunks)).collect())
    for f in stored.inputFiles():
        places = [(r.term, r.doc_no, r.ordinal) for r in spark.read.parquet(f).collect()]
        assert places == sorted(places)
    assert len(stored.inputFiles()) > len(segment["at"])


def test_a_refresh_leaves_no_tables_of_its_own(spark, tmp_path, monkeypatch):
    """Pages, chunks and mentions that a refresh has written go with it, not as the application ends."""
    own, made = index.Index(spark, str(tmp_path), 2), []
    monkeypatch.setattr(index, "written", lambda df, name, **options: made.append((name, out := tables.written(df, name, **options))) or out)
    pages = spark.createDataFrame([(f"doc:{k}.md", f"{k}.md", str(k), str(k), f"red `Fox_{k}`", str(k), 0) for k in range(6)], "id string, path string, title string, category string, text string, sha256 string, modified_at long")
    own.refresh(pages.where("id <> 'doc:5.md'"))
    own.refresh(pages.where("id <> 'doc:1.md'"))
    assert {name for name, _ in made} >= {"pages", "chunks", "mentions"}
    left = {name for name, df in made if os.path.exists(df.written_at)}
    assert not left & {"pages", "chunks", "mentions"}
    got = own.tables()
    assert got["entities"].count() == 5 and got["chunks"].count() == 5


def test_an_index_of_version_5_keeps_its_blocks(spark, tmp_path):
    """Its segments have blocks beside them; others tell them in their rows."""
    pages = spark.createDataFrame([(f"doc:{k}.md", f"{k}.md", str(k), str(k), "red fox", str(k), 0) for k in range(12)], "id string, path string, title string, category string, text string, sha256 string, modified_at long")
    own = index.Index(spark, str(tmp_path), 2)
    own.refresh(pages.where("id <> 'doc:5.md'"))
    meta = own.meta()
    own.store.point(meta | {"schema_version": 5, "segments": [inverted.with_blocks(own.store, s, s["at"][next(iter(s["at"]))]) for s in meta["segments"]]})
    assert own.refresh(pages)["added"] == 1 and own.meta()["schema_version"] == index.SCHEMA_VERSION
    assert ["blocks" in s for s in own.meta()["segments"]] == [True, False]
    stored = own.tables().inverted
    assert sum(r.n for r in stored.blocks(["red"]).collect()) == 12
    assert stored.best("red fox", 20, whole_rows=0)[0].collect() == stored.named(stored.fts("red fox"), 20).collect()
