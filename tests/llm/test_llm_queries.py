"""The registered queries over a small scale factor, and the pipeline stage by stage."""

import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from folioscope.llm import queries as Q
from folioscope.llm import sql

from . import test_decontamination as D
from . import test_jaccard_join as J
from . import test_line_dedup as L
from . import test_packing as P

DATA = "/root/testdata/sf0.001"
ROWS = {f"op{n}": "documents" for n in (1, 3, 5, 6, 7, 8, 9, 10, 11)} | {"op2": "pages"}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_covers_its_table(spark, name):
    got = Q.queries()[name](spark, DATA)
    rows = got.collect()
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    if table := ROWS.get(name.split("_")[0]):
        assert len(rows) == con.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if hasattr(sql, name):
        want = con.sql(getattr(sql, name))
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted((tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()), key=str)


def test_jaccard_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert J.result(Q.op9_jaccard_join(spark, DATA)) == J.brute(rows)


def test_packing_query_round_trip(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert P.check(rows, Q.op4_best_fit_packing(spark, DATA).collect(), 4096) > 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = str(tmp_path / str(n))
        stage(spark, docs, DATA).write.parquet(out)
        docs = spark.read.parquet(out)
        after = docs.collect()
        if name == "best-fit packing":
            P.check([(r["doc_id"], r["text"]) for r in before], after, 4096)
            continue
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in after}
        assert len(kept) == len(after) and set(kept) <= {r["doc_id"] for r in before}
        if name == "quality classifier":
            bad = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{DATA}/labels.parquet' WHERE quality = 0").fetchall()}
            good = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{DATA}/labels.parquet' WHERE quality = 1").fetchall()}
            assert len(good & set(kept)) > 0.95 * len(good) and len(bad & set(kept)) < 0.2 * len(bad)
        elif name == "line dedup":
            want = L.brute([(r["doc_id"], r["text"], r["source"]) for r in before])
            assert kept == {r["doc_id"]: t for r, t in zip(before, want) if t == r["text"] or t.strip()}
        elif name == "n-gram Jaccard join":
            assert set(kept) == {i for i, _, c in J.brute_of(sorted((r["doc_id"], r["text"]) for r in before), 5, 80) if i == c}
        else:
            items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
            words = {i: set(D.words(t)) for i, t in items}
            near = [(r["doc_id"], r["text"]) for r in before if any(len(w & set(D.words(r["text"]))) >= 0.8 * len(w) for w in words.values())]
            gone = {r["doc_id"] for r in before} - set(kept)
            assert gone == {r[0] for r in D.brute(near, items) if r[-1]} & gone and gone <= {i for i, _ in near}


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows and clashing names pass all stages."""
    (tmp_path / "sf").mkdir()
    for name in ("labels", "benchmark"):
        duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet' LIMIT 0").write_parquet(str(tmp_path / "sf" / f"{name}.parquet"))
    text = "some words that stand here and there and again at the end of a line"
    rows = [(1, text, "en", "a", 3, 1, "x"), (1, text, "en", "a", 3, 1, "x"), (2, None, None, None, None, None, None), (2, None, None, None, None, None, None), (None, text + " more", None, None, 0, 2, None), (3, "", "en", "b", 0, 3, "y"), (4, "own " * 60_000, "en", "b", 240_000, 4, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, hash string"
    for own, want in ((rows, {1, 2, 3, 4}), ([], set())):
        docs = spark.createDataFrame(own, schema)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{len(own)}-{n}")
            stage(spark, docs, str(tmp_path / "sf")).write.parquet(out)
            if n < 4:
                assert spark.read.parquet(out).columns == docs.columns
            docs = spark.read.parquet(out)
        assert {r.doc_id for r in docs.collect()} - {None} == want


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DATA).columns[:2] == ["doc_id", "piece"] and os.path.isdir(DATA)
