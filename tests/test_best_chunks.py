"""The best chunks by blocks of the stored full text: the rows of a search of everything, with blocks left unopened."""

import random

from folioscope.operators import index, inverted
from folioscope.plans.queries import stored_text
from folioscope.sources import tree

QUERIES = ("common often", "often common common", "seldom common", "alpha-beta common", "nothing common", "!!")


def pages_of(spark, texts):
    return tree.pages(spark.createDataFrame([(p, t.encode(), 1) for p, t in texts.items()], tree.SCHEMA))


def text_of(k, rng):
    """Most pages hold the words once among many others; a few hold them often in few words, some of these alike."""
    if k % 17 == 3:
        return "# P\n\n" + "common often " * rng.choice([4, 4, 6])
    words = [rng.choice(["filler", "other", "things", "alpha beta"]) for _ in range(rng.randint(40, 80))]
    return "# P\n\n" + " ".join([*words, "common", *(["often"] if k % 2 else []), *(["seldom"] if k % 29 == 0 else [])])


def assert_best(stored, opened, queries=QUERIES):
    for query in queries:
        for limit in (3, 500):
            got = stored.best(query, limit, whole_rows=0)
            if got is None:
                assert stored.fts(query) is None
                continue
            want = stored.named(stored.fts(query), limit).collect()
            assert [(r.chunk_id, round(r.bm25, 9)) for r in got[0].collect()] == [(r.chunk_id, round(r.bm25, 9)) for r in want], (query, limit)
            opened[query, limit] = got[1]


def test_best_chunks_are_those_of_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_BITS", 1)
    monkeypatch.setattr(inverted, "MOST_GONE", 10.0)
    rng, opened = random.Random(4), {}
    texts = {f"notes/p{k}.md": text_of(k, rng) for k in range(120)}
    own = index.Index(spark, str(tmp_path / "idx"), buckets=4)
    own.refresh(pages_of(spark, texts))
    assert_best(own.tables().inverted, opened)
    few, all_ = opened["common often", 3], opened["common often", 500]
    assert few.blocks == all_.blocks == all_.opened and few.opened < few.blocks / 2
    assert opened["alpha-beta common", 3] == inverted.Opened()  # a phrase is counted over all its rows

    # pages that went leave their blocks' bounds behind, which stay bounds; a second segment has blocks of its own
    for k in (3, 20, 37, 5):
        del texts[f"notes/p{k}.md"]
    texts |= {f"ideas/n{k}.md": text_of(k, rng) for k in range(6)}
    own.refresh(pages_of(spark, texts))
    assert own.meta()["gone"] == 4 and len(own.meta()["segments"]) == 2
    assert_best(own.tables().inverted, {}, QUERIES[:1])


def test_an_index_of_version_4_gets_its_blocks(spark, tmp_path):
    rng = random.Random(8)
    pages = pages_of(spark, {f"notes/p{k}.md": text_of(k, rng) for k in range(20)})
    own = index.Index(spark, str(tmp_path / "idx"), buckets=4)
    own.refresh(pages)
    want = {tuple(r) for r in own.tables().inverted.blocks(["common", "often"]).collect()}
    meta = own.meta()
    own.store.point(meta | {"schema_version": 4, "segments": [{k: v for k, v in s.items() if k != "blocks"} for s in meta["segments"]]})
    stored = own.tables().inverted
    assert {tuple(r) for r in stored.blocks(["common", "often"]).collect()} == want and own.meta()["schema_version"] == index.SCHEMA_VERSION
    best = stored.best("common often", 5, whole_rows=0)[0].collect()
    assert best == stored.named(stored.fts("common often"), 5).collect() and len(best) == 5
    own.store.expire(own.meta())
    assert stored.best("common often", 5, whole_rows=0)[0].collect() == best


def test_ranges_of_blocks_lose_none(spark):
    rng = random.Random(2)
    for n in (0, 1, 5, 63, 64, 65, 400):
        picked = rng.sample(range(10_000), n)
        near = inverted.within(picked)
        documents = spark.createDataFrame([((b << inverted.BLOCK_BITS) + at,) for b in picked for at in (0, 63)], "doc_no long")
        assert documents.where(near).count() == 2 * n
        assert str(near).count(">=") <= inverted.RANGES
    outside = spark.createDataFrame([(63,), (64,), (127,), (128,)], "doc_no long").where(inverted.within([1]))
    assert [r[0] for r in outside.collect()] == [64, 127]


def test_blocks_of_the_given_table(spark):
    """Whole documents: what is opened, and the same rows."""
    _, stored = stored_text(spark, "/root/testdata/sf0.001")
    best, report = stored.best("from this", 5, whole_rows=0)
    assert best.collect() == stored.named(stored.fts("from this"), 5).collect()
    assert 0 < report.opened <= report.blocks
