import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import exact_dedup as X


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=600))
def test_perfect_hash_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.uint64)
    shift, slot = X.perfect_hash(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    assert (X.slots_of(shift, len(keys), keys) == slot).all()


def brute(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, best[low(t)], len(groups[low(t)]), i == best[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=str)


def frame(spark, rows, extra=False):
    if extra:  # clashing names
        return spark.createDataFrame([(i, t, "x", 1, b"d") for i, t in rows], "doc_id long, text string, shard string, copy int, digest binary")
    return spark.createDataFrame(rows, "doc_id long, text string")


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (7, "x" * 200_000), (None, "a b"), (None, "only"), (9, "ß"), (10, "A B "), (11, "É"), (12, "new"), (13, "NEW"), (-4, "far")]


def test_against_brute_force(spark):
    assert result(X.dedup(frame(spark, ROWS))) == brute(ROWS)
    assert result(X.dedup(frame(spark, ROWS, extra=True))) == brute(ROWS)
    marks = {(r.doc_id, r.from_history) for r in X.dedup(frame(spark, ROWS)).collect()}
    # the middle of -4 and 12 is 4
    assert {(11, False), (9, False), (12, False), (None, True), (1, False)} <= marks and (5, False) in marks


def test_every_kind_of_history(spark):
    """Empty, all of one side, ids at both ends of what a long holds, no ids at all."""
    ends = [(-(1 << 63), "a"), ((1 << 63) - 1, "A"), (0, "b")]
    for rows in ([], [(4, "one")], [(None, "x"), (None, "X")], ends, [(5, "t"), (5, "T"), (5, "u")]):
        assert result(X.dedup(frame(spark, rows))) == brute(rows)


def test_hot_group_is_looked_up_by_several_tasks(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3 * X.ROWS_PER_LOOKUP)]
    assert result(X.dedup(frame(spark, rows))) == brute(rows)


def test_history_members_and_nonmembers(spark):
    history = X.summarise(X.digests(frame(spark, [(100, "old"), (101, "Older"), (102, "gone")])))
    arrivals = [(1, "OLD"), (2, "new"), (3, "new"), (400, "older"), (None, "old")]
    got = {(r.doc_id, r.from_history, r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(frame(spark, arrivals), history).collect()}
    assert got == {(1, True, 100, 3, False), (None, True, 100, 3, False), (400, True, 400, 2, True), (2, False, 3, 2, False), (3, False, 3, 2, True)}
    none = X.summarise(X.digests(frame(spark, [])))
    assert {(r.doc_id, r.from_history, r.keep_id) for r in X.exact_dedup(frame(spark, arrivals[:3]), none).collect()} == {(1, False, 1), (2, False, 3), (3, False, 3)}
    assert X.exact_dedup(frame(spark, []), history).collect() == []


def test_both_branches_of_the_query(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r.arrived, r.n) for r in _arrived(documents).groupBy("arrived").agg(F.count("*").alias("n")).collect()}
    assert {a for a, n in found if n > 10} == {"repeat", "new", None}


def _arrived(documents):
    rows = X.digests(documents)
    middle = documents.agg(F.max("doc_id")).first()[0] // 2
    return X.merged(X.summarise(rows.where(F.col("doc_id") <= middle)), X.summarise(rows.where(F.col("doc_id") > middle)))
