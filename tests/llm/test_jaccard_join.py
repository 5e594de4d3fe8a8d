import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import jaccard_join as J
from folioscope.llm.common import components


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k), i)) for k, (i, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed, n=260):
    """Chains of near copies about the threshold, copies, shared passages, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n // 13):
        base = [word() for _ in range(r.choice([3, 9, 10, 11, 30, 90, 200, 500]))] + passage * r.choice([0, 0, 1])
        own = [base]
        for _ in range(12):
            new = list(r.choice(own))
            for _ in range(r.choice([0, 1, 1, 2, 3, len(new) // 40])):
                new[r.randrange(len(new))] = word()
            own.append(new)
        texts += [" ".join(x) for x in own]
    texts += ["", None, " \n ", "one", "ONE", "one two", "a a a a a a", "x " * 5000]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [rows[5], (None, rows[7][1]), (None, "no id at all here"), (3, "another text of the same id")]
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, node int, grp string")
    got = J.jaccard_components(df)
    assert result(got) == brute(rows)


def test_large_groups_by_hub_and_blocks(spark, monkeypatch):
    rows = corpus(3)
    r = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    for k in range(300):  # near copies, some beyond the threshold from each other
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            own[r.randrange(120)] = f"x{r.randrange(9999)}"
        rows.append((1000 + k, " ".join(own)))
    monkeypatch.setattr(J, "LEAST_COUNT", 4)
    monkeypatch.setattr(J.links, "__defaults__", (8,))
    monkeypatch.setattr(J.candidate_edges, "__defaults__", (30, 8))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == brute(rows)


def test_keys_of_linked_sets_meet():
    r = np.random.default_rng(1)
    for n in [*range(2, 40), 150, 160, 161, 170, 177, 178, 200, 400]:
        for _ in range(20):
            a = np.unique(r.integers(-(1 << 62), 1 << 62, n))
            b = a.copy()
            for _ in range(int(r.integers(0, n // 9 + 1))):
                b = np.delete(b, r.integers(len(b))) if r.random() < 0.5 else np.unique(np.append(b, r.integers(-(1 << 62), 1 << 62)))
            frequent = np.sort(r.permutation(np.union1d(a, b))[: int(r.integers(0, len(a) + 1))])
            inter = len(np.intersect1d(a, b))
            if J.linked(inter, len(a), len(b)) and len(a) > 1 and inter < len(np.union1d(a, b)):
                assert len(np.intersect1d(J.keys_of(a, frequent), J.keys_of(b, frequent)))
                only = [np.setdiff1d(x, y) for x, y in ((a, b), (b, a))]
                some = [x[r.random(len(x)) < 0.5] for x in only]
                assert len(np.intersect1d(J.keys_of(a, frequent, some[0]), J.keys_of(b, frequent, some[1])))


def test_bitmaps_never_part_linked_sets():
    r = np.random.default_rng(2)
    for n in [2, 10, 200, 1000, 5000]:
        for _ in range(30):
            a = np.unique(r.integers(-(1 << 62), 1 << 62, n))
            b = np.unique(np.concatenate([a[int(r.integers(0, n // 15 + 2)) :], r.integers(-(1 << 62), 1 << 62, int(r.integers(0, n // 15 + 2)))]))
            if len(b) and J.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert J.bucket_edges([7, 3], [len(a), len(b)], [J.bitmap(a), J.bitmap(b)]) == [(7, 3)]
    apart = [np.unique(r.integers(-(1 << 62), 1 << 62, 500)) for _ in range(20)]
    assert J.bucket_edges(list(range(20)), [500] * 20, [J.bitmap(x) for x in apart]) == []


def test_empty_table_and_filter(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id int")
    assert J.jaccard_components(empty).collect() == [] and J.one_of_each(empty).collect() == []
    rows = [(1, "a b c d"), (2, "A b c d"), (2, "A b c d"), (3, ""), (4, None), (5, "q r s"), (5, "q r s"), (None, "a b c d"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in J.one_of_each(df).collect()), key=str) == sorted([(1, "a b c d"), (3, ""), (4, None), (5, "q r s"), (None, "z")], key=str)


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100)] + [(200 + r.randrange(80), 200 + r.randrange(80)) for _ in range(50)] + [(400, 400), (None, 3)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] is not None and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a in parent and b in parent:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def brute_of(rows, width, over):
    """Component ids by shingles of ``width`` words and a similarity of ``over`` hundredths."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    low = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and low[i] != low[j] and 100 * len(sets[i] & sets[j]) >= over * len(sets[i] | sets[j]):
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    return sorted((rows[k][0], len(sets[k]), rows[low[k]][0]) for k in range(len(rows)))


def test_another_width_and_similarity(spark, monkeypatch):
    rows = corpus(4, 130)
    base = [f"w{k}" for k in range(100)]
    r = random.Random(6)
    # a block replaced: below 0.9 at three words, above 0.8 at five
    rows += [(2000, " ".join(base)), (2001, " ".join([*base[:93], *(f"y{k}" for k in range(7))]))]
    for k in range(60):
        own = list(base)
        for _ in range(r.choice([1, 2, 3])):
            own[r.randrange(100)] = f"x{r.randrange(9999)}"
        rows.append((3000 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    like = J.Likeness(5, 80, 100)
    want = brute_of(rows, 5, 80)
    assert result(J.jaccard_components(df, like)) == sorted(want, key=str)
    assert {i for i, _, c in want if i == c} == {x.doc_id for x in J.one_of_each(df, like).collect()}
    monkeypatch.setattr(J.links, "__defaults__", (8,))
    monkeypatch.setattr(J.candidate_edges, "__defaults__", (30, 8))
    assert result(J.jaccard_components(df, like)) == sorted(want, key=str)
    two = df.where("doc_id in (2000, 2001)")
    assert (J.one_of_each(two).count(), J.one_of_each(two, like).count()) == (2, 1)


def test_one_of_each_by_one_rule(spark):
    """Repeated rows fare alike, whatever else stands in the table."""
    for rows, want in (
        ([(3, ""), (3, "")], [(3, "")]),
        ([(3, ""), (3, ""), (5, "q r s"), (5, "q r s")], [(3, ""), (5, "q r s")]),
        ([(None, "a b c"), (None, "a b c"), (None, None), (None, None)], [(None, "a b c"), (None, None)]),
        ([(1, "a b c"), (1, "d e f"), (2, "A b c"), (None, "D e f")], [(1, "a b c"), (1, "d e f")]),
    ):
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, hash string")
        for most in (J.BROADCAST_KEYS, 0):
            got = J.one_of_each(df, broadcast_keys=most)
            assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_several_hubs(spark, monkeypatch):
    """A false group of several clusters, with nodes about twice the distance of a link apart."""
    r = random.Random(8)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for c in range(5):
        base = [*shared, *(f"c{c}w{k}" for k in range(60))]
        for _ in range(25):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                own[r.randrange(120)] = f"x{r.randrange(9999)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # one candidate group of all nodes, whatever the keys say
    monkeypatch.setattr(J, "candidate_edges", lambda index, bitmaps, like: bitmaps.select(F.col("node").alias("a"), F.lit(bitmaps.agg(F.min("node")).first()[0]).alias("b")))
    for rounds in (1, 6):
        monkeypatch.setattr(J, "HUB_ROUNDS", rounds)
        monkeypatch.setattr(J.links, "__defaults__", (10,))
        assert result(J.jaccard_components(df)) == brute(rows)


@pytest.mark.parametrize("like", [J.OWN, J.Likeness(5, 80, 100)])
def test_texts_of_their_own_end_early_at_any_similarity(spark, like):
    """Of texts that share nothing none is indexed; the share of counted tokens is above what a set may spare."""
    r = random.Random(3)
    rows = [(k, " ".join(f"w{r.randrange(10**9)}" for _ in range(400))) for k in range(60)]
    df = spark.createDataFrame([*rows, (100, rows[0][1] + " more")], "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    described = df.mapInArrow(lambda batches: J._described(batches, like=like), "doc_id long, node long, n long, text_hash long, tested array<long>")
    risky = J.at_risk(df, described.select("doc_id", "node", "n", "text_hash"), described, like)
    assert {x.text for x in risky.select("text").collect()} == {rows[0][1], rows[0][1] + " more"}


def test_bitmaps_part_unlike_sets_at_lower_similarity():
    like, r = J.Likeness(5, 80, 100), np.random.default_rng(4)
    new = lambda n: r.integers(-(1 << 62), 1 << 62, n)
    apart = [np.unique(new(int(n))) for n in r.integers(330, 511, 40)]
    assert J.bucket_edges(list(range(40)), [len(x) for x in apart], [J.bitmap(x, like) for x in apart], like) == []
    for n in [10, 300, 2000]:
        a = np.unique(new(n))
        b = np.unique(np.concatenate([a[n // 10 :], new(n // 10)]))
        assert J.linked(len(np.intersect1d(a, b)), len(a), len(b), like)
        assert J.bucket_edges([7, 3], [len(a), len(b)], [J.bitmap(a, like), J.bitmap(b, like)], like) == [(7, 3)]
