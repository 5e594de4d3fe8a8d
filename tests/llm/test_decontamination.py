import hashlib
import random
import re

from folioscope.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                own = v[k : k + window]
                for s in range(len(w) - len(own) + 1):
                    if w[s : s + len(own)] == own:
                        hit.update(range(s, s + len(own)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    vocabulary = ["Aa", "b", "C9", "é", "the", "of", "日本"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, k=n))
    items = [(k, text(r.choice([0, 1, 2, 3, 5, 12, 13, 14, 30]))) for k in range(25)] + [(3, text(20)), (90, None), (91, "!?")]
    docs = [(k, text(r.choice([0, 1, 2, 10, 60]))) for k in range(30)] + [(80, None), (81, ""), (81, "")]
    for k in range(100, 140):
        docs.append((k, text(r.randrange(300)) + " " + (r.choice(items)[1] or "") + ". " + text(r.randrange(300))))
    return docs, items


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    docs, items = case(1)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, lang int")
    assert result(D.contamination(d, b)) == brute(docs, items)
    clean = sorted((r.doc_id for r in D.decontaminate(d, b).collect()))
    assert clean == sorted(r[0] for r in brute(docs, items) if not r[-1])
    assert D.decontaminate(d, b).columns == d.columns


def test_prefixes_that_are_not_broadcast_and_words_that_are_not_sent(spark, monkeypatch):
    docs, items = case(2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(D.contamination(d, b, broadcast_rows=3)) == brute(docs, items)
    assert sorted(r.doc_id for r in D.decontaminate(d, b, broadcast_rows=3).collect()) == sorted(r[0] for r in brute(docs, items) if not r[-1])
    # a bitmap that lets nearly all through, and no vocabulary
    monkeypatch.setattr(D, "LEAST_BITS", 6)
    monkeypatch.setattr(D, "MOST_BITS", 6)
    monkeypatch.setattr(D.vocabulary_of, "__defaults__", (3,))
    assert result(D.contamination(d, b)) == brute(docs, items)


def test_no_items_no_documents(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert result(D.contamination(d, b)) == brute([(1, "a b")], [])
    assert D.contamination(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_a_frequent_shingle_in_a_very_long_text(spark):
    docs = [(1, "a " * 50_000), (2, "b a"), (None, "a " * 13), (None, None)]
    items = [(1, "a " * 40), (2, "a b " * 20)]
    d = spark.createDataFrame([(i, t, i, "x", 0) for i, t in docs], "doc_id long, text string, id long, hash string, found int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id if r.n_words else "none": (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in D.contamination(d, b).collect()}
    assert got == {1: (50_000, 50_000, 1, True), 2: (2, 0, 0, False), None: (13, 13, 1, True), "none": (0, 0, 0, False)}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(2, "b a")]


def test_stretches_are_the_words_of_the_text(monkeypatch):
    """Each word is one stretch's own, with its neighbours on both sides; words longer than a stretch stay whole."""
    r = random.Random(6)
    for size in (1, 2, 7, 40):
        monkeypatch.setattr(D, "STRETCH_BYTES", size)
        for before, after in ((0, 2), (3, 3), (13, 13)):
            for n in (0, 1, 2, 30, 200):
                text = "".join(r.choice(["a", "Bb", "日本", "long" * 5, " ", ", ", "  "]) for _ in range(n)).encode()
                want, own = D.words_of(text), []
                for first, low, upto, kept in D.stretches(text, before, after):
                    assert kept == want[first : first + len(kept)] and 0 <= low <= upto <= len(kept)
                    assert first == 0 or low >= before
                    assert first + len(kept) == len(want) or upto == low or upto + after <= len(kept)
                    own += range(first + low, first + upto)
                assert own == list(range(len(want)))


def test_texts_of_several_stretches_and_rows(spark):
    """Items around the end of a stretch, in a text of two, and a wanted shingle at each place of a text, beyond what one row holds."""
    item = " ".join(f"i{k}" for k in range(40))
    filler = "w " * (D.STRETCH_BYTES // 2)
    docs = [(k, filler[: D.STRETCH_BYTES - back] + item + " " + filler[:200_000] + item) for k, back in enumerate((0, 2, 30, 60, 150, 400))]
    docs += [(10, "a " * 60_000), (11, item), (12, "x" * (D.STRETCH_BYTES + 5) + " " + item)]
    assert 60_000 * 25 * 2 > 4 * D.ROW_BYTES
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(1, item), (2, "a " * 20)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in D.contamination(d, b).collect()}
    want = {k: (len(words(t)), 80, 1, False) for k, t in docs[:6]} | {10: (60_000, 60_000, 1, True), 11: (40, 40, 1, True), 12: (41, 40, 1, True)}
    assert got == want


def test_words():
    assert D.words_of("Ab-C 9_é\x7f日本 x".encode()) == [w.encode() for w in words("Ab-C 9_é\x7f日本 x")]
