import hashlib
import random

from folioscope.llm import line_dedup as L


def brute(rows, sites=L.SITES):
    """Rows (id, text, source) -> cleaned texts, in order."""
    where, first = {}, {}
    for i, t, s in rows:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" "):
                where.setdefault(line.strip(" "), set()).add(s)
                first[line.strip(" ")] = min(first.get(line.strip(" "), (True, 0, 0)), (i is None, i or 0, k))
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append(None)
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or len(where[x.strip(" ")]) < sites or first[x.strip(" ")] == (i is None, i or 0, k)]
        out.append("\n".join(kept))
    return out


def corpus(seed):
    r = random.Random(seed)
    lines = [f"line {k}" for k in range(40)] + [" padded ", "", "  ", "é ü"]
    weights = [1 + 30 * (k % 5 == 0) for k in range(len(lines))]
    rows = [(k, "\n".join(r.choices(lines, weights, k=r.randrange(7))), f"s{r.randrange(14)}") for k in range(150)]
    return [*rows, (500, None, "s1"), (501, "", None), (502, "line 0\nline 0", None), (None, "line 0\nline 5", "s2"), rows[3], rows[3]]


def test_report_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, line int")
    got = sorted(((r.doc_id, r.n_lines, r.n_chars_kept, r.text_sha256) for r in L.report(df).collect()), key=str)
    want = [(i, 0 if t is None else len(t.split("\n")), None if c is None else len(c), None if c is None else hashlib.sha256(c.encode()).hexdigest()) for (i, t, _), c in zip(rows, brute(rows))]
    assert got == sorted(want, key=str)


def test_filter_keeps_columns_and_drops_emptied(spark):
    rows = [(k, "boiler\nplate", f"s{k}", 12, k) for k in range(12)] + [(50, "mine\nboiler", "s1", 11, 0), (51, "", "s1", 0, 0), (52, None, "s2", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, at int")
    got = {r.doc_id: (r.text, r.n_chars) for r in L.without_boilerplate(df).collect()}
    assert got == {0: ("boiler\nplate", 12), 50: ("mine", 4), 51: ("", 0), 52: (None, None)}
    assert L.without_boilerplate(df).columns == df.columns


def test_far_and_near_counts(spark):
    rows = [(k, "wide", f"s{k}") for k in range(300)] + [(1000 + k, "near", f"t{k}") for k in range(L.SITES)] + [(2000 + k, "below", f"u{k}") for k in range(L.SITES - 1)]
    found = {r.line: (r.exact, r.id) for r in L.spread_of_lines(L._occurrences(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    key = lambda t: hashlib.sha256(t.encode()).digest()[:16]
    assert {bytes(k): v for k, v in found.items()} == {key("wide"): (False, 0), key("near"): (True, 1000)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.report(empty).collect() == [] and L.without_boilerplate(empty).collect() == []


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame(corpus(2), "doc_id long, text string, source string")
    plan = L.report(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_passages_of_two_documents(spark):
    passage = " ".join(f"w{k}" for k in range(51))
    fifty = " ".join(f"v{k}" for k in range(50))
    rows = [
        (1, f"one\n{passage}\n{fifty}", "s", 9), (2, f"two\n  {passage}\n{fifty}", "s", 9), (3, f"{passage}\nthree\n{passage}", "t", 9), (4, passage, "t", 9),
        (5, f"own {passage}\nfive\nown {passage}", "t", 9), (6, f"six {passage}", "u", 9), (6, f"six {passage}", "u", 9), (7, None, None, None), (None, f"none\n{passage}", "s", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in L.without_passages(df).collect()), key=str)
    gone = {2: f"two\n{fifty}", 3: "three", None: "none"}
    assert got == sorted(((i, gone.get(i, t)) for i, t, _, _ in rows if i != 4), key=str)
    many = [(k, f"line {k}\n{passage}", "hot", 0) for k in range(500)]
    texts = [r.text for r in L.without_passages(spark.createDataFrame(many, df.schema)).collect()]
    assert len(texts) == 500 and sum(passage in t for t in texts) == 1
    assert L.without_passages(df.limit(0)).collect() == []


def test_filters_trim_all_white_space(spark):
    ends = ["", "\r", "\t", " \r", "\f"]
    rows = [(k, f"own {k}\r\n{'	' * (k % 2)}boiler{ends[k % 5]}\n\r\n\t", f"s{k}") for k in range(L.SITES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in L.without_boilerplate(df).collect()}
    assert got == {k: t if not k else f"own {k}\r\n\r\n\t" for k, t, _ in rows}
    passage = " ".join(f"w{k}" for k in range(51))
    two = spark.createDataFrame([(1, f"a\n{passage}\r", "s"), (2, f"b\n{passage}", "s"), (3, f"c\n{' '.join(passage.split()[:50])}  \r", "s")], df.schema)
    assert sorted(len(r.text.split()) for r in L.without_passages(two).collect()) == [1, 51, 52]


def test_salted_lines_and_clashing_names(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, s, 0, "c", 1, 2) for i, t, s in rows], "doc_id long, text string, source string, gone int, clean string, of_id int, of_hash int")
    want = sorted(((i, c) for (i, t, _), c in zip(rows, brute(rows)) if t == c or (c or "").strip()), key=str)
    for most in (L.BROADCAST_LINES, 1):
        monkeypatch.setattr(L._with_places, "__defaults__", (most,))
        got = L.without_boilerplate(df)
        assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
