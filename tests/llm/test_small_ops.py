"""Token counts, URL filters, quality, toxicity, licence scans."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import labelled, license_scan, quality, token_counts, toxicity, url_filter

RANKS, PATTERN = token_counts.read_ranks()
COUNT = token_counts.counter(RANKS, PATTERN)


def test_token_counts_of_edits_against_whole_encoding():
    r = random.Random(1)
    pieces = ["word", " and", "  ", "\n\n", "12", "don't", "é", "日本語", "!?", " ", "'", "s", "\t", "🙂"]
    for _ in range(400):
        text = "".join(r.choices(pieces, k=r.choice([0, 1, 5, 60, 400])))
        tree = token_counts.Tree.of(text, COUNT)
        assert tree.tokens == len(COUNT.encoding.encode_ordinary(text))
        for _ in range(4):
            a = r.randrange(len(text) + 2)
            b = a + r.choice([0, 0, 1, 3, 50])
            new = "".join(r.choices(pieces, k=r.choice([0, 0, 1, 4, 300])))
            tree, text, n = token_counts.edit(tree, text, a, b, new, COUNT)
            assert tree.tokens == len(COUNT.encoding.encode_ordinary(text)) and tree.sums[1, 0] == len(text)
            tree = token_counts.Tree.load(tree.dump())


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80), st.integers(0, 90), st.integers(0, 90), st.text(max_size=20))
def test_token_counts_any_edit(text, a, b, new):
    clean = lambda t: t.encode("utf-8", "ignore").decode()
    text, new = clean(text), clean(new)
    tree, out, _ = token_counts.edit(token_counts.Tree.of(text, COUNT), text, min(a, b), max(a, b), new, COUNT)
    assert tree.tokens == len(COUNT.encoding.encode_ordinary(out))


def test_an_edit_encodes_little():
    text = "some plain words in a row " * 5000
    tree = token_counts.Tree.of(text, COUNT)
    assert token_counts.edit(tree, text, 60_000, 60_004, "new", COUNT)[2] <= 6 * token_counts.LEAF


def test_token_counts_query(spark):
    rows = [(1, "mail a.b@c.org or 10.0.0.1, call +1 (743) 555-3824 "), (2, None), (3, ""), (4, "x" * 100_000), (1, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 5, b"") for i, t in rows], "doc_id long, text string, n_tokens int, tree binary")
    got = sorted((r.n_tokens, r.n_edits, r.n_tokens_after) for r in token_counts.token_counts(df).collect())

    def want(t):
        edits = token_counts.redactions(t or "")
        out = t or ""
        for a, b, new in reversed(edits):
            out = out[:a] + new + out[b:]
        n = lambda x: len(COUNT.encoding.encode_ordinary(x))
        return n(t or ""), len(edits), n(out)

    assert got == sorted(want(t) for _, t in rows) and max(g[1] for g in got) == 4
    assert token_counts.token_counts(df.limit(0)).collect() == []


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h, p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else default


URLS = [None, "", "no scheme", "http://", "http://COM", "http://com/", "http://a.com", "https://WWW.Example.com/en/x?y#z", "https://m.example.com/en/", "https://example.com/en", "x://net/es/a", "x://a.net/fr/", "x://anet/fr/", "x://a.net/de/", "http://b.org/://c.com/", "http://x.org?u=http://a.com/", "http://x.org#/en/", "http://a.com//en//", "http://é.com/ü/\nnew", "http://.com/", "http://x.example.com/" + "d/" * 500]


def test_url_filter_against_brute_force(spark):
    rules = [*url_filter.RULES, ("example.com", "", "block"), ("a.com", "//e", "block"), ("x.org", "", "block"), ("com", "/ü/\nn", "block"), ("Dup.org", "/", "allow"), ("dup.org", "/", "block")]
    pages = spark.createDataFrame([(k // 2, u, "h") for k, u in enumerate([*URLS, *URLS[:4], "http://dup.org/"])], "page_id long, url string, host string")
    for own, broadcast in ((url_filter.RULES, 100), (rules, 100), (rules, 1)):
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, spark.createDataFrame(own, "host string, path string, verdict string"), broadcast_rules=broadcast).collect()), key=str)
        unique = {(h.lower(), p): v for h, p, v in own}
        assert got == sorted(((r.page_id, *judge(r.url, [(h, p, v) for (h, p), v in unique.items()])) for r in pages.collect()), key=str)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.url_filter(pages, none).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://example.com/en/" + "s/" * 100_000), (2, "http://" + "a." * 100_000 + "net/fr/" + "x" * 1_000_000)], "page_id long, url string")
    began = time.perf_counter()
    assert sorted((r.page_id, r.rule) for r in url_filter.url_filter(long, url_filter.standing_rules(spark)).collect()) == [(1, "example.com/en/"), (2, "net/fr/")]
    assert time.perf_counter() - began < 20
    assert url_filter.url_filter(pages.limit(0), url_filter.standing_rules(spark)).collect() == []


def test_ordinal_thresholds_are_ordered_and_tails_fall():
    r = random.Random(3)
    words = {0: ["$$", "!!", "AAA"], 1: ["AAA", "mid"], 2: ["good", "text", "mid"], 3: ["fine", "good", "prose"]}
    grades = [r.randrange(4) for _ in range(600)]
    texts = [" ".join(r.choices(words[g], k=20)).encode() for g in grades]
    model = quality.fit(texts, np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(texts)
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = tails.sum(1)
    assert np.abs(np.round(expected) - np.array(grades)).mean() < 0.2


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def labelled_corpus(spark, n=500):
    r = random.Random(9)
    plain = ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        words = r.choices(plain, k=r.choice([5, 60, 400]))
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["stupid", "idiot", "idi0t", "stupidd"])
        rows.append((k, " ".join(words), "en", 0.5))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame([*rows, (9000, None, "en", 0.1), (9001, "", "en", 0.1), (None, "x", "en", 0.1), rows[0]], "doc_id long, text string, lang string, score double"), labels


def test_classifiers_on_held_out_rows(spark):
    df, labels = labelled_corpus(spark)
    table = labels_of(spark, [*labels, (None, 1, 1), (3, None, None)])
    truth = {k: (q, t) for k, q, t in labels}
    got = toxicity.toxicity(df, table).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.9
    rated = [r for r in quality.quality(df, table).collect() if r.doc_id in truth]
    assert np.mean([r.selected == bool(truth[r.doc_id][0]) for r in rated]) > 0.95
    kept = quality.selected(df, table)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def test_classifiers_without_labels(spark):
    df, labels = labelled_corpus(spark, 20)
    none = labels_of(spark, [])
    assert {r.score for r in toxicity.toxicity(df, none).collect()} == {0.0}
    assert all(r.selected for r in quality.quality(df, none).collect())
    one = labels_of(spark, [(k, 1, 1) for k in range(20)])
    assert {r.score for r in toxicity.toxicity(df, one).collect()} == {1.0}
    assert {r.expected_grade for r in quality.quality(df, one).collect()} == {1.0}
    assert toxicity.toxicity(df.limit(0), one).collect() == [] and quality.selected(df.limit(0), one).collect() == []


def test_the_sample_leaves_out_the_held_out_fold(spark):
    df, labels = labelled_corpus(spark, 200)
    texts, y = labelled.sample(df, labels_of(spark, labels), "toxic", 50)
    outside = {r.text.encode() for r in df.collect() if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert 0 < len(texts) <= 100 and set(texts) <= outside


def test_license_rules(spark):
    mit = "Copyright\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'
    rows = [
        (1, "An open line\nReleased under the MIT License.\nmore", "MIT", 1), (2, mit, "MIT", 1), (3, apache, "Apache-2.0", 1), (4, "LICENSED UNDER CC BY-NC 4.0!", "CC-BY-NC-4.0", 1),
        (5, "Not licensed under the Apache License, Version 2.0.", "", 0), (6, None, "", 0), (7, "", "", 0), (8, "Licensed under CC BY 4.0. x. Licensed under CC BY 4.0.", "CC-BY-4.0", 2),
        (9, mit + apache, "Apache-2.0,MIT", 2), (10, mit.split("The above")[0], "", 0), (11, "word " * 50_000 + ". Released under the MIT License.", "MIT", 1), (11, "", "", 0),
    ]
    df = spark.createDataFrame([(i, t, "own") for i, t, _, _ in rows], "doc_id long, text string, licenses string")
    got = sorted((r.doc_id, r.licenses, r.n_matches) for r in license_scan.license_scan(df).collect())
    assert got == sorted((i, names, n) for i, _, names, n in rows)
    assert license_scan.license_scan(df.limit(0)).collect() == []


def test_the_sample_holds_whole_texts(spark):
    long = "clean words " * 5000 + "idiot"
    rows = [(k, f"{long} {k}") for k in range(40)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    labels = labels_of(spark, [(k, 1, k % 2) for k in range(40)])
    every, y = labelled.sample(df, labels, "toxic", held_out=False)
    assert sorted(every) == sorted(t.encode() for _, t in [*rows, rows[3]]) and y.sum() == 21
    few, _ = labelled.sample(df, labels, "toxic", held_out=False, most_bytes=200_000)
    assert len(few) == 4 and set(few) <= set(every)


def test_more_licenses_and_spdx_lines(spark):
    two = (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    )
    end = "may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    gpl = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n"
    texts = {
        "BSD-2-Clause": [two, two[: two.index("2. R")], "# SPDX-License-Identifier: BSD-2-Clause"],
        "BSD-3-Clause": [f"{two}\n3. Neither the name of {x} nor the names of its\n   contributors {end}" for x in ("the copyright holder", "Some Company", "Some Company Inc.")],
        "GPL-2.0": [gpl.format(";", "General Public License", ";", 2), "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n"],
        "GPL-3.0": [gpl.format(":", "General Public License", ",", 3) + "\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
        "AGPL-3.0": [gpl.format(":", "Affero General Public License", ",", 3)],
        "LGPL-3.0": [gpl.format(":", "Lesser General Public License", ",", 3)],
        "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"],
        "Unlicense": ["This is free and unencumbered software released into the public domain.\n"],
        "CC0-1.0": ["/* SPDX-License-Identifier: CC0-1.0 */\nx"],
        "Apache-2.0,MIT": ["x\n// SPDX-License-Identifier: (MIT OR Apache-2.0)\ny"],
        "": ["SPDX-License-Identifier: Other-1.0", "MIT", "Neither the name of MIT nor the names of its contributors " + end],
    }
    rows = [(names, t) for names, own in texts.items() for t in own]
    got = license_scan.license_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {rows[r.doc_id]: r.licenses for r in got} == {x: x[0] for x in rows}


def test_long_words_count_whole():
    r = random.Random(8)
    for alphabet in ("abc", "é日🙂a"):
        for n in (1, 20, 63, 64, 65, 66, 200, 999):
            word = "".join(r.choices(alphabet, k=n))
            cut = [p.decode() for p in toxicity.pieces(word.encode())]
            assert all(len(p.encode()) <= 64 for p in cut) and (len(cut) == 1) == (len(word.encode()) <= 64)
            assert {word[k : k + 5] for k in range(len(word) - 4)} <= {p[k : k + 5] for p in cut for k in range(len(p) - 4)}
    plain = ["".join(r.choices("fghijklm", k=5)) for _ in range(200)]
    texts, labels = [], np.arange(400) % 2
    for y in labels:
        texts.append(" ".join(r.choices(plain, k=20) + ["stupid"] * y).encode())
    model = toxicity.fit(texts, labels)
    glued = "".join(r.choices(plain, k=30)).encode()
    assert model.highest(glued + b"stupid") > model.highest(glued)
    assert toxicity.words_of(b"a" * 64) == [b"a" * 64] and toxicity.words_of(b"") == []
    tails = {tuple(quality.features(b"a" * 64 + end)[0]) for end in (b"b", b"B")}
    shapes = [quality._shapes[b"a" * 64 + end] & 0xFFFFFFFF for end in (b"b", b"B")]
    assert len(tails) == 2 and shapes[0] != shapes[1] and shapes[0] == zlib.crc32(b"sa")


def test_many_edits_of_a_long_text():
    r = random.Random(4)
    pieces = ["word", " and", "  ", "\n\n", "12", "don'", "'ll", "é", "日本語", "!?", " ", "'", "s", "\t", "🙂", " " * 300, "x" * 700]
    for size in (3, 40, 3000):
        text = "".join(r.choices(pieces, k=size))
        places = sorted(r.sample(range(len(text) + 1), min(len(text), 60)))
        edits = [(a, b, "".join(r.choices(pieces, k=r.choice([0, 1, 3])))) for a, b in zip(places[::2], places[1::2])]
        own, out = token_counts.Edited(token_counts.Tree.of(text, COUNT), text, COUNT), text
        for a, b, new in sorted(edits, reverse=True):
            own.edit(a, b, new)
            out = out[:a] + new + out[b:]
        assert own.text() == out and own.tree.tokens == len(COUNT.encoding.encode_ordinary(out)) and own.tree.sums[1, 0] == len(out)


def test_redaction_takes_linear_time():
    began = time.perf_counter()
    for text in ("a" * 5_000_000, "+1" * 2_500_000, "+1 " + "(" * 5_000_000, "a.b@c" * 1_000_000, "1." * 2_500_000, "+1 2 " * 1_000_000):
        token_counts.redactions(text)
    assert time.perf_counter() - began < 10
    found = lambda t: [(t[a:b], n) for a, b, n in token_counts.redactions(t)[:-1]]
    assert found("x +1 (743) 555-3824, y +12345678 +1234567 a.b+c@d.e-f.org.") == [("+1 (743) 555-3824", "[PHONE]"), ("+12345678", "[PHONE]"), ("a.b+c@d.e-f.org", "[MAIL]")]


def test_a_long_text_with_many_redactions():
    text = "write to a.b@c.org or call +1 (743) 555-3824 today. " * 20_000
    began = time.perf_counter()
    own = token_counts.Edited(token_counts.Tree.of(text, COUNT), text, COUNT)
    for a, b, new in reversed(token_counts.redactions(text)):
        own.edit(a, b, new)
    assert time.perf_counter() - began < 30
    assert own.tree.tokens == len(COUNT.encoding.encode_ordinary(own.text()))


def test_license_rules_against_brute_force(monkeypatch):
    """Random rules over sentences of one letter; every choice of places is tried."""
    r = random.Random(6)

    def fits(text, rule, i):
        """Ends of the rule begun at sentence i."""
        if text[i] != rule[0]:
            return set()
        ends = {i}
        for want in rule[1:]:
            ends = {m for n in ends for m in range(n + 1, min(len(text), n + 2 + license_scan.GAP)) if text[m] == want}
        return ends

    for _ in range(300):
        rules = {f"L{k}": [tuple(r.choices("abc", k=r.randrange(1, 5)))] for k in range(4)}
        text = r.choices("abcz", k=r.randrange(12))
        own = license_scan.Rules({n: [tuple(f"say {x}." for x in rule) for rule in v] for n, v in rules.items()}, spdx=False)
        got = {(n, a // 7, b // 7) for n, a, b in own.matches(" ".join(f"say {x}." for x in text).encode())[1]}
        every = {(n, i, min(e), len(rule)) for n, (rule,) in rules.items() for i in range(len(text)) if (e := fits(text, rule, i))}
        inside = lambda m, o: o[1] <= m[1] and m[2] <= o[2] and (o[1:3] != m[1:3] or o[3] > m[3])
        assert got == {m[:3] for m in every if not any(inside(m, o) for o in every)}
    # the first next sentence leads nowhere, the second one does
    own = license_scan.Rules({"X": [("say a.", "say b.", "say c.")]}, spdx=False)
    assert [m[0] for m in own.matches(b"say a. say b. say b. zz. say c.")[1]] == ["X"]


def test_license_scan_takes_linear_time():
    own = license_scan.Rules(license_scan.RULES)
    began = time.perf_counter()
    for text in (b" " * 1_000_000, b"\n" * 1_000_000, b" \n" * 500_000, b"a" * 5_000_000, b"Released under the MIT License. " * 30_000, b"Neither the name of " + b"x " * 500_000):
        own.matches(text)
    assert time.perf_counter() - began < 20


def test_whole_license_texts():
    wrapped = lambda t: re.sub(r"(.{50,60}) ", r"\1\n", t)
    own = license_scan.Rules(license_scan.RULES)
    for name, rules in license_scan.RULES.items():
        for rule in rules:
            found = {m[0] for m in own.matches(("An own line\n\n" + wrapped("\n\n".join(rule)) + "\n").encode())[1]}
            assert name in found, (name, rule[0][:60])
    for name in ("MIT", "MIT-0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "0BSD", "Unlicense", "Zlib"):
        longest = max(license_scan.RULES[name], key=len)
        assert {m[0] for m in own.matches(wrapped("\n\n".join(longest)).encode())[1]} == {name}


def test_a_long_word_is_scored_to_its_end(spark):
    df, labels = labelled_corpus(spark)
    glued = "fgh" * 33_334
    two = spark.createDataFrame([(70_001, glued + "idiot"), (70_002, glued)], "doc_id long, text string")
    scores = {x.doc_id: x.score for x in toxicity.toxicity(df.select("doc_id", "text").unionByName(two), labels_of(spark, labels)).collect()}
    assert scores[70_001] > scores[70_002]


def test_ratings_and_graded_selection(spark):
    df, labels = labelled_corpus(spark)
    table = labels_of(spark, [*labels, (None, 1, None), (5000, None, 1), (5001, 1, None), (5002, 0, None)])
    graded = {r.doc_id: r.rating for r in quality.ratings(table).collect()}
    assert all(graded[k] == q * (2 - t) for k, q, t in labels) and (graded[5000], graded[5001], graded[5002]) == (None, 2, 0)
    rated = {r.doc_id: r.expected_grade for r in quality.quality(df, table).collect()}
    mean = lambda g: np.mean([rated[k] for k in rated if k is not None and graded.get(k) == g and k < 500])
    assert mean(0) < 0.5 < 1 < mean(1) < mean(2) <= 2


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    rows = [(1, "same")] * 500 + [(2, f"t{k}") for k in range(500)] + [(3, "x")]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, [(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0)])
    got = [labelled.sample(df.repartition(k), labels, "quality", 50, held_out=False) for k in (1, 5)]
    assert got[0][0] == got[1][0] and len(got[0][0]) == 100


def test_clashing_names_in_filters(spark):
    df, labels = labelled_corpus(spark, 60)
    own = df.selectExpr("*", "1 as scores", "2 as __scores", "3 as order")
    kept = quality.selected(own, labels_of(spark, labels))
    assert kept.columns == own.columns and kept.count() > 0


@pytest.mark.parametrize("name, text", [
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"),
    ("GPL-3.0", "Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n  The licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.  By contrast,\n"),
    ("Apache-2.0", '1. Definitions.\n\n"License" shall mean the terms and conditions for use, reproduction,\nand distribution as defined by Sections 1 through 9 of this document.\n\n"Licensor" shall mean the copyright owner or entity authorized by\nthe copyright owner that is granting the License.\n'),
])
def test_openings_of_whole_licence_texts(spark, name, text):
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == name
