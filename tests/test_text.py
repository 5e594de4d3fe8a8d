"""Row-level functions against small models in Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import embedding as E
from folioscope.functions import text as T
from folioscope.operators import answer, chunking, rag, search
from folioscope.sources import tree


def pages_of(spark, files):
    return tree.pages_of_table(spark.createDataFrame(list(files.items()), "path string, text string"))


def test_lines_follow_line_feeds(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\n\n", "\n", "a\r", "x\x0by z\n", None]
    got = [r.l for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.lines(F.col("t")).alias("l")).collect()]
    assert got == [chunking.rust_lines(t or "") for t in texts]


def test_titles_categories_areas(spark):
    files = {"notes/a.md": "x\n  ## The *title* ##  \n# no", "b.md": "no heading", "c/.md": "", "AGENTS.md": "#no\n# yes", "ideas/x/y.md": "```\n# in a fence\n```", "d/e.txt.md": "####### seven"}
    got = {r.path: (r.title, r.category, r.a) for r in pages_of(spark, files).withColumn("a", T.area(F.col("path"))).collect()}
    assert got == {"notes/a.md": ("The *title*", "notes", "notes"), "b.md": ("b", "b.md", None), "c/.md": (".md", "c", None), "AGENTS.md": ("yes", "AGENTS.md", None), "ideas/x/y.md": ("in a fence", "ideas", "ideas"), "d/e.txt.md": ("e.txt", "d", None)}


def test_canonical_paths_differ_on_purpose(spark):
    df = spark.createDataFrame([("./a\\b.md.md#x",), ("a#sec",), ("a.MD",), (" ././n.md ",)], "t string")
    rows = [tuple(r) for r in df.select(T.link_target(F.col("t")), T.graph_path(F.col("t")), T.retrieval_path(F.col("t"))).collect()]
    assert rows == [("a/b.md.md#x", "a/b", "a/b.md.md#x"), ("a#sec", "a", "a#sec"), ("a.MD", "a.MD", "a"), ("n", "n", "n")]


def test_code_is_blanked(spark):
    text = "a `x` b\n```\n[[no]]\n~~~\nafter `odd [[no]]\n ~~~\nin\n```"
    got = spark.createDataFrame([(text,)], "t string").select(T.without_code(F.col("t"))).first()[0]

    assert "[[no]]" not in got and len(got.split("\n")) == 8


def test_chunks_by_headings():
    got = chunking.chunk_markdown("# Root\n\nintro\n\n## Child\n\nbody\n")
    assert [(c.heading_path, c.start_line, c.end_line) for c in got] == [("Root", 1, 3), ("Root > Child", 5, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "### C #", "#", "text", "", "longer line of text", "   ", "x" * 50]), max_size=40), st.integers(1, 120))
def test_chunk_properties(lines, most):
    text = "\n".join(lines)
    got = chunking.chunk_markdown(text, most)
    assert [c.ordinal for c in got] == list(range(len(got)))
    last = 0
    whole = chunking.rust_lines(text)
    for c in got:
        assert c.start_line > last and c.text == "\n".join(whole[c.start_line - 1 : c.end_line]) and c.text.strip()
        last = c.end_line
        assert not any(re.match(r"\s*#{1,6} ", line) for line in whole[c.start_line : c.end_line])
        assert len(c.text) <= most or c.start_line == c.end_line or len(c.text) <= most + 1


def test_entity_zoo():
    text = "fn run_all() and func (s *S) Serve(x)\nstruct Point\nuse std::io\n`cargo build --release` `Svc_1` `cfg.key` `src\\main.rs` `plain` `entities` wiki --type Value\nsee docs/a.md"
    got = {(m.entity_type, m.name) for m in chunking.extract_entities(text, 10)}
    assert got == {("function", "run_all"), ("function", "Serve"), ("type", "Point"), ("module", "std::io"), ("command", "cargo build"), ("identifier", "Svc_1"), ("config", "cfg.key"), ("path", "src/main.rs"), ("path", "docs/a.md")}
    assert all(m.start_line >= 10 for m in chunking.extract_entities(text, 10))


def test_entity_offsets_are_bytes():
    (m,) = chunking.extract_entities("é城 `git 提交 x`")
    assert (m.entity_type, m.name, m.start_line) == ("command", "git 提交", 1)
    assert "é城 `git 提交 x`".encode()[m.start : m.end].decode() == "git 提交"
    assert len(chunking.extract_entities(" ".join(f"`Id_{k}`" for k in range(50)))) == 32


def test_matcher_unicode_phrase_and_errors(spark):
    df = spark.createDataFrame([("Straße und ÉTÉ",), ("城池 任务",), ("alpha, beta alpha/beta",), ("beta then alpha",)], "t string")
    hits = lambda m: [r[0] for r in df.where(m.matches(F.col("t"))).collect()]
    assert hits(T.Matcher("été")) == ["Straße und ÉTÉ"] and hits(T.Matcher("été", case_sensitive=True)) == []
    assert hits(T.Matcher("alpha beta")) == ["alpha, beta alpha/beta", "beta then alpha"]
    m = T.Matcher("alpha beta")
    assert [tuple(r) for r in df.select(m.phrase_hits(F.col("t")), m.token_hits(F.col("t"))).collect()] == [(0, 0), (0, 0), (2, 4), (0, 2)]
    assert hits(T.Matcher("a.+a", regex=True)) and hits(T.Matcher("a.b")) == []
    for bad, regex in (("", False), ("(?=x)", True)):
        with pytest.raises(ValueError):
            T.Matcher(bad, regex=regex)


def test_content_context_and_excerpts(spark):
    files = {"a.md": "\n".join(f"l{k}" + (" hit" if k in (2, 4, 9) else "") for k in range(12)), "b.md": "hit " + "x" * 300, "c.MD": "hit", "ideas/d.md": "no"}
    pages = search.searchable(pages_of(spark, files))
    m = T.Matcher("hit")
    rows = search.content_lines(pages.where("path = 'a.md'"), m, 1).orderBy("line_number").collect()
    assert [r.line_number for r in rows] == [2, 3, 4, 5, 6, 9, 10, 11]
    got = {(r.path, r.ordinal): r.body for r in search.excerpts(pages, m, 2).collect()}
    assert got[("a.md", 0)] == "l0\n\nl1\n\nl2 hit\n" and got[("b.md", 0)].endswith("...") and len(got[("b.md", 0)]) == 203 and len(got) == 3


def test_headings_equal_the_chunker(spark):
    text = "# A\nx\n### C\ny\n## B\nz\n# D\n#### E\nw\n## F\nv"
    got = {r.line_number: r.heading_path for r in search.headings(pages_of(spark, {"p.md": text})).collect()}
    assert got == {c.start_line: c.heading_path for c in chunking.chunk_markdown(text)}


def test_query_terms_and_boosts():
    assert rag.query_terms("How does the retry_Policy of X work?") == ["retry_policy", "work", "x"]
    assert rag.query_terms("请分析城池任务")[0] == "请分析城池任务" and "城池任务" in rag.query_terms("请分析城池任务")
    assert rag.term_boost("abc") == 0.52 + 0.035 and rag.term_boost("城池") == 0.44 and rag.term_boost("x" * 50) == 0.90


def test_embedding_and_cosine(spark):
    e = E.HashEmbedding()
    a, b, c = e.embed("hashMap lookup table"), e.embed("hash map lookup"), e.embed("volcano eruption")
    assert len(a) == 384 and abs(sum(x * x for x in a) - 1) < 1e-5 and a == e.embed("hashMap lookup table") and e.embed("") == [0.0] * 384
    df = spark.createDataFrame([(a, b), (a, c), (a, [0.0] * 384), (a, [1.0]), (a, [float("nan")] * 384)], "a array<float>, b array<float>")
    s = [r[0] for r in df.select(E.cosine(F.col("a"), F.col("b"))).collect()]
    assert s[0] > s[1] and s[2] == 0 and s[3] is None and s[4] is None
    assert E.tokens("camelCase HTTP2Server snake_case-x é") == ["camel", "case", "http2", "server", "snake_case-x", "é"]


def test_quotes_and_budgets():
    assert answer.quote("Which cache?", "First. The cache  is warm! Last") == "The cache is warm"
    assert answer.quote("zzz", "First. Second") == "First"
    assert rag.to_budget("abcdef", 5) == "ab..." and rag.to_budget("abcdef", 3) == "abc" and rag.to_budget("abc", 3) == "abc"
    assert answer.rewrites("What is the CacheKey for x1?") == ["What is the CacheKey for x1?", "cachekey x1", "cachekey", "x1"]
    assert answer.endpoint_url("http://h/v1/") == "http://h/v1/chat/completions" == answer.endpoint_url("http://h")


# what the library's linear forms must equal
OLD_LINK = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]")
OLD_PATH = re.compile(r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?i:rs|go|toml|yaml|yml|json|md|csv)\b)")


def test_links_equal_the_plain_pattern(spark):
    import random

    random.seed(5)
    texts = ["".join(random.choice("[[]]||ab \n") for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["[[a|]] [[|b]] [[[x]]] [[a [[b|c|d]]]", "]]", "[[a]]", "[[a]", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.split("t", r"\]", -1).alias("p")).select("id", T.links_between(F.col("p")).alias("m"))
    got = {r.id: [(m.target, m.label) for m in r.m] for r in rows.collect()}
    assert got == {k: [(m[1], m[2]) for m in OLD_LINK.finditer(t)] for k, t in enumerate(texts)}


def test_paths_equal_the_plain_pattern():
    import random

    from folioscope.operators import chunking

    random.seed(6)
    pattern = next(p for _, rule, _, p in chunking._RULES if rule == "rule:path")
    parts = ["a", "b.rs", "/", "//", ".", "..", "-", "x.md", " ", "c.go", ".md", "é", "_"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert [m.span(1) for m in pattern.finditer(text)] == [m.span(1) for m in OLD_PATH.finditer(text)], text


def test_long_runs_take_linear_time(spark):
    import time

    from folioscope.operators import chunking, index

    n = 1_000_000
    rows = spark.createDataFrame([("blanks", "x" + " " * n + "y"), ("brackets", "[[" * (n // 2)), ("bars", "[[a|" * (n // 4))], "id string, text string")
    rows.select(F.count("text")).collect()
    began = time.perf_counter()
    assert rows.where("id = 'blanks'").select(F.char_length(T.title(F.col("text"), F.lit("p.md"))), F.char_length(T.excerpt(F.col("text")))).collect()[0][0] == 1
    assert index.wiki_links(rows.where("id <> 'blanks'")).count() == 0
    assert time.perf_counter() - began < 10
    began = time.perf_counter()
    for text in ("a" * n, "a/" * (n // 2), "ab12_." * (n // 6), "- " * (n // 2) + "struct " * 1000):
        chunking.extract_entities(text)
    assert time.perf_counter() - began < 8
