"""The commands: init, index, graph, rag, harness, sdd, read, search."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope import config, seed
from folioscope.functions import text as T
from folioscope.operators import answer, graph, index, overview, rag, report, search, spec
from folioscope.plans.tables import session
from folioscope.sources import tree

INDEX = f"{tree.INDEX_FOLDER}/index"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("folioscope")
    top.add_argument("--path", default="docs")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("init")
    p.add_argument("--dir", default="docs")
    p.add_argument("--url")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("index")
    p.add_argument("--rebuild", action="store_true")
    p.add_argument("--chunk-chars", type=int, default=1200)
    g = sub.add_parser("graph").add_subparsers(dest="what", required=True)
    g.add_parser("stats")
    p = g.add_parser("entities")
    p.add_argument("--query")
    p.add_argument("--type")
    p.add_argument("--limit", type=int, default=50)
    p = g.add_parser("entity-neighbors")
    p.add_argument("entity")
    p.add_argument("--limit", type=int, default=50)
    p = g.add_parser("neighbors")
    p.add_argument("page")
    p.add_argument("--depth", type=int, default=1)
    p.add_argument("--direction", choices=("in", "out", "both"), default="both")
    p = g.add_parser("path")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--max-depth", type=int, default=4)
    p = g.add_parser("export")
    p.add_argument("--format", choices=("json", "dot"), default="json")
    p.add_argument("--out", help="a new folder for a graph of any size; without it the graph is printed")
    for name in ("stats", "entities", "entity-neighbors", "neighbors", "path"):
        g.choices[name].add_argument("--format", choices=("json", "text"), default="json")
    r = sub.add_parser("rag").add_subparsers(dest="what", required=True)
    for name in ("search", "context", "ask"):
        p = r.add_parser(name)
        p.add_argument("-q", "--query", required=True)
        p.add_argument("--limit", type=int, required=name == "search", default=8)
        p.add_argument("--depth", type=int, default=1)
        p.add_argument("--regex", action="store_true")
        p.add_argument("--embedding", choices=("none", "local-hash"), default=None)
        for w in ("lexical", "graph", "vector"):
            p.add_argument(f"--{w}-weight", type=float, default=1.0)
        p.add_argument("--most-vectors", type=int)
        p.add_argument("--max-chars", type=int, default=8000)
        p.add_argument("--format", choices=("text", "json", "prompt"), default="text")
        for o in ("provider", "endpoint", "model"):
            p.add_argument(f"--{o}")
        p.add_argument("--timeout", type=float)
    p = sub.add_parser("harness")
    p.add_argument("-q", "--query", required=True)
    p.add_argument("--limit", type=int, default=8)
    p.add_argument("--depth", type=int, default=1)
    p.add_argument("--regex", action="store_true")
    p.add_argument("--embedding", choices=("none", "local-hash"), default=None)
    for w in ("lexical", "graph", "vector"):
        p.add_argument(f"--{w}-weight", type=float, default=1.0)
    p.add_argument("--most-vectors", type=int)
    p.add_argument("--max-chars", type=int, default=12_000)
    p.add_argument("--format", choices=("text", "json", "prompt"), default="text")
    s = sub.add_parser("sdd").add_subparsers(dest="what", required=True)
    p = s.add_parser("list")
    p.add_argument("--all", action="store_true")
    s.add_parser("new").add_argument("title")
    p = s.add_parser("verify")
    p.add_argument("--change", required=True)
    p.add_argument("--input")
    s.add_parser("archive").add_argument("--change", required=True)
    p = sub.add_parser("read")
    p.add_argument("--no-agents", action="store_true")
    p.add_argument("--no-index", action="store_true")
    p.add_argument("--no-strict", action="store_true")
    p.add_argument("--log-last", type=int, default=0)
    p.add_argument("--heads", type=int, default=200)
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("--mode", choices=("summary", "files", "content"), default="summary")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--case-sensitive", action="store_true")
    p.add_argument("--category")
    p.add_argument("--per-file", type=int, default=5)
    p.add_argument("--head", type=int, default=50)
    p.add_argument("--context", type=int, default=2)
    p.add_argument("--most-pages", type=int, help="look at so many pages only, the first by path")
    # the folder may be named before the command or behind it
    for command in (*sub.choices.values(), *g.choices.values(), *r.choices.values(), *s.choices.values()):
        command.add_argument("--path", default=argparse.SUPPRESS)
    return top


def _tables(spark: SparkSession, root: str) -> dict:
    return index.Index(spark, f"{root}/{INDEX}").tables()


def _pages(tables: dict):  # noqa: ANN202
    return tables["documents"].select("id", "path", "title")


def _graph(spark: SparkSession, a: argparse.Namespace) -> str:
    t = _tables(spark, a.path)
    pages, links = _pages(t), t["wiki_links"]
    dump = lambda rows: json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if a.what == "stats":
        extra = {k: t[k].count() for k in ("entities", "entity_mentions", "relations")}
        found = rows(graph.stats(pages, links))[0] | extra
        return report.stats(found) if a.format == "text" else dump(found)
    if a.what == "entities":
        found = rows(graph.entity_list(t["entities"], t["entity_mentions"], a.query, a.type, a.limit))
        return report.entities(found) if a.format == "text" else dump(found)
    if a.what == "entity-neighbors":
        one = spark.createDataFrame([(graph.resolve_entity(t["entities"], a.entity),)], "id string")
        found = rows(graph.entity_neighbors(t["relations"], t["relation_evidence"], t["entities"], one, a.limit))
        return report.entity_neighbors(a.entity, found) if a.format == "text" else dump(found)
    edges = graph.edges(pages, links)
    if a.what == "neighbors":
        page = graph.resolve(pages, a.page)
        found = rows(graph.neighbors(edges, page, a.depth, a.direction).orderBy("depth", "direction", "source", "target", "link_text"))
        return report.neighbors(page, a.depth, a.direction, found) if a.format == "text" else dump(found)
    if a.what == "path":
        source, target = graph.resolve(pages, a.source), graph.resolve(pages, a.target)
        steps = graph.shortest_path(edges, source, target, a.max_depth)
        return report.path(source, target, steps) if a.format == "text" else dump(steps)
    if a.out:
        graph.write_export(pages, links, a.out, a.format)
        return f"written: {a.out}"
    nodes, edges = graph.export(pages, links)
    if a.format == "dot":
        return graph.dot([r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()])
    return dump({"nodes": rows(nodes), "edges": rows(edges)})


def _options(a: argparse.Namespace) -> rag.Options:
    embedding = rag.DEFAULT_EMBEDDING if (a.embedding or config.load().embedding) == "local-hash" else None
    return rag.Options(a.query, a.limit, a.depth, a.regex, embedding, rag.Weights(a.lexical_weight, a.graph_weight, a.vector_weight), a.most_vectors)


def _vectors(spark: SparkSession, a: argparse.Namespace) -> tuple:
    """The cache of vectors beside the index, if there is one, and what stores rows in it."""
    own = index.Index(spark, f"{a.path}/{INDEX}")
    return own.vectors(), own.keep_vectors


def _rag(spark: SparkSession, a: argparse.Namespace) -> str:
    settings, t, options = config.load(), _tables(spark, a.path), _options(a)
    cache = _vectors(spark, a) if options.embedding else (None, None)
    if a.what == "ask":
        name = a.provider or settings.answer_provider
        more = {} if name == "extractive" else {"endpoint": a.endpoint or settings.endpoint, "model": a.model or settings.model, "key": settings.api_key, "timeout": a.timeout or settings.timeout}
        found = answer.ask(t, a.query, options, answer.provider(name, **more), a.max_chars, cache=cache[0], keep=cache[1])
        return answer.answer_json(found) if a.format == "json" else answer.answer_text(found)
    hits = rag.hits_of(rag.search(t, options, *cache))
    if a.what == "context":
        c = rag.context(a.query, hits, a.max_chars)
        return json.dumps(asdict(c), ensure_ascii=False, indent=2) if a.format == "json" else answer.prompt(a.query, c) if a.format == "prompt" else c.text
    return json.dumps(hits, ensure_ascii=False, indent=2) if a.format == "json" else "".join(rag.block(k, h) for k, h in enumerate(hits, 1))


def _search(spark: SparkSession, a: argparse.Namespace) -> str:
    m = T.Matcher(a.query, a.regex, a.case_sensitive)
    pages = search.searchable(tree.pages(tree.read_tree(spark, a.path, "search")), a.category, a.most_pages)
    if a.mode == "files":
        return "\n".join(r["path"] for r in search.files(pages, m, a.head).collect())
    top = search.top_pages(pages, m, a.head, 1).select("path").collect()  # bounded, and one more, to tell whether others match
    head = max(1, min(search.MOST_HEAD, a.head))
    own = pages.where(F.col("path").isin([r["path"] for r in top[:head]]))
    if a.mode == "content":
        lines = search.content_lines(own, m, a.context).orderBy("path", "line_number").collect()
        return report.search_content(m, [(r["path"], r["line_number"], r["line"]) for r in lines], len(top) > head, head)
    found: dict[str, list[str]] = {r["path"]: [] for r in top}
    for r in search.excerpts(own, m, a.per_file).orderBy("path", "ordinal").collect():
        found[r["path"]].append(r["body"])
    area = lambda p: p.split("/")[0] if p.split("/")[0] in T.AREAS and "/" in p else None
    return report.search_summary(m, [(p, area(p), bodies) for p, bodies in found.items()], head)


def run(a: argparse.Namespace, spark: SparkSession | None = None) -> str:
    if a.command == "init":
        steps = seed.plan(a.dir, a.url, a.force)
        if not a.dry_run:
            seed.commit(a.dir, steps)
        listed = [f"{s.action}: {s.path}" for s in steps]
        if a.dry_run:
            kept = sum(s.action == "keep" for s in steps if s.content is not None)
            listed.append(f"dry run: {sum(s.content is not None for s in steps) - kept} documents to write, {kept} to keep; nothing was written")
        return "\n".join(listed)
    if a.command == "sdd" and a.what in ("list", "new", "archive"):
        found = spec.list_changes(a.path, a.all) if a.what == "list" else spec.new_change(a.path, a.title) if a.what == "new" else spec.archive(a.path, a.change)
        return json.dumps(found, ensure_ascii=False, indent=2)
    spark = spark or session()
    if a.command == "sdd":
        given = None
        if a.input:
            raw = sys.stdin.buffer.read(spec.MOST_INPUT + 1) if a.input == "-" else open(a.input, "rb").read(spec.MOST_INPUT + 1)
            if len(raw) > spec.MOST_INPUT:
                raise ValueError("the input is larger than 1 MiB")
            given = json.loads(raw.decode("utf-8"))
        return json.dumps(spec.verify(spark, a.path, a.change, given), ensure_ascii=False, indent=2)
    if a.command == "index":
        counts = index.Index(spark, f"{a.path}/{INDEX}").refresh(tree.pages(tree.read_tree(spark, a.path)), a.chunk_chars, a.rebuild)
        return "\n".join(f"{k}: {v}" for k, v in counts.items())
    if a.command == "graph":
        return _graph(spark, a)
    if a.command == "rag":
        return _rag(spark, a)
    if a.command == "search":
        return _search(spark, a)
    pages = tree.pages(tree.read_tree(spark, a.path, "search"))
    if a.command == "read":
        if not a.no_strict:
            overview.demand_base(pages, a.path)
        return overview.text(pages, a.log_last, a.heads, not a.no_agents, not a.no_index)
    own = index.Index(spark, f"{a.path}/{INDEX}")
    own.refresh(tree.pages(tree.read_tree(spark, a.path)))
    options = _options(a)
    cache = _vectors(spark, a) if options.embedding else (None, None)
    package = answer.harness(own.tables(), overview.text(pages, with_agents=False, with_index=False), a.query, a.limit, a.depth, a.max_chars, options, *cache)
    if a.format == "json":
        return json.dumps(package, ensure_ascii=False, indent=2)
    return f"{package['overview']}\n{package['evidence']}" + ("\n(uncertain)" if package["uncertain"] else "") + (f"\nQuestion: {a.query}" if a.format == "prompt" else "")


def main(argv: list[str] | None = None) -> int:
    try:
        print(run(parser().parse_args(argv)))
    except (ValueError, LookupError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    except PySparkException as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
