"""The page graph and the entity graph: statistics, neighbourhoods, paths, distances, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.plans.tables import discard, written

MOST_DEPTH = 8


def nodes(pages: DataFrame) -> DataFrame:
    """name, path, title: of pages with one canonical name the last by path stands for it."""
    return pages.select(T.graph_path(F.col("path")).alias("name"), "path", "title").groupBy("name").agg(F.max_by(F.struct("path", "title"), "path").alias("p")).select("name", "p.*")


def edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """source, target, link_text, resolved: every link, dangling ones too."""
    of = pages.select(F.col("id").alias("source_document_id"), T.graph_path(F.col("path")).alias("source"))
    known = pages.select(T.graph_path(F.col("path")).alias("target")).distinct().withColumn("known", F.lit(True))
    rows = links.join(of, "source_document_id").select("source", T.graph_path(F.col("target_path")).alias("target"), "link_text")
    return rows.join(known, "target", "left").select("source", "target", "link_text", F.coalesce("known", F.lit(False)).alias("resolved"))


def stats(pages: DataFrame, links: DataFrame) -> DataFrame:
    e = edges(pages, links)
    counts = e.agg(F.count("*").alias("links"), F.count_distinct("source", "target").alias("distinct_edges"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("dangling"))
    return counts.join(F.broadcast(pages.agg(F.count("*").alias("nodes"))), F.lit(True)).select("nodes", "links", "distinct_edges", "resolved", "dangling")  # one row each


def resolve(pages: DataFrame, query: str) -> str:
    """The name of the page a query means: its canonical name, else its title; an error if none or several do."""
    rows = pages.select(T.graph_path(F.col("path")).alias("name"), "title", T.graph_path(F.lit(query)).alias("q"))
    exact = rows.where("name = q").select("name").distinct().limit(2).collect()
    found = exact or rows.where(F.lower("title") == query.strip().lower()).select("name").distinct().orderBy("name").limit(20).collect()
    if not found:
        raise LookupError(f"no page {query!r}")
    if len(found) > 1:
        raise LookupError(f"{query!r} may be any of: " + ", ".join(r["name"] for r in found))
    return found[0]["name"]


def neighbors(all_edges: DataFrame, start: str, depth: int = 1, direction: str = "both") -> DataFrame:
    """depth, direction, source, target, link_text, resolved: edges met in a breadth-first walk.

    At most eight frontier joins, each written, so that no plan holds more than one.
    """
    depth = max(1, min(MOST_DEPTH, depth))
    spark = all_edges.sparkSession
    frontier = spark.createDataFrame([(start,)], "node string")
    seen = frontier
    found: DataFrame | None = None
    for level in range(1, depth + 1):
        parts = []
        if direction in ("out", "both"):
            parts.append(all_edges.join(frontier, F.col("source") == F.col("node")).select(F.lit(level).alias("depth"), F.lit("outgoing").alias("direction"), "source", "target", "link_text", "resolved", F.when(F.col("resolved"), F.col("target")).alias("next")))
        if direction in ("in", "both"):
            parts.append(all_edges.where("resolved").join(frontier, F.col("target") == F.col("node")).select(F.lit(level).alias("depth"), F.lit("incoming").alias("direction"), "source", "target", "link_text", "resolved", F.col("source").alias("next")))
        step = written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "neighbors")
        found = step if found is None else found.unionByName(step)
        frontier = written(step.select(F.col("next").alias("node")).where("node is not null").distinct().join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found.drop("next").distinct()


def shortest_path(all_edges: DataFrame, start: str, goal: str, most: int = 4) -> list[dict] | None:
    """The steps from start to goal over resolved edges, or None.

    Of equal paths the first discovered: parents in order of their discovery, edges by target and text.
    """
    if start == goal:
        return []
    spark = all_edges.sparkSession
    reached = spark.createDataFrame([(start, 0, 0, None, None)], "node string, rank long, level int, parent string, link_text string")
    frontier, own = reached, all_edges.where("resolved")
    for level in range(1, max(1, min(MOST_DEPTH, most)) + 1):
        step = own.join(frontier.select(F.col("node").alias("source"), F.col("rank").alias("parent_rank")), "source").join(reached.select(F.col("node").alias("target")), "target", "left_anti")
        first = W.partitionBy("target").orderBy("parent_rank", F.asc_nulls_first("link_text"))
        step = step.withColumn("k", F.row_number().over(first)).where("k = 1")
        step = step.select(F.col("target").alias("node"), F.lit(level).alias("level"), F.col("source").alias("parent"), "link_text", "parent_rank")
        # discovery order, by sorted partitions: no task holds a whole level
        frontier = written(step.orderBy("parent_rank", "node").select("node", F.monotonically_increasing_id().alias("rank"), "level", "parent", "link_text"), "path")
        reached = reached.unionByName(frontier)
        if not frontier.where(F.col("node") == goal).isEmpty():
            break
        if frontier.isEmpty():
            return None
    steps, at = [], goal
    while at != start:  # at most eight look-ups
        row = reached.where(F.col("node") == at).first()
        if row is None:
            return None
        steps.append({"source": row["parent"], "target": at, "link_text": row["link_text"]})
        at = row["parent"]
    return steps[::-1]


def distances(undirected: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, distance) of nodes within depth of any seed, over (a, b) read both ways."""
    depth = max(0, min(MOST_DEPTH, depth))
    both = undirected.select("a", "b").unionByName(undirected.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = written(seeds.select("node").distinct().withColumn("distance", F.lit(0)), "distances")
    frontier = found
    for level in range(1, depth + 1):
        step = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti")
        frontier = written(step.withColumn("distance", F.lit(level)), "distances")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def retrieval_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) document ids: resolved links by the retrieval rule, no loops, no duplicates."""
    known = pages.select(T.retrieval_path(F.col("path")).alias("name"), F.col("id").alias("b"), "path").groupBy("name").agg(F.max_by("b", "path").alias("b"))
    rows = links.select(F.col("source_document_id").alias("a"), T.retrieval_path(F.col("target_path")).alias("name"))
    # stored links are small as files and many times that in memory: neither side is to be sent whole through the driver
    return rows.join(known.hint("merge"), "name").where("a <> b").select("a", "b").distinct()


def entity_list(entities: DataFrame, mentions: DataFrame, query: str | None = None, kind: str | None = None, limit: int | None = 50) -> DataFrame:
    """Entities by number of mentions: 1 to 500 of them as the limit says, all without one."""
    out = entities
    if query:
        out = out.where(F.col("canonical_name").rlike(T.like_pattern(query)))
    if kind:
        out = out.where(F.col("entity_type") == kind)
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions"))
    rows = out.join(counts, "id", "left").select("id", "canonical_name", "entity_type", "confidence", F.coalesce("mentions", F.lit(0)).alias("mentions"))
    rows = rows.orderBy(F.desc("mentions"), "entity_type", "canonical_name", "id")
    return rows if limit is None else rows.limit(max(1, min(500, limit)))


def resolve_entity(entities: DataFrame, query: str) -> str:
    found = entities.where((F.col("id") == query) | (T.ascii_lower(F.col("canonical_name")) == T.ascii_lower(F.lit(query)))).select("id").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{query!r} is no entity" if not found else f"{query!r} names several entities")
    return found[0]["id"]


def entity_neighbors(relations: DataFrame, evidence: DataFrame, entities: DataFrame, entity: DataFrame, limit: int | None = 50) -> DataFrame:
    """For the entities of entity (id): neighbour, direction, predicate, highest confidence, evidence chunks.

    Neighbours are grouped by their own id.
    """
    out = relations.select(F.col("subject_entity_id").alias("id"), F.col("object_entity_id").alias("neighbor_id"), F.lit("outgoing").alias("direction"), "predicate", "confidence", F.col("id").alias("relation_id"))
    into = relations.select(F.col("object_entity_id").alias("id"), F.col("subject_entity_id").alias("neighbor_id"), F.lit("incoming").alias("direction"), "predicate", "confidence", F.col("id").alias("relation_id"))
    own = out.unionByName(into).join(entity.select("id"), "id", "left_semi").join(evidence.select("relation_id", "chunk_id"), "relation_id", "left")
    rows = own.groupBy("id", "neighbor_id", "direction", "predicate").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("chunk_id")).alias("evidence"))
    names = entities.select(F.col("id").alias("neighbor_id"), F.col("canonical_name").alias("neighbor_name"), F.col("entity_type").alias("neighbor_type"))
    rows = rows.join(names, "neighbor_id")
    return rows.orderBy("neighbor_id", "direction", "predicate").limit(limit) if limit else rows


def cyclic(edges: DataFrame, group: str) -> DataFrame:
    """The groups (one column) whose edges (group, a, b) run in a circle, all groups at once; an edge to itself is none.

    Edges to nodes that lead nowhere and from nodes that nothing leads to are peeled off: what no round shortens lies on circles
    or between them. The rounds are half the edges of the longest way in any one group, however many groups there are.
    """
    left = written(edges.select(group, "a", "b").where("a <> b").distinct(), "peeled")
    n = left.count()
    while n:
        to_open = left.join(left.select(group, F.col("a").alias("b")).distinct(), [group, "b"], "left_semi")
        rest = written(to_open.join(left.select(group, F.col("b").alias("a")).distinct(), [group, "a"], "left_semi").select(group, "a", "b"), "peeled")
        m = rest.count()
        discard(left)
        left, n = rest, m if m < n else 0
    return left.select(group).distinct()


def has_cycle(dependencies: DataFrame) -> bool:
    """Whether (a depends on b) runs in a circle."""
    return not cyclic(dependencies.select(F.lit(0).alias("graph"), "a", "b"), "graph").isEmpty()


def export(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes(pages).orderBy("name"), edges(pages, links).orderBy("source", "target", F.asc_nulls_first("link_text"))


def dot_lines(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The lines (line) of ``dot`` as a table in their order, sorted over all tasks, so that a graph of any size can be written."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    col, all_edges = F.col, edges(pages, links)
    none = F.lit(None).cast("string")
    line = lambda rows, part, a, b, c, text: rows.select(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"), text.alias("line"))
    ends = lambda part, text: line(pages.sparkSession.range(1), part, none, none, none, F.lit(text))
    label = F.when(F.coalesce(col("link_text"), F.lit("")) != "", F.concat(F.lit(" [label="), quote(col("link_text")), F.lit("]"))).otherwise("")
    parts = [
        ends(0, "digraph pages {"), line(nodes(pages), 1, col("name"), none, none, F.concat(F.lit("  "), quote(col("name")), F.lit(" [label="), quote(col("title")), F.lit("];"))),
        line(all_edges.where("not resolved").select("target").distinct(), 2, col("target"), none, none, F.concat(F.lit("  "), quote(col("target")), F.lit(" [style=dashed];"))),
        line(all_edges, 3, col("source"), col("target"), col("link_text"), F.concat(F.lit("  "), quote(col("source")), F.lit(" -> "), quote(col("target")), label, F.lit(";"))), ends(4, "}"),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("part", F.asc_nulls_first("a"), F.asc_nulls_first("b"), F.asc_nulls_first("c")).select("line")


def write_export(pages: DataFrame, links: DataFrame, folder: str, form: str) -> None:
    """The whole graph into a new folder, by the tasks: DOT as text, else nodes and edges as JSON lines."""
    if form == "dot":
        dot_lines(pages, links).write.text(folder)
        return
    for name, rows in zip(("nodes", "edges"), export(pages, links)):
        rows.write.json(f"{folder}/{name}")


def dot(node_rows: list, edge_rows: list) -> str:
    """The graph in DOT; dangling targets are dashed."""
    esc = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    out = ["digraph pages {"]
    out += [f'  "{esc(n["name"])}" [label="{esc(n["title"])}"];' for n in node_rows]
    for target in sorted({e["target"] for e in edge_rows if not e["resolved"]}):
        out.append(f'  "{esc(target)}" [style=dashed];')
    for e in edge_rows:
        label = f' [label="{esc(e["link_text"])}"]' if e["link_text"] else ""
        out.append(f'  "{esc(e["source"])}" -> "{esc(e["target"])}"{label};')
    return "\n".join([*out, "}"]) + "\n"
