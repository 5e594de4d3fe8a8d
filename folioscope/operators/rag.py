"""Hybrid retrieval: lexical cascade, link, entity and vector signals, fusion, bounded context."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.embedding import EmbeddingProvider, HashEmbedding, cosine, embed_column
from folioscope.plans.tables import small_batches, written

from . import fts, graph

# Caps and boosts of retrieval, and its stop words.
MOST_HITS, RECALL, MOST_TERMS = 100, (20, 500), 8
PAGE_CHUNKS, SCOPES, SCOPE_CHUNKS = 4, 64, 8
SUBSTRING, PAGE_BOOST, MENTION, RELATED, MOST_GRAPH = 0.82, 0.36, 0.28, 0.20, 0.60
CONTEXT_CHARS, MOST_CONTEXT = 8000, 50_000
STOPWORDS = "a an and are about can could does for how i is me of on or please tell the to what when where which who why will would".split()
CJK_STOPWORDS = "请 分析 如何 怎么 怎样 什么 是否 以及 并且 的 了 吗 呢".split()
CJK_NOISE_STARTS, CJK_NOISE_ENDS = ("请", "如何", "怎么", "怎样", "是否"), ("的", "了", "吗", "呢", "并")
_CJK = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"


def query_terms(query: str) -> list[str]:
    """Up to eight fallback terms: words that are no stopwords, and Han runs with their 4- to 2-grams."""
    best: dict[str, int] = {}

    def push(term: str, score: int) -> None:
        best[term] = max(score, best.get(term, score))

    for run in re.findall(f"[A-Za-z0-9_-]+|[{_CJK}]+", query):
        n = len(run)
        if run.isascii():
            if run.lower() not in STOPWORDS and (n >= 3 or re.search(r"[0-9_\-A-Z]", run)):
                push(run.lower(), 1000 + n)
            continue
        if 2 <= n <= 8 and run not in CJK_STOPWORDS:
            push(run, 220 + n)
        for width in (4, 3, 2):
            for k in range(n - width + 1):
                gram = run[k : k + width]
                if gram not in CJK_STOPWORDS and not gram.startswith(CJK_NOISE_STARTS) and not gram.endswith(CJK_NOISE_ENDS):
                    push(gram, 200 + width)
    return sorted(best, key=lambda t: (-best[t], -len(t), t))[:MOST_TERMS]


def term_boost(term: str) -> float:
    return min(0.90, (0.44 if re.search(f"[{_CJK}]", term) else 0.52) + max(len(term) - 2, 0) * 0.035)


@dataclass
class Weights:
    lexical: float = 1.0
    graph: float = 1.0
    vector: float = 1.0

    def sane(self) -> Weights:
        own = Weights(*(w if math.isfinite(w) and w > 0 else 0.0 for w in (self.lexical, self.graph, self.vector)))
        if not any((own.lexical, own.graph, own.vector)):
            raise ValueError("all weights are zero")
        return own


@dataclass
class Options:
    query: str
    limit: int = 8
    depth: int = 1
    regex: bool = False
    embedding: EmbeddingProvider | None = None
    weights: Weights = field(default_factory=Weights)
    most_vectors: int | None = None  # of the first chunks by id; all, if not given


def recall_limit(limit: int) -> int:
    return max(RECALL[0], min(RECALL[1], 8 * limit))


def lexical(tables: dict[str, DataFrame], query: str, regex: bool, limit: int) -> DataFrame:
    """(chunk_id, reason, kind, boost): full text, else substring, else term by term, each by full text, else substring."""
    chunks, posts, lengths = tables["chunks"], tables["postings"], tables.get("lengths")
    place = chunks.select(F.col("id").alias("chunk_id"), "document_id", "ordinal", "text")

    def full(q: str) -> DataFrame | None:
        stored = getattr(tables, "inverted", None)  # the index on disk, where there is one
        if stored is not None:
            best = stored.best(q, limit)
            return None if best is None else best[0].select("chunk_id")
        found = fts.fts(posts, q, lengths)
        return None if found is None else found.orderBy("bm25", "chunk_id").limit(limit).select("chunk_id")

    def by_place(rows: DataFrame) -> DataFrame:
        return rows.orderBy("document_id", "ordinal").limit(limit).select("chunk_id")

    def signal(rows: DataFrame, reason: str, boost: float) -> DataFrame:
        return rows.select("chunk_id", F.lit(reason).alias("reason"), F.lit("lexical").alias("kind"), F.lit(float(boost)).alias("boost"))

    if regex:
        return signal(by_place(fts.regex(place, query)), "regex", 1.0)
    found = full(query)
    if found is not None and not (rows := written(found, "fts")).isEmpty():
        return signal(rows, "fts5", 1.0)
    rows = written(by_place(fts.like(place, query)), "like")
    if not rows.isEmpty():
        return signal(rows, "substring", SUBSTRING)
    parts, terms = [], query_terms(query)  # eight at most
    if lengths is not None and getattr(tables, "inverted", None) is None:  # one scan for all terms
        posts = written(posts.where(F.col("term").isin(*sorted({t for term in terms for t in fts.query_tokens(term)}))), "asked-postings")
    for term in terms:
        found = full(term)
        rows = written(found, "term") if found is not None else None
        if rows is None or rows.isEmpty():
            rows = by_place(fts.like(place, term))
        parts.append(signal(rows, f"query-term: {term}", term_boost(term)))
    none = signal(place.select("chunk_id").limit(0), "", 0.0)
    return reduce(DataFrame.unionByName, parts, none)


def page_signals(tables: dict[str, DataFrame], seeds: DataFrame, depth: int) -> DataFrame:
    """The first chunks of pages that link to or from a seed's page, weaker by distance."""
    chunks, docs = tables["chunks"], tables["documents"]
    own = seeds.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").select(F.col("document_id").alias("node")).distinct()
    near = graph.distances(written(graph.retrieval_edges(docs, tables["wiki_links"]), "edges"), own, depth).where("distance >= 1")
    first = chunks.where(F.col("ordinal") < PAGE_CHUNKS).select(F.col("id").alias("chunk_id"), F.col("document_id").alias("node"))
    return first.join(near, "node").select("chunk_id", F.concat(F.lit("page-link depth "), F.col("distance").cast("string")).alias("reason"), F.lit("graph").alias("kind"), (F.lit(PAGE_BOOST) / F.col("distance")).alias("boost"))


def entity_signals(tables: dict[str, DataFrame], seeds: DataFrame) -> DataFrame:
    """Chunks that mention a seed's entities or their candidate relations' other ends; the first scopes by entity id."""
    mentions, names = tables["entity_mentions"], tables["entities"].select(F.col("id").alias("entity_id"), "canonical_name")
    own = mentions.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi").select("entity_id").distinct()
    named = own.join(names, "entity_id")
    direct = named.select("entity_id", F.concat(F.lit("entity-mention: "), "canonical_name").alias("reason"), F.lit(MENTION).alias("boost"), F.lit("").alias("a"), F.lit("").alias("b"))
    rel = tables["relations"].select("subject_entity_id", "object_entity_id", "predicate")
    ids = own.select(F.col("entity_id").alias("seed"))
    from_subject = rel.join(ids, F.col("subject_entity_id") == F.col("seed")).join(ids.select(F.col("seed").alias("other")), F.col("object_entity_id") == F.col("other"), "left_anti").withColumn("entity_id", F.col("object_entity_id"))
    from_object = rel.join(ids, F.col("object_entity_id") == F.col("seed")).join(ids.select(F.col("seed").alias("other")), F.col("subject_entity_id") == F.col("other"), "left_anti").withColumn("entity_id", F.col("subject_entity_id"))
    hop = from_subject.unionByName(from_object).join(names.select(F.col("entity_id").alias("seed"), F.col("canonical_name").alias("seed_name")), "seed").join(names, "entity_id")
    hop = hop.select("entity_id", F.concat(F.lit("candidate relation from "), "seed_name", F.lit(": "), "predicate", F.lit(" -> "), "canonical_name").alias("reason"), F.lit(RELATED).alias("boost"), F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b"))
    hop = hop.groupBy("entity_id").agg(F.min_by(F.struct("reason", "boost", "a", "b"), F.struct("a", "b")).alias("s")).select("entity_id", "s.*")
    scopes = direct.unionByName(hop).orderBy("entity_id").limit(SCOPES)
    place = tables["chunks"].select(F.col("id").alias("chunk_id"), "document_id", "ordinal")
    of = mentions.select("entity_id", "chunk_id").distinct().join(F.broadcast(scopes.select("entity_id", "reason", "boost")), "entity_id").join(place, "chunk_id")  # 64 rows
    w = W.partitionBy("entity_id").orderBy("document_id", "ordinal")
    return of.withColumn("k", F.row_number().over(w)).where(F.col("k") <= SCOPE_CHUNKS).select("chunk_id", "reason", F.lit("graph").alias("kind"), "boost")


def vectors(tables: dict[str, DataFrame], provider: EmbeddingProvider, cache: DataFrame | None = None, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, text_hash, vector) of all chunks or the first ``cap`` by id, and the part that the cache lacked or held for another text."""
    chunks = tables["chunks"].select(F.col("id").alias("chunk_id"), "text_hash", "text")
    small_batches(chunks.sparkSession)  # a batch of vectors is many times its texts
    if cap is not None:
        chunks = chunks.orderBy("chunk_id").limit(cap)
    if cache is None:
        fresh = chunks
        known = None
    else:
        own = cache.where((F.col("provider") == provider.name) & (F.col("model") == provider.model) & (F.col("dimensions") == provider.dimensions))
        # searches that ran at once may each have stored a chunk's vector; it is one row here
        known = own.join(chunks.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_semi").groupBy("chunk_id", "text_hash").agg(F.first("vector").alias("vector"))
        fresh = chunks.join(known, ["chunk_id", "text_hash"], "left_anti")
    made = fresh.select("chunk_id", "text_hash", embed_column(provider)("text").alias("vector"))
    row = made.withColumns({"provider": F.lit(provider.name), "model": F.lit(provider.model), "dimensions": F.lit(provider.dimensions), "created_at": F.unix_timestamp()})
    return made if known is None else known.unionByName(made), row


def vector_signals(all_vectors: DataFrame, query_vector: list[float], label: str, limit: int, cap: int | None = None) -> DataFrame:
    """The chunks nearest to the query, of all vectors or of the first ``cap`` by chunk id."""
    rows = all_vectors.orderBy("chunk_id").limit(cap) if cap is not None else all_vectors
    value = cosine(F.col("vector"), F.array(*map(F.lit, query_vector)).cast("array<float>"))
    rows = rows.select("chunk_id", value.alias("sim")).where("sim is not null").orderBy(F.desc("sim"), "chunk_id").limit(limit)
    return rows.select("chunk_id", F.lit(label).alias("reason"), F.lit("vector").alias("kind"), F.greatest(F.lit(0.0), "sim").alias("boost"))


def fuse(signals: DataFrame, weights: Weights) -> DataFrame:
    """Per chunk: a reason counts once; lexical and vector by their highest, graph by the capped sum."""
    once = signals.groupBy("chunk_id", "reason").agg(F.first("kind").alias("kind"), F.max("boost").alias("boost"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("boost"))
    rows = once.groupBy("chunk_id").agg(
        (F.coalesce(F.max(of("lexical")), F.lit(0.0)) * weights.lexical).alias("lexical_score"),
        (F.least(F.lit(MOST_GRAPH), F.coalesce(F.sum(of("graph")), F.lit(0.0))) * weights.graph).alias("graph_score"),
        (F.coalesce(F.max(of("vector")), F.lit(0.0)) * weights.vector).alias("vector_score"),
        F.array_sort(F.collect_list(F.struct(F.col("reason").alias("source"), "kind", F.col("boost").alias("score")))).alias("provenance"),
    )
    return rows.withColumns({"score": F.col("lexical_score") + F.col("graph_score") + F.col("vector_score"), "reasons": F.transform("provenance", lambda p: p["source"])})


def search(tables: dict[str, DataFrame], o: Options, cache: DataFrame | None = None, keep: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The hits: at most o.limit chunks by fused score, with provenance and excerpt.

    ``keep`` is given the rows that the cache of vectors lacks, to be stored with it.
    """
    if not o.query.strip():
        raise ValueError("the query must not be empty")
    weights, limit = o.weights.sane(), max(1, min(MOST_HITS, o.limit))
    recall = recall_limit(limit)
    direct = written(lexical(tables, o.query, o.regex, recall), "lexical")
    signals = [direct]
    if o.depth > 0 and not direct.isEmpty():
        signals.append(page_signals(tables, direct, o.depth))
    if not direct.isEmpty():
        signals.append(entity_signals(tables, direct))
    if o.embedding:
        every, fresh = vectors(tables, o.embedding, cache, o.most_vectors)
        if keep:
            fresh = written(fresh, "fresh-vectors")
            keep(fresh)
            every, _ = vectors(tables, o.embedding, fresh if cache is None else cache.unionByName(fresh), o.most_vectors)
        signals.append(vector_signals(every, o.embedding.embed(o.query), f"{o.embedding.name}:{o.embedding.model}", recall, None))
    fused = fuse(reduce(DataFrame.unionByName, signals), weights)
    chunk = tables["chunks"].select(F.col("id").alias("chunk_id"), "document_id", "heading_path", "start_line", "end_line", "text")
    doc = tables["documents"].select(F.col("id").alias("document_id"), "path", "title")
    rows = fused.join(chunk, "chunk_id").join(doc, "document_id")
    rows = rows.orderBy(F.desc("score"), "path", "start_line", "chunk_id").limit(limit)
    return rows.select("chunk_id", "path", "title", "heading_path", "start_line", "end_line", "lexical_score", "graph_score", "vector_score", "score", "reasons", "provenance", T.excerpt(F.col("text")).alias("excerpt"))


# -- context and text, of at most a hundred hits ---------------------------------------------------


def to_budget(text: str, n: int) -> str:
    if len(text) <= n:
        return text
    return text[:n] if n <= 3 else text[: n - 3] + "..."


def block(number: int, hit: dict) -> str:
    head = hit["heading_path"] or hit["title"]
    scores = f"{hit['score']:.3f} (lexical {hit['lexical_score']:.3f}, graph {hit['graph_score']:.3f}, vector {hit['vector_score']:.3f})"
    return f"[{number}] {hit['path']}:{hit['start_line']}-{hit['end_line']}\nHeading: {head}\nScore: {scores}\nReasons: {', '.join(hit['reasons'])}\n{hit['excerpt']}\n\n"


@dataclass
class Context:
    query: str
    text: str
    hits: list[dict]
    truncated: bool


def context(query: str, hits: list[dict], max_chars: int = CONTEXT_CHARS) -> Context:
    """Blocks of hits until the budget; the first that does not fit is cut into what is left."""
    left = max_chars = max(1, min(MOST_CONTEXT, max_chars))
    text, used = "", []
    for k, hit in enumerate(hits, 1):
        own = block(k, hit)
        if len(own) > left:
            if left:
                text += to_budget(own, left)
                used.append(hit)
            return Context(query, text, used, True)
        text, left = text + own, left - len(own)
        used.append(hit)
    return Context(query, text, used, False)


def hits_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def as_dict(c: Context) -> dict:
    return asdict(c)


DEFAULT_EMBEDDING = HashEmbedding()
