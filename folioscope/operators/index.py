"""The index: tables derived from pages, and their incremental refresh."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.plans.tables import discard, written

from . import chunking, fts, inverted
from .store import PACKED, PART, Store, bucket_of, dealt

# Kept with the index; another indexer means a rebuild, an older schema an upgrade.
SCHEMA_VERSION, INDEXER_VERSION = 6, "folioscope-index-v1"
PREDICATE = "co_occurs_in_chunk"
VECTOR_KEY = ["chunk_id", "provider", "model", "dimensions", "text_hash"]
SUPPORT = "support array<struct<confidence:double,n:bigint>>"
#: the tables as they are stored; support holds how many mentions, or chunks, stand behind each confidence
SCHEMAS = {
    "documents": "id string, path string, title string, category string, sha256 string, modified_at long, indexed_at long, status string, doc_no long",
    "chunks": "id string, document_id string, ordinal long, start_line long, end_line long, heading_path string, text string, text_hash string, doc_no long",
    "wiki_links": "source_document_id string, ordinal long, target_path string, link_text string, link_kind string",
    "entity_mentions": "id string, entity_id string, chunk_id string, surface string, start_pos long, end_pos long, start_line long, end_line long, extractor string, confidence double, entity_type string, canonical_name string",
    "relation_evidence": "relation_id string, chunk_id string, quote string, start_line long, end_line long",
    "entities": f"id string, canonical_name string, entity_type string, aliases array<string>, confidence double, status string, {SUPPORT}",
    "relations": f"id string, subject_entity_id string, predicate string, object_entity_id string, confidence double, extractor string, status string, {SUPPORT}",
    "inverted": inverted.SCHEMA,
    "blocks": inverted.BLOCKS,
    "gone": inverted.GONE,
}
#: tables of which each row belongs to one document
OF_DOCUMENT = {"documents": "id", "chunks": "document_id", "wiki_links": "source_document_id", "entity_mentions": None, "relation_evidence": None}
#: digests of other columns, which are not sent with their rows but made anew where these arrive
DIGESTS = {
    "chunks": {"text_hash": lambda: F.sha2("text", 256)},
    "entity_mentions": {"id": lambda: F.concat(F.lit("mention:"), F.sha2(F.concat_ws(":", "entity_id", "chunk_id", "start_pos", "end_pos"), 256))},
}
#: documents for each bucket of a new index, and its fewest and most buckets
DOCUMENTS_PER_BUCKET, BUCKETS = 50_000, (64, 16_384)


def document_of(table: str) -> Column:
    name = OF_DOCUMENT[table]
    return F.col(name) if name else F.regexp_replace("chunk_id", r":chunk:\d+$", "")


def wiki_links(pages: DataFrame) -> DataFrame:
    """source_document_id, ordinal, target_path, link_text, link_kind; code holds no links, duplicates are kept."""
    clean = pages.select("id", T.without_code(F.col("text")).alias("t"))
    pieces = clean.select("id", F.split("t", r"\]", -1).alias("pieces"))
    rows = pieces.select("id", F.posexplode(T.links_between(F.col("pieces"))).alias("ordinal", "m"))
    target, label = T.link_target(F.col("m.target")), T.trimmed(F.col("m.label"))
    return rows.select(F.col("id").alias("source_document_id"), F.col("ordinal").cast("long").alias("ordinal"), target.alias("target_path"), label.alias("link_text"), F.lit("wiki").alias("link_kind")).where("target_path <> ''")


def entities(mentions: DataFrame) -> DataFrame:
    """Distinct name and type with the highest confidence of the mentions."""
    return mentions.groupBy("entity_id").agg(F.first("canonical_name").alias("canonical_name"), F.first("entity_type").alias("entity_type"), F.max("confidence").alias("confidence")).select(
        F.col("entity_id").alias("id"), "canonical_name", "entity_type", F.array().cast("array<string>").alias("aliases"), "confidence", F.lit("candidate").alias("status")
    )


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """(subject, object, chunk, confidence) for each pair of entities of a chunk; at most 32 entities are in a chunk."""
    own = mentions.groupBy("chunk_id", "entity_id").agg(F.max("confidence").alias("confidence"))
    # the pairs are made within the chunk's short list of entities: one shuffle, no self-join
    lists = own.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "confidence"))).alias("e"))
    left = lists.select("chunk_id", "e", F.posexplode("e").alias("k", "a"))
    pairs = left.select("chunk_id", "a", F.explode(F.slice("e", F.col("k") + 2, F.greatest(F.size("e") - F.col("k") - 1, F.lit(0)))).alias("b"))
    return pairs.select(F.col("a.entity_id").alias("subject_entity_id"), F.col("b.entity_id").alias("object_entity_id"), "chunk_id", F.least("a.confidence", "b.confidence").alias("confidence"))


def relation_id() -> Column:
    return F.concat(F.lit("relation:"), F.sha2(F.concat("subject_entity_id", F.lit(f":{PREDICATE}:"), "object_entity_id"), 256))


def relations(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("subject_entity_id", "object_entity_id").agg(F.max("confidence").alias("confidence")).select(
        relation_id().alias("id"), "subject_entity_id", F.lit(PREDICATE).alias("predicate"), "object_entity_id", "confidence", F.lit("rule:chunk-cooccurrence").alias("extractor"), F.lit("candidate").alias("status")
    )


def relation_evidence(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    quotes = chunks.select(F.col("id").alias("chunk_id"), T.truncated(F.col("text"), 1000).alias("quote"), "start_line", "end_line")
    return pairs.select(relation_id().alias("relation_id"), "chunk_id").distinct().join(quotes, "chunk_id").select("relation_id", "chunk_id", "quote", "start_line", "end_line")


def orphans(relations_: DataFrame, evidence: DataFrame, entities_: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations without evidence, and entities without mentions."""
    return relations_.join(evidence, relations_["id"] == evidence["relation_id"], "left_anti"), entities_.join(mentions, entities_["id"] == mentions["entity_id"], "left_anti")


def build(pages: DataFrame, chunk_chars: int = chunking.DEFAULT_CHARS, write_chunks: bool = False) -> dict[str, DataFrame]:
    """All tables of the index over pages; entities and relations derive from the mentions.

    Lazily, or with the chunks written first, so that the tables made of them do not cut the pages again.
    """
    chunks = chunking.chunks(pages, chunk_chars)
    chunks = written(chunks, "chunks") if write_chunks else chunks
    documents = pages.drop("text").withColumns({"indexed_at": F.unix_timestamp(), "status": F.lit("indexed")})
    return derived({"documents": documents, "chunks": chunks, "wiki_links": wiki_links(pages), "entity_mentions": chunking.mentions(chunks), "postings": fts.postings(chunks)})


def derived(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    pairs = cooccurrence(tables["entity_mentions"])
    return tables | {"entities": entities(tables["entity_mentions"]), "relations": relations(pairs), "relation_evidence": relation_evidence(pairs, tables["chunks"])}


def plan(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, path, status): added, updated, unchanged or removed, by the digest of the file."""
    new, old = pages.select("path", F.col("id").alias("new_id"), "sha256"), stored.select("path", F.col("id").alias("old_id"), F.col("sha256").alias("old_sha"))
    status = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(F.col("sha256") == F.col("old_sha"), "unchanged").otherwise("updated")
    return new.join(old, "path", "full_outer").select(F.coalesce("new_id", "old_id").alias("id"), "path", status.alias("status"))


class Tables(dict):
    """Tables by name; ``inverted`` is the full text on disk, where there is one."""

    inverted: inverted.Inverted | None = None


def merged_support(old: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """(key, confidence, support): the counts by confidence of old (key, support) and delta (key, confidence, n) added up, keys without any left out."""
    rows = old.select(*key, F.explode("support").alias("s")).select(*key, "s.confidence", "s.n").unionByName(delta.select(*key, "confidence", "n"))
    rows = rows.groupBy(*key, "confidence").agg(F.sum("n").alias("n")).where("n > 0")
    rows = rows.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("confidence", "n"))).alias("support"))
    return rows


def entity_delta(mentions: DataFrame, sign: int) -> DataFrame:
    return mentions.groupBy(F.col("entity_id").alias("id"), "canonical_name", "entity_type", "confidence").agg((F.count("*") * sign).alias("n"))


def relation_delta(mentions: DataFrame, sign: int) -> DataFrame:
    return cooccurrence(mentions).groupBy("subject_entity_id", "object_entity_id", "confidence").agg((F.count("*") * sign).alias("n"))


class Index:
    """The index below a folder that all nodes share.

    Tables of documents lie in buckets by document, entities and relations in buckets by their own ids; a refresh rewrites
    the buckets in which a document, an entity or a relation changed. Entities and relations carry the counts behind
    each confidence, to which a refresh adds what came and what went: nothing else is read for them. Full text is
    kept as segments (inverted.py).
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.store = Store(spark, folder, SCHEMAS)

    def meta(self) -> dict | None:
        return self.store.manifest()

    def exists(self) -> bool:
        return self.meta() is not None

    def opened(self) -> dict | None:
        """The manifest, upgraded if its schema is older; an error if it is newer."""
        meta = self.meta()
        if meta and meta["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the index has the newer schema {meta['schema_version']}")
        while meta and meta["schema_version"] < SCHEMA_VERSION:
            if meta["schema_version"] not in UPGRADES:
                return None  # too old to be read: built anew
            meta = UPGRADES[meta["schema_version"]](self, meta)
        return meta

    def tables(self) -> Tables:
        meta = self.opened()
        if meta is None:
            raise FileNotFoundError(f"no index in {self.folder}; run the index command first")
        out = Tables({t: self.store.read(t, meta["tables"][t]) for t in (*OF_DOCUMENT, "entities", "relations")})
        out.inverted = inverted.Inverted(self.store, meta)
        chunks = out["chunks"]
        out["documents"], out["chunks"] = out["documents"].drop("doc_no"), chunks.drop("doc_no")
        out["entities"], out["relations"] = out["entities"].drop("support"), out["relations"].drop("support")
        out["postings"] = fts.postings(chunks)  # all of them, from the texts; searches take what ``inverted`` stores
        return out

    def vectors(self) -> DataFrame | None:
        """The cache of embedded chunks, which outlives generations; rows of other texts are passed over by their hash."""
        fs, path = self.store.file("vectors")
        return self.spark.read.parquet(f"{self.folder}/vectors") if fs.exists(path) else None

    def keep_vectors(self, rows: DataFrame) -> None:
        """Store the rows that are not there yet: a chunk's text has one vector of a provider, model and size."""
        stored = self.vectors()
        rows = rows.dropDuplicates(VECTOR_KEY)
        if stored is not None:
            rows = rows.join(stored.select(*VECTOR_KEY), VECTOR_KEY, "left_anti")
        if not rows.isEmpty():
            rows.write.mode("append").parquet(f"{self.folder}/vectors")

    def refresh(self, pages: DataFrame, chunk_chars: int = chunking.DEFAULT_CHARS, rebuild: bool = False) -> dict[str, int]:
        """Bring the tables to pages; only changed pages are parsed. Returns counts by status and of rows."""
        meta = self.opened()
        if rebuild or meta is None or meta["indexer"] != INDEXER_VERSION or meta["chunk_chars"] != chunk_chars:
            old = self.meta()
            fresh = self._parsed(pages, chunk_chars, 0)
            found = self._apply(None, fresh, None, chunk_chars)
            n = found["rows"]["documents"]
            return {"updated": 0, "unchanged": 0, "removed": old["rows"]["documents"] if old else 0, "added": n, "scanned": n, **found["rows"]}
        steps = written(plan(pages, self.store.read("documents", meta["tables"]["documents"]).select("id", "path", "sha256")), "plan")
        counts = {"added": 0, "updated": 0, "unchanged": 0, "removed": 0} | {r["status"]: r["count"] for r in steps.groupBy("status").count().collect()}
        scanned = counts["added"] + counts["updated"] + counts["unchanged"]
        if scanned == counts["unchanged"] and not counts["removed"]:
            return counts | {"scanned": scanned, **meta["rows"]}
        new = steps.where("status in ('added', 'updated')").select("id")
        fresh = self._parsed(pages.join(few(new, counts["added"] + counts["updated"]), "id", "left_semi"), chunk_chars, meta["next_doc"])
        found = self._apply(meta, fresh, steps.where("status <> 'unchanged'").select("id", "status"), chunk_chars)
        return counts | {"scanned": scanned, **found["rows"]}

    def _parsed(self, pages: DataFrame, chunk_chars: int, first: int) -> dict[str, DataFrame]:
        """The tables of documents over pages, which are numbered from ``first``."""
        pages = numbered(pages, first)
        chunks = written(chunking.chunks(pages, chunk_chars), "chunks", **PACKED)
        documents = pages.drop("text").withColumns({"indexed_at": F.unix_timestamp(), "status": F.lit("indexed")})
        return self._with_entities({"pages": pages, "documents": documents, "chunks": chunks, "wiki_links": wiki_links(pages)})

    def _with_entities(self, fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
        mentions = written(fresh.get("entity_mentions", chunking.mentions(fresh["chunks"])), "mentions", **PACKED)
        return fresh | {"entity_mentions": mentions, "relation_evidence": relation_evidence(cooccurrence(mentions), fresh["chunks"])}

    def _apply(self, meta: dict | None, fresh: dict[str, DataFrame], changed: DataFrame | None, chunk_chars: int) -> dict:
        """Write the buckets that fresh documents and changed ones (id, status) touch, and point to them."""
        generation = f"generation-{uuid.uuid4().hex}"
        before = self.meta()
        if meta is None:
            n = fresh["documents"].count()
            buckets = self.buckets or min(BUCKETS[1], max(BUCKETS[0], -(-n // DOCUMENTS_PER_BUCKET)))
            tables = {t: {} for t in (*OF_DOCUMENT, "entities", "relations", "gone")}
            meta = {"buckets": buckets, "tables": tables, "segments": [], "gone": 0, "next_doc": 0, "chunks": 0, "tokens": 0, "rows": dict.fromkeys((*OF_DOCUMENT, "entities", "relations"), 0)}
            touched, gone = None, None
        else:
            buckets = meta["buckets"]
            touched = sorted(r[0] for r in changed.select(bucket_of(F.col("id"), buckets)).distinct().collect())  # one for each bucket at most
            gone = written(changed.where("status in ('updated', 'removed')").select(F.col("id").alias("gone_id")), "gone-pages")
            gone = few(gone, gone.count())
        tables, rows = dict(meta["tables"]), dict(meta["rows"])

        def lost(t: str) -> DataFrame:
            return self.store.read(t, meta["tables"][t], touched).join(gone, document_of(t) == F.col("gone_id"), "left_semi")

        def merge(t: str, old: DataFrame, new: Callable[[DataFrame], DataFrame], key: Column, own: list[int] | None) -> None:
            made = {c: f() for c, f in DIGESTS.get(t, {}).items()}
            rows_ = dealt(new(old).drop(*made), bucket_of(key, buckets), (), 1).drop(PART)
            at = self.store.put(rows_.withColumns(made) if made else rows_, generation, t, ())
            left = {} if own is None else {b: g for b, g in meta["tables"][t].items() if int(b) not in own}
            tables[t] = left | at
            rows[t] = rows[t] - old.count() + self.store.read(t, at).count()

        def of_documents(t: str) -> None:
            old = self.store.read(t, meta["tables"][t], touched)
            kept = lambda df: df if gone is None else df.join(gone, document_of(t) == F.col("gone_id"), "left_anti")
            merge(t, old, lambda df: kept(df).unionByName(fresh[t].select(*df.columns)), document_of(t), touched)

        def of_keys(t: str, delta: Callable[[DataFrame, int], DataFrame], key: list[str], id_: Column, made: Callable[[DataFrame], DataFrame]) -> None:
            change = delta(fresh["entity_mentions"], 1)
            if gone is not None:
                change = change.unionByName(delta(lost("entity_mentions"), -1))
                change = change.groupBy(*key, "confidence").agg(F.sum("n").alias("n")).where("n <> 0")
            change = written(change, f"{t}-delta")
            own = None if touched is None else sorted(r[0] for r in change.select(bucket_of(id_, buckets)).distinct().collect())
            if own == []:
                return
            merge(t, self.store.read(t, meta["tables"][t], own), lambda df: made(merged_support(df, change, key)).select(*df.columns), F.col("id"), own)
            discard(change)

        def full_text() -> dict:
            chunks, text = fresh["chunks"], {"segments": list(meta["segments"]), "gone": meta["gone"], "chunks": meta["chunks"], "tokens": meta["tokens"]}
            if gone is not None:
                numbers = self.store.read("documents", meta["tables"]["documents"], touched).join(gone, F.col("id") == F.col("gone_id"), "left_semi").select("doc_no")
                at = self.store.write(numbers, generation, "gone", F.lit(len(meta["tables"]["gone"])), 1)
                tables["gone"] = meta["tables"]["gone"] | at
                text["gone"] += self.store.read("gone", at).count()
                size = F.size(fts.tokens(F.col("text"))) + F.size(fts.tokens(F.col("heading_path")))
                less = lost("chunks").select(size.alias("n")).agg(F.count_if(F.col("n") > 0).alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
                text["chunks"], text["tokens"] = text["chunks"] - less["chunks"], text["tokens"] - less["tokens"]
            documents = fresh["documents"].count()
            state = text | {"tables": tables, "segments": text["segments"] + [{"documents": documents}] * bool(documents)}
            if inverted.crowded(state):  # what is left and what came go into one segment at once
                # texts are a fifth of their rows, so these are made of them anew
                texts = self.store.read("chunks", meta["tables"]["chunks"])
                texts = texts if gone is None else texts.join(gone, document_of("chunks") == F.col("gone_id"), "left_anti")
                left = sum(s["documents"] for s in state["segments"]) - text["gone"]
                segment = inverted.write(self.store, texts.unionByName(chunks.select(*texts.columns)), generation, left)
                more = inverted.size(self.store, chunks, segment["at"])
                tables["gone"] = {}
                return {"segments": [segment], "gone": 0, "chunks": text["chunks"] + more[0], "tokens": more[1]}
            if documents:
                segment = inverted.write(self.store, chunks, generation, documents)
                more = inverted.size(self.store, chunks, segment["at"])
                text["chunks"], text["tokens"] = text["chunks"] + more[0], text["tokens"] + more[1]
                text["segments"].append(segment)
            return text

        jobs: list[Callable[[], object]] = [lambda t=t: of_documents(t) for t in OF_DOCUMENT]
        jobs.append(lambda: of_keys("entities", entity_delta, ["id", "canonical_name", "entity_type"], F.col("id"), lambda df: df.withColumns({"aliases": F.array().cast("array<string>"), "status": F.lit("candidate")})))
        jobs.append(lambda: of_keys("relations", relation_delta, ["subject_entity_id", "object_entity_id"], relation_id(), lambda df: df.withColumns({"id": relation_id(), "predicate": F.lit(PREDICATE), "extractor": F.lit("rule:chunk-cooccurrence"), "status": F.lit("candidate")})))
        jobs.append(full_text)
        with ThreadPoolExecutor(len(jobs)) as pool:  # jobs of a few stages each; together they fill the cluster
            text = [f.result() for f in [pool.submit(j) for j in jobs]][-1]
        top = fresh["documents"].agg(F.max("doc_no")).first()[0]
        out = {"generation": generation, "schema_version": SCHEMA_VERSION, "indexer": INDEXER_VERSION, "chunk_chars": chunk_chars, "buckets": buckets, "tables": tables, "rows": rows, "next_doc": meta["next_doc"] if top is None else top + 1, **text}
        self.store.point(out)
        self.store.expire(out, before if before and "segments" in before else None)
        discard(fresh["pages"], fresh["chunks"], fresh["entity_mentions"])
        return out


def numbered(pages: DataFrame, first: int) -> DataFrame:
    """pages with doc_no, whole numbers from ``first`` without gaps; pages are written, so that numbers stay."""
    rows = written(pages.withColumn("at", F.monotonically_increasing_id()), "pages", **PACKED)
    part = F.shiftright("at", 33)  # the task that wrote the row, and below it the row's place in the task
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())  # a row for each task
    starts, n = [], first
    for p, size in sizes:
        starts.append((p, n))
        n += size
    offsets = pages.sparkSession.createDataFrame(starts, "part long, start long")
    out = rows.withColumn("part", part).join(F.broadcast(offsets), "part")  # as many rows as tasks
    out = out.withColumn("doc_no", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "at")
    out.written_at = rows.written_at
    return out


def few(ids: DataFrame, n: int) -> DataFrame:
    """ids to be joined with texts: up to so many are broadcast, so that no text is sent for them."""
    return F.broadcast(ids) if n <= inverted.BROADCAST_GONE else ids


def _from_3(own: Index, meta: dict) -> dict:
    """Version 3 had whole tables in one folder, and postings by chunk; pages are not parsed again."""
    flat = {t: own.spark.read.parquet(f"{own.folder}/{meta['generation']}/{t}") for t in ("documents", "chunks", "wiki_links", "entity_mentions")}
    documents = numbered(flat["documents"], 0)
    numbers = documents.select(F.col("id").alias("document_id"), "doc_no")
    fresh = {"pages": documents, "documents": documents, "chunks": written(flat["chunks"].join(numbers, "document_id"), "chunks"), "wiki_links": flat["wiki_links"], "entity_mentions": flat["entity_mentions"]}
    return own._apply(None, own._with_entities(fresh), None, meta["chunk_chars"])


def _from_4(own: Index, meta: dict) -> dict:
    """Version 4 had no blocks beside its segments."""
    generation = f"generation-{uuid.uuid4().hex}"
    segments = [inverted.with_blocks(own.store, s, f"{generation}-{k}") for k, s in enumerate(meta["segments"])]
    out = meta | {"schema_version": 5, "segments": segments}
    own.store.point(out)
    return out


def _from_5(own: Index, meta: dict) -> dict:
    """Version 5 had all blocks beside its segments; they are read there until the segments are merged."""
    out = meta | {"schema_version": 6}
    own.store.point(out)
    return out


#: steps from a schema to a newer one
UPGRADES: dict[int, Callable[[Index, dict], dict]] = {3: _from_3, 4: _from_4, 5: _from_5}
