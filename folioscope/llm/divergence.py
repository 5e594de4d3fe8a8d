"""Source divergence audit (12): how far the words of each source of a language are from those of the others.

Sort-based streaming. Tasks count the terms of their documents; the counts are dealt out by (lang, term) and sorted within
partitions by (lang, term, source, document), and a run-length scan gives document frequency and counts of
each run, keeping the terms that stand in enough documents. Counts and sources of a language, dealt out by
(lang, block of sources, shard of terms) and sorted with the sources before the terms, go through a second scan: each run
of a term gives its share of every pair of sources, which the task adds up, and the terms that stand out.

The documents of a task are combined before they are shuffled, since one word may stand in nearly all of them: what is sorted
are runs of one term, source and task, each under its first document. A task holds the counts of at most
ENTRIES terms, the sources of one language and CELLS sums of pairs; neither terms nor documents are ever
gathered. Where a language has so many sources that their pairs are more than CELLS, they are cut into
blocks, and each block's pairs are added up apart. Integers are exact throughout.

Defined cases: null text, lang and source are empty strings; each row is a document, repeated rows and repeated ids
included; languages without a kept term have pairs of value 0 and no terms; a language of one source has no pairs; extra
columns are ignored; an empty table gives no rows. Counts are 64-bit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fail_unless, written

#: documents of a language in which a term must stand, and ranks of terms returned
DOCUMENTS, RANKS = 3, 200
#: shares are of so many parts
PARTS = 10**9
#: terms and bytes of terms counted in a task before they are given on
ENTRIES, ENTRY_BYTES = 500_000, 32 << 20
#: sums of pairs that a task holds
CELLS = 1 << 22
#: whatever is no letter A-Z and below 128 is a blank; A-Z is lower-cased
TERM_BYTES = bytes(c if c > 127 or chr(c) in LOWER else ord(chr(c).lower()) if chr(c) in UPPER else 32 for c in range(256))

#: key is lang, a zero byte and the term, which holds no zero byte: one column to sort by
COUNTED = "key binary, source string, document long, df long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, doc_id, text as bytes) to COUNTED: a row for each term and group of the documents since the last rows."""
    counts: dict[tuple[str, str], tuple[Counter, Counter, int | None]] = {}
    entries = size = 0
    for batch in batches:
        for lang, source, document, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "doc_id", "text"))):
            terms = text.translate(TERM_BYTES).split()
            if (lang, source) not in counts:
                counts[lang, source] = Counter(), Counter(), document
            df, n, _ = counts[lang, source]
            own = set(terms)
            new = [t for t in own if t not in df]
            entries, size = entries + len(new), size + sum(map(len, new))
            n.update(terms)
            df.update(own)
            if entries > ENTRIES or size > ENTRY_BYTES:
                yield from _rows(counts)
                counts, entries, size = {}, 0, 0
    yield from _rows(counts)


def _rows(counts: dict[tuple[str, str], tuple[Counter, Counter, int | None]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (df, n, document) in counts.items():
        terms, head = list(df), lang.encode() + b"\0"
        for k in range(0, len(terms), 1 << 14):
            part = terms[k : k + (1 << 14)]
            m = len(part)
            columns = [[head + t for t in part], [source] * m, [document] * m, [df[t] for t in part], [n[t] for t in part]]
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "source", "document", "df", "n"])


def _starts(table: pa.Table, *keys: str) -> np.ndarray:
    """The places at which another run of the keys begins, in a sorted table of at least one row."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _keep(least: int):  # noqa: ANN202
    """Sorted rows of COUNTED to (lang, term, source, n, first): the runs of terms of at least so many documents; first marks one row a term."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # the runs of the last term, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if open_ is not None:
                rows = pa.concat_tables([open_, rows])
            starts = _starts(rows, "key", "source")
            runs = rows.take(pa.array(starts))
            for name in ("df", "n"):
                runs = runs.set_column(runs.schema.get_field_index(name), name, pa.array(np.add.reduceat(rows.column(name).to_numpy(), starts)))
            terms = _starts(runs, "key")
            open_ = runs.slice(int(terms[-1])).combine_chunks()
            yield from closed(runs.slice(0, int(terms[-1])), terms[:-1])
        if open_ is not None:
            yield from closed(open_, np.zeros(1, np.int64))

    def closed(runs: pa.Table, terms: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(runs):
            return
        length = np.diff(np.append(terms, len(runs)))
        enough = np.add.reduceat(runs.column("df").to_numpy(), terms) >= least
        keys = [k.rpartition(b"\0") for k in runs.column("key").take(pa.array(terms[enough])).to_pylist()]
        of = pa.array(np.repeat(np.arange(len(keys)), length[enough]))
        first = np.zeros(len(runs), bool)
        first[terms] = True
        left = runs.append_column("first", pa.array(first)).filter(pa.array(np.repeat(enough, length)))
        lang, term = pa.array([k[0].decode() for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary())
        columns = [lang.take(of), term.take(of), *(left.column(c).combine_chunks() for c in ("source", "n", "first"))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "first"])

    return scan


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(PARTS * (count + 1) / (total + terms)), exactly."""
    a, m = np.broadcast_arrays(counts + 1, np.asarray(total) + terms)
    if a.size and int(m.max()) < (1 << 62) // PARTS:
        return 1 + PARTS * (a // m) + PARTS * (a % m) // m
    return np.array([1 + PARTS * int(x) // int(y) for x, y in zip(a.ravel(), m.ravel())], np.int64).reshape(a.shape)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Block:
    """Sums of pairs (a source of the block, any source) over the terms of a shard of a language."""

    def __init__(self, lang: str, block: int, shard: int, sources: pa.Array, totals: np.ndarray, terms: int, width: int) -> None:
        self.lang, self.shard, self.sources, self.totals, self.terms = lang, shard, sources, totals, terms
        self.low, self.high = block * width, min((block + 1) * width, len(sources))
        self.absent = shares(np.zeros(len(sources), np.int64), totals, terms) if terms else np.ones(len(sources), np.int64)
        self.all = int(totals.sum())
        # of a term that stands nowhere; each term counts as one, once, and the runs then give what they differ by
        self.base = distance(self.absent[self.low : self.high, None], self.absent[None, :])
        self.sums = self.base * terms if shard == 0 else np.zeros_like(self.base)

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole runs of terms, as many at a time as CELLS allow; gives the terms that stand out."""
        slots = pc.index_in(rows.column("source"), value_set=self.sources).to_numpy().astype(np.int64)
        counts, starts = rows.column("n").to_numpy(), _starts(rows, "term")
        ends = np.append(starts[1:], len(rows))
        terms = rows.column("term").take(pa.array(starts))
        k = 0
        while k < len(starts):
            upto = max(k + 1, int(np.searchsorted(ends, starts[k] + CELLS // 4 // len(self.sources), "right")))
            a, b = starts[k], ends[upto - 1]
            yield from self._add(slots[a:b], counts[a:b], starts[k:upto] - a, terms.slice(k, upto - k))
            k = upto

    def _add(self, slots: np.ndarray, counts: np.ndarray, starts: np.ndarray, terms: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slots))))
        own = shares(counts, self.totals[slots], self.terms)
        p = np.tile(self.absent, (len(starts), 1))
        p[of, slots] = own
        present = np.zeros(p.shape, bool)
        present[of, slots] = True
        present = present[:, self.low : self.high]
        # sources of the block that have the term, against all
        mine = np.flatnonzero((slots >= self.low) & (slots < self.high))
        for g, at in _grouped(slots[mine] - self.low):
            e = mine[at]
            self.sums[g] += distance(own[e][:, None], p[of[e]]).sum(0) - self.base[g] * len(e)
        # those that lack it, against sources that have it
        lacking = self.absent[self.low : self.high]
        for h, at in _grouped(slots):
            apart = np.where(present[of[at]], 0, distance(lacking[None, :], own[at][:, None]) - self.base[:, h][None, :])
            self.sums[:, h] += apart.sum(0)
        q = shares(np.add.reduceat(counts, starts), self.all, self.terms)[of]
        out = mine[own[mine] > q[mine]]
        if len(out):
            yield _out(self.lang, self.sources.take(pa.array(slots[out])), terms.take(pa.array(of[out])).combine_chunks(), distance(own[out], q[out]), "term")

    def pairs(self) -> Iterator[pa.RecordBatch]:
        items = self.sources.cast(pa.binary())
        for g in range(self.low, self.high):
            row = self.sums[g - self.low]
            at = np.flatnonzero((row != 0) | (self.shard == 0))
            at = pa.array(at[at != g])
            if len(at):
                yield _out(self.lang, self.sources.take(pa.array([g] * len(at))), items.take(at), row[at.to_numpy()], "pair")


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and its places."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(keys[at[0]]), at


def _out(lang: str, sources: pa.Array, items: pa.Array, values: np.ndarray, part: str) -> pa.RecordBatch:
    m = len(values)
    return pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), sources, pa.array([part] * m, pa.string()), items, pa.array(values)], ["lang", "source", "part", "item", "value"])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of sources (term empty) and of counts to partial pairs and to terms apart."""
    block: Block | None = None

    def stretch(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The sources of a block, or whole runs of its terms."""
        nonlocal block
        one = rows.slice(0, 1).to_pylist()[0]
        if one["term"]:
            yield from block.add(rows)
            return
        if block is not None:
            yield from block.pairs()
        block = Block(one["lang"], one["block"], one["shard"], rows.column("source").combine_chunks(), rows.column("n").to_numpy(), one["terms"], one["width"])

    def stretches(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(rows):
            marked = rows.append_column("header", pc.equal(rows.column("term"), b""))
            starts = np.append(_starts(marked, "lang", "block", "shard", "header"), len(rows))
            for k, end in zip(starts, starts[1:]):
                yield from stretch(rows.slice(int(k), int(end - k)))

    open_ = None  # the last run, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if open_ is not None:
            rows = pa.concat_tables([open_, rows])
        last = int(_starts(rows, "lang", "block", "shard", "term")[-1])
        yield from stretches(rows.slice(0, last))
        open_ = rows.slice(last).combine_chunks()
    if open_ is not None:
        yield from stretches(open_)
        yield from block.pairs()


def divergence(documents: DataFrame, least: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """Per language, source and part: lang, source, part (pair or term), item, value, rank."""
    fail_unless(("doc_id", "text", "lang", "source"), documents, "documents")
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    texts = documents.select(empty("lang"), empty("source"), F.col("doc_id").cast("long").alias("doc_id"), empty("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_count, COUNTED).repartition(partitions, "key").sortWithinPartitions("key", "source", "document")
    kept = written(counted.mapInArrow(_keep(least), "lang string, term binary, source string, n long, first boolean"), "kept-terms")

    groups = documents.select(empty("lang"), empty("source")).distinct()
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("m")).join(langs, "lang", "left")
    width = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(CELLS) / F.col("m")))
    sizes = sizes.select("lang", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"), width.alias("width"), F.ceil(F.col("m") / width).alias("blocks"))
    sizes = written(sizes, "languages")  # a row each
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    shards = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(partitions - 1).cast("long"))).alias("shard")
    headers = totals.join(sizes, "lang").select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("n"), "terms", "width", blocks).select("*", shards)
    headers = headers.select("lang", "block", "shard", F.lit(b"").alias("term"), "source", "n", "terms", "width")
    runs = kept.join(sizes, "lang").select("lang", "source", "term", "n", blocks)
    none = F.lit(0).cast("long")
    runs = runs.select("lang", "block", F.pmod(F.xxhash64("term"), F.lit(partitions)).cast("long").alias("shard"), "term", "source", "n", none.alias("terms"), none.alias("width"))
    stream = headers.unionByName(runs).repartition(partitions, "lang", "block", "shard").sortWithinPartitions("lang", "block", "shard", "term", "source")
    found = written(stream.mapInArrow(_audit, "lang string, source string, part string, item binary, value long"), "partial-pairs")

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms.select(pairs.columns)).withColumn("item", F.col("item").cast("string"))
