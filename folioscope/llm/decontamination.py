"""Benchmark decontamination (7): prefix-filtered containment join of item windows and documents.

Every 13 consecutive words of a benchmark item are a window (an item of fewer words is one window).
A window is a set of three-word shingles that a document must contain all of, so its prefix of one
shingle is necessary: the rarest one, by counts over all documents. Windows whose rarest shingle
stands in no document are done.

The documents' shingles are equi-joined with the prefixes. A task sends on only shingles that a bitmap
of the wanted ones lets through (of bounded size; what it lets through wrongly the join drops), each
with its place and the words around it. Texts are read in stretches of bounded size that overlap by a
window, and what is sent of a text is cut into rows of bounded size, so that a task holds no more
for a very long text, unless one word of it is longer. The prefix's place in the window gives the only possible
start, the window must fit between the document's ends, and then its words are compared. Documents
are read twice, for the counts and for the join, whatever the size of the benchmark. Prefixes up to
``BROADCAST_ROWS`` are broadcast, a checked size; beyond, both sides are dealt out by shingle and a salt,
so that a shingle in a third of all documents is many keys.

Defined cases: null and empty texts have no words (n_words 0, not contaminated); items without
words or without an id match nothing; items that share an id count once; repeated rows are judged
once each; extra columns are ignored, or kept by ``decontaminate``, whatever their names; without items
nothing is hit; an empty documents table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fail_unless, fits_broadcast, free_names, own_columns, remember, small_batches, written
from .jaccard_join import NO_ID, Words, _factor

WINDOW = 13
SHINGLE = 3
#: contaminated if this many times the hit words reach the words
SHARE = 20
WORD_BYTES = bytes(LOWER_BYTES[b] if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
#: rows of a table that may be broadcast, some 30 MB
BROADCAST_ROWS = 200_000
SALTS = 32
#: the bitmap: places for each wanted shingle, and the logarithms of its least and greatest size (16 MB)
PLACES_EACH, LEAST_BITS, MOST_BITS = 64, 16, 27
#: item words that are sent to the tasks; beyond, all words of documents are hashed
MOST_VOCABULARY = 500_000
COUNTED_AT_ONCE = 1 << 20
#: bytes of text that are cut into words at once, and bytes of words that one row, and one batch, of what was found holds
STRETCH_BYTES, ROW_BYTES, SENT_BYTES = 1 << 22, 1 << 19, 1 << 22

_words = Words()


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def stretches(text: bytes, before: int, after: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(first, own, upto, words): the words of a text in stretches of about STRETCH_BYTES. words start with the word ``first`` of the
    text; the stretch's own are those from place own to upto, with up to ``before`` words in front and ``after`` behind them."""
    kept: list[bytes] = []
    first, own, at = 0, 0, 0
    while True:
        end = min(len(text), at + STRETCH_BYTES)
        piece = text[at:end].translate(WORD_BYTES)
        if end < len(text):
            # the stretch ends where a word does; a word longer than it goes on until there is an end
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):
                end = min(len(text), at + 2 * (end - at))
                piece = text[at:end].translate(WORD_BYTES)
                cut = piece.rfind(b" ")
            if end < len(text):
                piece, end = piece[: cut + 1], at + cut + 1
        kept += piece.split()
        at = end
        last = at >= len(text)
        upto = len(kept) if last else max(own, len(kept) - after)
        yield first, own, upto, kept
        if last:
            return
        drop = max(0, upto - before)
        kept, first, own = kept[drop:], first + drop, upto - drop


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def keys(h: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """The hashes (uint64) of the shingles of k words at the places ``at``."""
    with np.errstate(over="ignore"):
        out = np.full(len(at), k, np.uint64)
        for j in range(k):
            out += h[at + j] * _factor(j)
    return out


def _windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("benchmark words", _words.clear)
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                k = min(SHINGLE, len(words))
                own = keys(hashes(words), k, np.arange(len(words) - k + 1)).view(np.int64).tolist() if words else []
                for start in range(max(1, len(words) - window + 1) if words else 0):
                    n = min(window, len(words))
                    rows.append((item, b" ".join(words[start : start + n]).decode("utf-8", "replace"), n, own[start : start + n - k + 1]))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item_id", "window", "length", "shingles"])

    return cut


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window, length, shingles) of every item; a window is its words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    return items.mapInArrow(_windows(window), "item_id string, window string, length int, shingles array<long>").distinct()


class Wanted(NamedTuple):
    """What a task looks for: a bitmap over shingles, their widths, and the words of items, if they are few."""

    bitmap: np.ndarray
    bits: int
    widths: tuple[int, ...]
    vocabulary: dict[bytes, int] | None

    def hashed(self, words: list[bytes]) -> np.ndarray:
        """The words' hashes; 0 for a word of no item."""
        return hashes(words) if self.vocabulary is None else np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))

    def standing(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the shingles of k words that may be wanted."""
        within = h != 0
        at = within[: max(0, len(h) - k + 1)].copy()
        for j in range(1, k):
            at &= within[j : len(h) - k + 1 + j]
        at = np.flatnonzero(at)
        own = keys(h, k, at)
        high, low = own >> np.uint64(64 - self.bits), own & np.uint64((1 << self.bits) - 1)
        one, six, last = np.uint64(1), np.uint64(6), np.uint64(63)
        found = (self.bitmap[high >> six] >> (high & last)) & (self.bitmap[low >> six] >> (low & last)) & one
        keep = found.astype(bool)
        return at[keep], own[keep].view(np.int64)


def wanted(shingles: DataFrame, widths: tuple[int, ...], vocabulary: dict[bytes, int] | None) -> Wanted:
    """The bitmap of shingles (shingle long); at most 2**21 numbers of 64 places reach the driver."""
    bits = max(LEAST_BITS, min(MOST_BITS, (PLACES_EACH * shingles.count()).bit_length()))
    high, low = F.shiftrightunsigned("shingle", 64 - bits), F.col("shingle").bitwiseAND((1 << bits) - 1)
    places = shingles.select(F.explode(F.array(high, low)).alias("place"))
    by_word = places.groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))).alias("own")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[by_word["word"].to_numpy()] = by_word["own"].to_numpy().view(np.uint64)
    return Wanted(bitmap, bits, widths, vocabulary)


def vocabulary_of(windows: DataFrame, most: int = MOST_VOCABULARY) -> dict[bytes, int] | None:
    """The hashes of the words of items, unless they are too many to be sent."""
    words = windows.select(F.explode(F.split("window", " ", -1)).alias("word")).distinct().limit(most + 1).toArrow()["word"]
    if len(words) > most:
        return None
    own = words.cast(pa.binary()).to_pylist()
    return dict(zip(own, hashes(own).tolist()))


def shingle_counts(documents: DataFrame, sought: Wanted) -> DataFrame:
    """(shingle, c): how often the shingles that may be wanted stand in all documents."""
    sent = documents.sparkSession.sparkContext.broadcast(sought)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("benchmark words", _words.clear)
        own, pending, size = sent.value, [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *pending]), return_counts=True)
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["shingle", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist():
                for _, low, upto, words in stretches(text, 0, SHINGLE - 1):
                    h = own.hashed(words)
                    for k in own.widths:
                        at, shingles = own.standing(h, k)
                        pending.append(shingles[(at >= low) & (at < upto)])
                        size += len(pending[-1])
                    if size >= COUNTED_AT_ONCE:
                        size = 0
                        yield flush()
        yield flush()

    return documents.select("text").mapInArrow(count, "shingle long, c long").groupBy("shingle").agg(F.sum("c").alias("c"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, place, window, length): each window's shingle of the lowest count (the first of equals), if it stands anywhere."""
    rows = windows.select("window", "length", F.posexplode("shingles").alias("place", "shingle"))
    rows = rows.join(counts, "shingle", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    best = rows.groupBy("window").agg(F.min(F.struct("c", "place", "shingle")).alias("best"), F.first("length").alias("length"))
    return best.where("best.c > 0").select(F.col("best.shingle").alias("shingle"), F.col("best.place").alias("place"), "window", "length")


_FOUND = "id long, hash long, part int, some boolean, n_words long, found array<struct<shingle: long, at: int, before: int, words: string>>"


def described(documents: DataFrame, sought: Wanted, window: int = WINDOW) -> DataFrame:
    """(id, hash, part, some, n_words, found) of (id, hash, text): the shingles that may be wanted, their places, and the words around them.

    A text is one row of part 0, with the count of its words and whether any row of it holds a shingle, and rows of further parts where
    ROW_BYTES are passed.
    """
    sent = documents.sparkSession.sparkContext.broadcast(sought)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("benchmark words", _words.clear)
        own = sent.value
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), kind)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "hash", "part", "some", "n_words", "found"])

        for batch in batches:
            for id_, hash_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).fill_null(b"")):
                found, size, part, n_words = [], 0, 1, 0
                for first, start, upto, words in stretches(text.as_py(), window, window):
                    h = own.hashed(words)
                    for k in own.widths:
                        for at, shingle in zip(*(x.tolist() for x in own.standing(h, k))):
                            if not start <= at < upto:
                                continue
                            low = max(0, at - window + k)
                            around = b" ".join(words[low : at + window])
                            found.append({"shingle": shingle, "at": first + at, "before": at - low, "words": around.decode("utf-8", "replace")})
                            size += len(around)
                            if size >= ROW_BYTES:
                                rows.append((id_, hash_, part, True, None, found))
                                found, held, size, part = [], held + size, 0, part + 1
                                if held >= SENT_BYTES:
                                    held = 0
                                    yield flush()
                    n_words = first + len(words)
                rows.append((id_, hash_, 0, part > 1 or bool(found), n_words, found))
                held += size
                if held >= SENT_BYTES:
                    held = 0
                    yield flush()
            yield flush()

    return documents.mapInArrow(scan, _FOUND)


def hits(scanned: DataFrame, prefix: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, hash, start, end, window): the windows that occur in a document, verified word by word."""
    rows = scanned.select("id", "hash", F.explode("found").alias("f")).select("id", "hash", "f.*")
    if fits_broadcast(prefix, broadcast_rows):
        pairs = rows.join(F.broadcast(prefix), "shingle")
    else:
        copies = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = rows.withColumn("salt", F.pmod(F.xxhash64("id", "hash", "at"), F.lit(SALTS)).cast("int")).join(copies.hint("shuffle_hash"), ["shingle", "salt"])
    start = F.col("at") - F.col("place")
    # the words around a place end with the text, so a window that passes its end is cut short and does not match
    pairs = pairs.where((start >= 0) & (F.col("before") >= F.col("place")))
    same = F.array_join(F.slice(F.split("words", " ", -1), F.col("before") - F.col("place") + 1, F.col("length")), " ") == F.col("window")
    return pairs.where(same).select("id", "hash", start.cast("long").alias("start"), (start + F.col("length")).cast("long").alias("end"), "window")


def covered(spans: Column) -> Column:
    """How many places lie in any of the spans (array of struct<start, end>)."""
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), none, step, lambda acc: acc["n"])


def _key(documents: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash")]


def judged(documents: DataFrame, benchmark: DataFrame, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, hash, n_words) of all documents, and (id, hash, n_hit, items, contaminated) of those that are hit; both written."""
    fail_unless(("doc_id", "text"), documents, "documents")
    fail_unless(("item_id", "text"), benchmark, "benchmark")
    small_batches(documents.sparkSession)
    windows = written(windows_of(benchmark), "windows")
    widths = tuple(sorted(r["k"] for r in windows.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect()))
    vocabulary = vocabulary_of(windows)
    single = windows.dropDuplicates(["window"]).select("window", "length", "shingles")
    counts = shingle_counts(documents, wanted(single.select(F.explode("shingles").alias("shingle")).distinct(), widths, vocabulary))
    prefix = written(prefixes(single, counts), "prefixes")
    rows = documents.select(*_key(documents), "text")
    scanned = written(described(rows, wanted(prefix.select("shingle").distinct(), widths, vocabulary)), "scanned")
    found = hits(scanned.where(F.size("found") > 0), prefix, broadcast_rows)
    spans = found.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set("window").alias("windows"))
    spans = written(spans, "spans")
    owners = windows.select("window", "item_id").distinct()
    items = spans.select("id", "hash", F.explode("windows").alias("window")).join(owners, "window").groupBy("id", "hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = spans.select("id", "hash", covered(F.col("spans")).alias("n_hit")).join(items, ["id", "hash"])
    words = scanned.where("part = 0 and some").select("id", "hash", F.col("n_words").alias("of")).distinct()
    hit = hit.join(words, ["id", "hash"]).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("of"))).drop("of")
    return scanned.where("part = 0").select("id", "hash", "n_words"), written(hit, "hit")


def contamination(documents: DataFrame, benchmark: DataFrame, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, hit = judged(documents, benchmark, share, broadcast_rows)
    hit = hit.select("id", "hash", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
    out = rows.join(F.broadcast(hit) if fits_broadcast(hit, broadcast_rows) else hit.hint("shuffle_hash"), ["id", "hash"], "left")
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    _, hit = judged(documents, benchmark, share, broadcast_rows)
    id_, hash_ = free_names(documents, "id", "hash")
    gone = hit.where("contaminated").select(F.col("id").alias(id_), F.col("hash").alias(hash_))
    gone = F.broadcast(gone) if fits_broadcast(gone, broadcast_rows) else gone.hint("shuffle_hash")
    own = documents.withColumns({id_: _key(documents)[0], hash_: _key(documents)[1]})
    return own.join(gone, [id_, hash_], "left_anti").select(*own_columns(documents))
