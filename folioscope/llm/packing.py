"""Best-fit packing (4): bound-certified repacking of documents into sequences of a fixed length.

A document is its token ids and one closing id. Documents longer than a sequence are cut into whole
sequences and a rest; those whole pieces need no packing. All other pieces are dealt into partitions
of bounded size, each packed by best-fit decreasing. Dual feasible functions (Fekete and Schepers,
2001: the u^(k) family and the threshold functions of Martello and Toth) give a lower bound on the
number of sequences of a partition; a partition that meets its bound is certified, it stays as it
is. Partitions with a gap keep their full sequences and exchange the pieces of all others: these
are dealt anew among fewer partitions and packed again, until the bound is met, one partition is
left, or a round has settled less than a tenth of its pieces. What is packed last stays as it is:
some sequences of it may not be certified. ``certificate`` tells the number of sequences of a whole
packing and the bound for it.

Defined cases: null text is empty; an empty document is one piece of length 1 (its closing id);
repeated rows are packed once each; ties in length are broken by id and piece; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fail_unless, small_batches, written
from .token_ids import memo, read_tokenizer

SEQUENCE = 4096
CLOSING_ID = 1
PIECES_PER_PARTITION = 4096
KEPT = ("doc_id", "piece", "start", "length", "ids_crc32")
MOST_ROUNDS = 100
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", part long, bin long, offset long, fill long, bound long, bins long"


def pieces(documents: DataFrame, tokenizer_json: str, capacity: int = SEQUENCE) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    fail_unless(("doc_id", "text"), documents, "documents")
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(tokenizer_json)
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(sent.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.ids(texts)):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order: the bin and the offset of each, and the fill of each bin.

    Open bins stand in stacks by the room they have left; a bit mask finds the least sufficient room.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + ((fitting & -fitting).bit_length() - 1)
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += length
        if left := room - length:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of lengths has fewer bins."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The best of the dual feasible functions, of the number of pieces of each length up to capacity."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    # thresholds e <= capacity / 2: above capacity - e a whole bin, between e and that the length itself, below e nothing
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e + 1]
    middle = volume[capacity - e + 1] - volume[e]
    best = max(best, int((large + -(-middle // capacity)).max()))
    # and above half each needs a bin of its own, at the least
    best = max(best, int(number[-1] - number[capacity // 2 + 1]))
    # u^(k): x (k + 1) / capacity if that is whole, else its floor / k
    for k in range(1, 65):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def _pack(capacity: int):
    def pack(t: pa.Table) -> pa.Table:
        t = t.select(["doc_id", "piece", "start", "length", "ids_crc32", "part"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        n = len(lengths)
        same = lambda v: pa.array(np.full(n, v, np.int64))
        for name, column in (("bin", pa.array(bins)), ("offset", pa.array(offsets)), ("fill", pa.array(fills[bins])), ("bound", same(lower_bound(lengths, capacity))), ("bins", same(len(fills)))):
            t = t.append_column(name, column)
        return t

    return pack


def pack(cut: DataFrame, capacity: int = SEQUENCE, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Pieces with sequence_id and offset.

    A round packs every partition and certifies it by its bound. Full sequences are done in any
    case; in a certified partition so are those filled to fifteen sixteenths. The pieces of all
    others are dealt anew and packed again. The last round, without exchange, is the one with a
    single partition, or the one after a round that settled less than a tenth.
    """
    whole = cut.where(F.col("length") == capacity)
    # (round, part, bin) in one number; whole pieces, of round 0, are numbered as they are read
    done = [whole.select(*KEPT, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_ = cut.where(F.col("length") < capacity).select(*KEPT)
    left, stuck = open_.count(), False
    for round_ in range(1, MOST_ROUNDS + 1):
        if not left:
            break
        parts = max(1, -(-left // per_partition))
        last = parts == 1 or stuck or round_ == MOST_ROUNDS
        dealt = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(round_), *KEPT), F.lit(parts)).cast("long"))
        packed = written(dealt.groupBy("part").applyInArrow(_pack(capacity), PACKED), f"packed-{round_}")
        certified = F.col("bins") == F.col("bound")
        settled = F.lit(last) | (F.col("fill") == capacity) | (certified & (F.col("fill") * 16 >= capacity * 15))
        number = F.shiftleft(F.lit(round_).cast("long"), 56) + F.shiftleft("part", 24) + F.col("bin")
        done.append(packed.where(settled).select(*KEPT, number.alias("sequence_id"), "offset"))
        if last:
            break
        open_ = packed.where(~settled).select(*KEPT)
        before, left = left, open_.count()
        stuck = left > 0.9 * before
    return reduce(DataFrame.unionByName, done)


def certificate(packed: DataFrame, capacity: int = SEQUENCE) -> tuple[int, int]:
    """How many sequences a packing has, and the lower bound of any packing of its pieces.

    A histogram of lengths, capacity numbers at most, is all that reaches the driver.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    return packed.where(F.col("offset") == 0).count(), bound_of_counts(counts, capacity)


def best_fit_packing(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of documents."""
    cut = written(pieces(documents, read_tokenizer(tokenizer_path), capacity), "pieces")
    return pack(cut, capacity)
