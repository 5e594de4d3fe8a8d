"""Exact dedup (10): a minimal perfect hash over the distinct digests of history, byte-checked lookups.

History is a table of distinct digests, each with its winner (largest id) and group size. It is
dealt into shards by digest; each shard becomes one minimal perfect hash (hash and displace) whose
slots hold the full digest, the winner's locator and the size. The distinct digests of the arrivals
are routed to their shards and looked up; the slot's 32 bytes are compared, since a perfect hash
sends nonmembers to some slot as well. Members are repeats of history: the slot's winner and size are
merged with those of the arrivals. Nonmembers form groups of their own.

What is then known, history with its merged slots and the new groups, becomes the next index, and
each row takes its winner from the slot of its digest. Shards are of bounded size and a shard that
many rows ask for is copied, so that a digest held by a third of all rows is looked up by many tasks.

``exact_dedup`` judges arrivals against a history; ``dedup`` judges one table of documents, of which the
older half by id (up to the middle of the least and the greatest id) is the history and the rest,
rows without an id among them, the arrivals.

Defined cases: null text counts as empty; empty texts form one group; a null id never wins over
another id; repeated rows are rows of the group like any other (all rows with the winning id are
kept); extra columns are ignored; an empty table, an empty history and no arrivals give what the
other side has, or an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fail_unless, written

DIGESTS_PER_SHARD = 4096
ROWS_PER_LOOKUP = 2048
KEYS_PER_BUCKET = 4
SEEDS = 1 << 16


def _mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 over x, moved by seed."""
    with np.errstate(over="ignore"):
        z = x + (np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and slots of distinct 64-bit keys: slot = mix(key, displacement[bucket]) mod n."""
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = (_mix(keys, SEEDS) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(counts)])
    taken = np.zeros(n, bool)
    shift, slot = np.zeros(buckets, np.uint32), np.zeros(n, np.int64)
    step = np.arange(256, dtype=np.uint64)
    for b in np.argsort(-counts, kind="stable"):
        if not counts[b]:
            break
        own = order[starts[b] : starts[b + 1]]
        for base in range(0, 1 << 31, 256):
            at = (_mix(keys[own][None, :], (step + np.uint64(base))[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if len(own) > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                shift[b], slot[own] = base + k, at[k]
                taken[at[k]] = True
                break
    return shift, slot


def slots_of(shift: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    bucket = (_mix(keys, SEEDS) % np.uint64(len(shift))).astype(np.int64)
    return (_mix(keys, shift[bucket].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _keys(digests: np.ndarray) -> np.ndarray:
    """The 64-bit keys of rows of 32 digest bytes."""
    return np.ascontiguousarray(digests[:, 8:16]).view("<u8").ravel()


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    digests = _rows(t["digest"])
    shift, slot = perfect_hash(_keys(digests))
    place = np.empty(len(slot), np.int64)
    place[slot] = np.arange(len(slot))
    locators = np.array(t["keep_id"].fill_null(0).to_numpy())[place].astype("<i8")
    known = np.array(t["keep_id"].is_valid().to_numpy())[place].astype(np.uint8)
    sizes = np.array(t["group_size"].to_numpy())[place].astype("<i8")
    return pa.table({
        "shard": pa.array([t["shard"][0].as_py()], pa.int64()), "n": pa.array([len(slot)], pa.int64()), "shift": pa.array([shift.astype("<u4").tobytes()], pa.binary()),
        "digests": pa.array([digests[place].tobytes()], pa.binary()), "locators": pa.array([locators.tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
    })


INDEX_SCHEMA = "shard long, n long, shift binary, digests binary, locators binary, known binary, sizes binary"


def build_index(history: DataFrame, name: str = "mph") -> DataFrame:
    """The written index of history (digest binary(32), keep_id long, group_size long; digests distinct).

    One row for each shard of about ``DIGESTS_PER_SHARD`` digests, however many there are.
    """
    shards = max(1, -(-history.count() // DIGESTS_PER_SHARD))
    dealt = history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    index = dealt.groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)
    return written(index.withColumn("shards", F.lit(shards)), name)


def _lookup(key: tuple, asked: pa.Table, index: pa.Table) -> pa.Table:
    asked = asked.combine_chunks()
    digests = _rows(asked["digest"]) if len(asked) else np.zeros((0, 32), np.uint8)
    member, keep, size = np.zeros(len(asked), bool), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    known = np.zeros(len(asked), bool)
    if len(index) and len(asked):
        row = {c: index[c][0].as_py() for c in index.column_names}
        at = slots_of(np.frombuffer(row["shift"], "<u4"), row["n"], _keys(digests))
        full = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        member = (full[at] == digests).all(axis=1)
        keep, size = np.frombuffer(row["locators"], "<i8")[at], np.frombuffer(row["sizes"], "<i8")[at]
        known = np.frombuffer(row["known"], np.uint8)[at] > 0
    out = asked.drop_columns(["shard", "copy"])
    for name, column in (("member", pa.array(member)), ("keep_id", pa.array(keep, mask=~(member & known))), ("group_size", pa.array(size, mask=~member))):
        out = out.append_column(name, column)
    return out


def lookup(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (digest and other columns) with member, keep_id and group_size; the last two null for nonmembers."""
    first = index.select("shards").first()
    if first is None:
        return rows.withColumns({"member": F.lit(False), "keep_id": F.lit(None).cast("long"), "group_size": F.lit(None).cast("long")})
    # the place of a row among its file's rows parts equal rows as well; it is the same whenever a task runs again
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("digest"), F.lit(first[0])), "place": F.xxhash64(F.monotonically_increasing_id())})
    # how many rows ask for each shard: one row a shard, joined, not collected
    asked = dealt.groupBy("shard").agg(F.count("*").alias("c")).select("shard", F.ceil(F.col("c") / ROWS_PER_LOOKUP).alias("copies"))
    dealt = dealt.join(asked, "shard").withColumn("copy", F.pmod("place", F.col("copies"))).select("shard", "copy", *rows.columns)
    copies = index.join(asked, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    copies = copies.select("shard", "copy", "n", "shift", "digests", "locators", "known", "sizes")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.groupBy("shard", "copy").cogroup(copies.groupBy("shard", "copy")).applyInArrow(_lookup, f"{schema}, member boolean, keep_id long, group_size long")


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased, null as empty."""
    fail_unless(("doc_id", "text"), documents, "documents")
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def summarise(rows: DataFrame) -> DataFrame:
    """Distinct digests with winner and size; a partial aggregation, so hot digests shrink before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def merged(history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, arrived) of history after arrivals (both of distinct digests).

    The arrivals' digests are looked up in the index of history; arrived tells ``repeat`` (a member),
    ``new`` (a nonmember) and null (no arrival has the digest).
    """
    asked = arrivals.select("digest", F.col("keep_id").alias("own_id"), F.col("group_size").alias("own_size"))
    found = written(lookup(asked, build_index(history)), "arrived")
    repeats = found.where("member").select("digest", F.greatest("keep_id", "own_id").alias("keep_id"), (F.col("group_size") + F.col("own_size")).alias("group_size"), F.lit("repeat").alias("arrived"))
    new = found.where("not member").select("digest", F.col("own_id").alias("keep_id"), F.col("own_size").alias("group_size"), F.lit("new").alias("arrived"))
    untouched = history.join(repeats.select("digest"), "digest", "left_anti").select("digest", "keep_id", "group_size", F.lit(None).cast("string").alias("arrived"))
    return untouched.unionByName(repeats).unionByName(new)


def _judged(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, arrival) with the winners of known (digest, keep_id, group_size, arrived)."""
    # a size carries the mark of a member of history in its sign; nonmembers are positive
    marked = known.select("digest", "keep_id", F.when(F.col("arrived") == "repeat", -F.col("group_size")).otherwise(F.col("group_size")).alias("group_size"))
    found = lookup(rows, build_index(written(marked, "known"), "mph-next"))
    repeat = F.col("arrival") & (F.col("group_size") < 0)
    return found.select("doc_id", "keep_id", F.abs("group_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), repeat.alias("from_history"))


def exact_dedup(documents: DataFrame, history: DataFrame) -> DataFrame:
    """One row per arriving document: doc_id, keep_id, group_size, kept, text_sha256, from_history.

    history: (digest, keep_id, group_size) of distinct digests, as ``summarise`` gives them. Winners and
    sizes are those of history and arrivals together; from_history marks repeats of history.
    """
    rows = written(digests(documents).withColumn("arrival", F.lit(True)), "digests")
    history = written(history.select("digest", "keep_id", "group_size"), "history")
    return _judged(rows, merged(history, summarise(rows)))


def dedup(documents: DataFrame) -> DataFrame:
    """The columns of exact_dedup for all rows of documents, the older half by id being the history."""
    rows = written(digests(documents), "digests")
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # one row; halves first, since the sum of two ids may pass what a long holds
    middle = ends.select(F.floor(F.col("low") / 2 + F.col("high") / 2).alias("middle")).first()["middle"]
    rows = rows.withColumn("arrival", F.col("doc_id").isNull() | (F.col("doc_id") > F.lit(middle)) if middle is not None else F.lit(True))
    history = written(summarise(rows.where("not arrival")), "history")
    return _judged(rows, merged(history, summarise(rows.where("arrival"))))
