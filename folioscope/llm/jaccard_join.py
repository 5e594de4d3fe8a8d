"""N-gram Jaccard join (9): token-combination prefixes over sets of word shingles.

A document is the set of its shingles, as 64-bit hashes (tokens). Equal sets are one class, a node.

1. Rarity. The tokens with the lowest hashes, a fixed share of all (``tested_below``), are counted over the
   whole corpus; those of a single node are unique and in no intersection. A set of n tokens links
   only with sets that hold ceil(t n) of its tokens: with more unique tokens than the others can
   spare it links with none, and is done. That ends the search for most documents of a corpus, if the
   share is well above what a set may spare, 1 - t.
2. Keys. Of the others, without their known unique tokens, a prefix is indexed. Tokens are ordered
   rare class before frequent class (those that repeat most among these documents, a list of
   bounded size), by hash within a class. Sets that link share one token among their first
   n - ceil(t n) + 1 (less the unique ones), and two among one more. So a rare token of the
   extended prefix is a key by itself; frequent tokens are keys by pairs. A set long enough that
   pairs would be many (``PAIRS_UP_TO``) uses single tokens of either class; sets near that length
   use both, so that any two sets that may link have one scheme in common. A key holds the class of
   the length as well, each set standing in its own and the next one.
3. Groups. Keys of the same nodes are one bucket. In a bucket of up to ``BUCKET`` nodes, parity bitmaps
   of the sets tell pairs that cannot link: two bitmaps differ in at most as many bits as the sets do in
   tokens. Buckets of over ``PART`` nodes are dealt out by pairs of parts, as many tasks as there are
   pairs. The nodes that the others connect are hung on their smallest. In a larger bucket all are hung
   on the smallest node. So a bucket gives as many rows as nodes, not pairs. The components of those
   rows are candidate groups, and every link lies within one.
4. Verification. A group of up to ``BLOCK`` nodes is verified as a whole in one task by exact
   intersection sizes. A larger group is held against one of its nodes, its hub, by as many tasks as it
   needs. Nodes that link with the hub need no comparison among themselves; by the triangle inequality of the
   Jaccard distance only nodes within twice the distance of a link may link with one of them, and are
   compared with those that may link back, in pairs of blocks. The nodes far from the hub (none, in a
   group of near copies of one text) are the group of the next of ``HUB_ROUNDS`` rounds, or compared in pairs
   of blocks where they are few (``FEW_BLOCKS``). What is then left of a group is compared in pairs of blocks: its
   cost grows with the square of what is left, and no pair is dropped. Linked nodes are joined to components.

Texts are compared through 64-bit hashes of shingles: two different shingles of two compared
documents fall together with probability of about 2**-64 for each pair.

Defined cases: null, empty and blank texts have the empty set, n_shingles 0, are linked with
nothing, and form components of their own; a text of fewer words than a shingle is one shingle; repeated
rows link with each other; a null id is ignored as a component's name, unless all ids of the
component are null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, components, discard, fail_unless, fits_broadcast, free_names, own_columns, remember, small_batches, spread, written

SHINGLE = 3
#: similarity as a fraction
OVER, UNDER = 90, 100
#: frequent class: at most so many tokens, each of which repeats at least so often
MOST_FREQUENT, LEAST_COUNT = 1 << 20, 16
#: stands for a null id in joins
NO_ID = -(1 << 63) + 1
PAIRS_UP_TO = 160
BLOCK = 256
#: nodes of a bucket whose bitmaps are compared with one another
BUCKET = 512
#: nodes of a part of such a bucket; two parts are compared at once, so a bucket of n nodes is sent n ceil(n / PART) rows, 2 n at most
PART = 256
#: hubs that a group is held against, one after another
HUB_ROUNDS = 6
#: what a round leaves of a group, up to so many blocks, is compared in pairs of blocks: each text is sent eight times at most, fewer than by more rounds
FEW_BLOCKS = 4
TOKENS_AT_ONCE = 1 << 20
#: tokens counted over the whole corpus, as a multiple of the share of its tokens that a set may spare: a sixth of all at 0.9
TESTED = (5, 3)
MOST_WORDS = 300_000

_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Likeness(NamedTuple):
    """What links two texts: words of a shingle, and the least similarity as a fraction."""

    shingle: int = SHINGLE
    over: int = OVER
    under: int = UNDER


OWN = Likeness()


def tested_below(like: Likeness = OWN) -> int:
    """Tokens below this hash are counted over the whole corpus."""
    return -(1 << 63) + min((1 << 64) - 1, (1 << 64) * TESTED[0] * (like.under - like.over) // (TESTED[1] * like.under))


def _factor(j: int) -> np.uint64:
    """The odd number that the j-th word of a shingle is multiplied with."""
    return _MUL[j] if j < len(_MUL) else np.uint64(pow(int(_MUL[1]), j, 1 << 64))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words(dict):
    """word bytes -> 64-bit hash; bounded, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = Words()


def at_work() -> None:
    remember("shingles", _words.clear)


def tokens(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes (int64) of a text's shingles."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - width + 1] * _MUL[0]
        for j in range(1, width):
            out += h[j : len(h) - width + 1 + j] * _factor(j)
        if width < shingle:
            out += np.uint64(width)
    out.sort()
    if len(out) > 1:
        keep = np.empty(len(out), bool)
        keep[0] = True
        np.not_equal(out[1:], out[:-1], out=keep[1:])
        out = out[keep]
    return (out ^ np.uint64(1 << 63)).view(np.int64)  # sorted as signed numbers as well


def digest(own: np.ndarray) -> int:
    """The node: a 64-bit digest of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _described(batches: Iterator[pa.RecordBatch], like: Likeness = OWN) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text_hash) -> (doc_id, node, n, text_hash, tested): the set's size and its tested tokens."""
    at_work()
    below = tested_below(like)
    for batch in batches:
        nodes, ns, tested = [], [], []
        for text in batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist():
            own = tokens(text, like.shingle)
            nodes.append(digest(own) if len(own) else None)
            ns.append(len(own))
            tested.append(own[: np.searchsorted(own, below)] if len(own) > 1 else own[:0])
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tested])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *tested])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(ns, pa.int64()), batch.column(2), lists], names=["doc_id", "node", "n", "text_hash", "tested"])


def _repeated(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(text) -> (token, c) for each token that repeats in a bounded stretch of documents."""
    at_work()
    pending: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *pending]), return_counts=True)
        pending.clear()
        return pa.RecordBatch.from_arrays([pa.array(values[counts > 1]), pa.array(counts[counts > 1])], names=["token", "c"])

    size = 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist():
            pending.append(tokens(text, shingle))
            size += len(pending[-1])
        if size >= TOKENS_AT_ONCE:
            size = 0
            yield flush()
    yield flush()


def frequent_class(counted: DataFrame, most: int = MOST_FREQUENT, least: int = LEAST_COUNT) -> np.ndarray:
    """The frequent tokens, sorted: those with the highest counts, at most ``most`` of them."""
    totals = written(counted.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= least), "frequent")  # read twice below
    by_size = {r["b"]: r["n"] for r in totals.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    taken, bound = 0, 64
    for b in sorted(by_size, reverse=True):
        if taken + by_size[b] > most:
            break
        taken, bound = taken + by_size[b], b
    chosen = totals.where(F.floor(F.log2("c")) >= bound).select("token").toArrow()["token"]
    discard(totals)
    return np.sort(chosen.to_numpy())


def prefix(n: int, like: Likeness = OWN) -> int:
    """How many first tokens hold one token in common with any set that links."""
    return n - -(-like.over * n // like.under) + 1


def length_class(n: int, like: Likeness = OWN) -> int:
    """Sets that link are of the same or of neighbouring classes."""
    return math.floor(math.log(n) / math.log(like.under / like.over) + 1e-9)


def keys_of(own: np.ndarray, frequent: np.ndarray, unique: np.ndarray | None = None, like: Likeness = OWN) -> np.ndarray:
    """The keys of a set: rare tokens and pairs of frequent ones, or single tokens if it is long."""
    n = len(own)
    if n < 2:  # it links with no other set
        return own[:0]
    spare = prefix(n, like)
    if unique is not None and len(unique):
        own = np.setdiff1d(own, unique, assume_unique=True)
        spare -= n - len(own)
    if spare <= 0:
        return own[:0]
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        common = frequent[place] == own
    else:
        common = np.zeros(len(own), bool)
    out = []
    if n * like.over <= PAIRS_UP_TO * like.under:  # pairs: of the two tokens shared, one is rare, or both are frequent
        rare = own[~common][: spare + 1]
        often = own[common][: spare + 1 - len(rare)]
        out.append(rare)
        i, j = np.triu_indices(len(often), 1)
        with np.errstate(over="ignore"):
            out.append(_mix(_mix(often[i].view(np.uint64)) + often[j].view(np.uint64)).view(np.int64))
    if n >= PAIRS_UP_TO * like.over // like.under:  # single tokens
        rare = own[~common][:spare]
        out += [rare, own[common][: spare - len(rare)]]
    keys = np.unique(np.concatenate(out)).view(np.uint64)
    c = np.uint64(length_class(n, like))
    with np.errstate(over="ignore"):
        return np.concatenate([_mix(keys + (c + np.uint64(k)) * _MUL[0]) for k in (0, 1)]).view(np.int64)


def index_rows(risky: DataFrame, frequent: np.ndarray, like: Likeness = OWN) -> DataFrame:
    """(node, n, bitmap, keys) of (node, text, unique)."""
    sent = risky.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT numbers, 8 MB

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work()
        for batch in batches:
            ns, bitmaps, keys = [], [], []
            for text, unique in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
                own = tokens(text, like.shingle)
                ns.append(len(own))
                bitmaps.append(bitmap(own, like))
                keys.append(keys_of(own, sent.value, unique.values.to_numpy() if unique.is_valid else None, like))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(bitmaps, pa.binary()), lists], names=["node", "n", "bitmap", "keys"])

    return risky.select("node", "text", "unique").mapInArrow(keyed, "node long, n long, bitmap binary, keys array<long>")


def bitmap(own: np.ndarray, like: Likeness = OWN) -> bytes:
    """The parity of the tokens at each of a power of two of places: half as many as tokens or more at 0.9, twice as many at 0.8.

    Two sets that have nothing in common must differ at far more places than two that link.
    """
    bits = 1 << max(8, (50 * len(own) * (like.under - like.over) ** 2 // like.under**2).bit_length())
    odd = np.bincount((own & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    """A bitmap of fewer places out of one of more: parities add up."""
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def bucket_edges(nodes: list[int], ns: list[int], bitmaps: list[bytes], like: Likeness = OWN) -> list[tuple[int, int]]:
    """(node, smallest node) for the nodes of a bucket that pairs which may link connect."""
    size = min(map(len, bitmaps))
    x, n = np.stack([fold(b, size) for b in bitmaps]), np.array(ns)
    low = np.arange(len(nodes))
    for i in range(len(nodes) - 1):
        # a link has a symmetric difference of (under - over) / (under + over) of both sizes at most
        apart = np.bitwise_count(x[i + 1 :] ^ x[i]).sum(1).astype(np.int64)
        near = np.append(np.flatnonzero(apart * (like.under + like.over) <= (like.under - like.over) * (n[i + 1 :] + n[i])) + i + 1, i)
        if len(near) > 1:
            roots = np.unique(low[near])
            if len(roots) > 1:
                low[np.isin(low, roots[1:])] = roots[0]
    out = []
    for root in np.unique(low):
        own = [nodes[k] for k in np.flatnonzero(low == root)]
        out += [(node, min(own)) for node in own if node != min(own)]
    return out


def _filtered(batches: Iterator[pa.RecordBatch], like: Likeness = OWN) -> Iterator[pa.RecordBatch]:
    """(key, x, y, node, n, bitmap) sorted by the first three -> (a, b)."""
    current, held = None, []
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(held) > 1:
            out.extend(bucket_edges(*map(list, zip(*held)), like))

    def rows() -> pa.RecordBatch:
        done, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for k, x, y, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (key := (k, x, y)) != current:
                close()
                current, held = key, []
            held.append(rest)
        yield rows()
    close()
    yield rows()


def _pairs(parts: Column) -> Column:
    """The pairs (x, y), x <= y, of so many parts that the part ``own`` is in."""
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))


def candidate_edges(index: DataFrame, bitmaps: DataFrame, like: Likeness, bucket: int = BUCKET, part: int = PART) -> DataFrame:
    """(a, b): edges whose components hold every link. index: (key, node), distinct; bitmaps: (node, n, bitmap)."""
    facts = [F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")]
    shared = index.groupBy("key").agg(*facts).where("low <> high")
    one = written(shared.groupBy("low", "high", "size", "members").agg(F.min("key").alias("key")), "buckets")
    small = index.join(one.where(F.col("size") <= bucket).select("key", "size"), "key").join(bitmaps, "node")
    parts = F.ceil(F.col("size") / part)
    small = small.withColumn("own", F.pmod(F.xxhash64("node"), parts)).withColumn("pair", F.explode(_pairs(parts)))
    small = small.select("key", "pair.x", "pair.y", "node", "n", "bitmap")
    edges = spread(small, "key", "x", "y").sortWithinPartitions("key", "x", "y", "node").mapInArrow(partial(_filtered, like=like), "a long, b long")
    large = one.where(F.col("size") > bucket).select("key", "low")
    return edges.unionByName(index.join(large, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()


def linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray, like: Likeness = OWN) -> np.ndarray:
    return like.under * inter >= like.over * (n + m - inter)


def _matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a bounded number of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1, np.int64)
    column[shared] = np.arange(len(shared))
    column = column[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact in float32
    width = 4096
    for low in range(0, len(shared), width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((len(sets), min(width, len(shared) - low)), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def link_block(nodes: list[int], texts: list[bytes], trusted: list[bool] | None = None, like: Likeness = OWN) -> list[tuple[int, int]]:
    """(node, smallest node reachable within the block) for the nodes of a block that link.

    trusted nodes are known to be linked with each other already.
    """
    sets, ids, known = [], [], []
    for k, (node, text) in enumerate(zip(nodes, texts)):
        own = tokens(text, like.shingle)
        if not len(own):
            continue
        sets.append(own)
        ids.append(node)
        known.append(bool(trusted and trusted[k]))
    if len(sets) < 2:
        return []
    n = np.array([len(s) for s in sets], np.int64)
    near = linked(_matrix(sets) if len(sets) > 2 else np.array([[n[0], x := len(np.intersect1d(*sets, assume_unique=True))], [x, n[1]]]), n[:, None], n[None, :], like)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = known.index(True) if True in known else 0
    for i, t in enumerate(known):
        if t:
            parent[find(i)] = find(first)
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        if (a := find(i)) != (b := find(j)):
            parent[a] = b
    groups: dict[int, list[int]] = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(ids[i])
    return [(x, low) for own in groups.values() if len(own) > 1 for low in [min(own)] for x in own if x != low]


def _verified(columns: list[str], group: list[str], like: Likeness):
    """mapInArrow over rows sorted by group: the links found in each group of (node, text[, trusted])."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work()
        current, nodes, texts, trusted = None, [], [], []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if len(nodes) > 1:
                out.extend(link_block(nodes, texts, trusted, like))

        for batch in batches:
            keys = list(zip(*(batch.column(columns.index(c)).to_pylist() for c in group)))
            node = batch.column(columns.index("node")).to_pylist()
            text = batch.column(columns.index("text")).cast(pa.binary()).fill_null(b"").to_pylist()
            known = batch.column(columns.index("trusted")).to_pylist() if "trusted" in columns else [False] * len(node)
            for k in range(len(node)):
                if keys[k] != current:
                    flush()
                    current, nodes, texts, trusted = keys[k], [], [], []
                elif nodes[-1] == node[k]:  # a repeated row
                    continue
                nodes.append(node[k])
                texts.append(text[k])
                trusted.append(known[k])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return verify


def _held_to_hub(batches: Iterator[pa.RecordBatch], like: Likeness = OWN) -> Iterator[pa.RecordBatch]:
    """(grp, node, text, hub, hub_text) -> (grp, node, hub, similarity)."""
    at_work()
    kept: dict[int, np.ndarray] = {}
    for batch in batches:
        sims = []
        for text, hub, hub_text in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            if hub not in kept:
                kept.clear()
                kept[hub] = tokens(hub_text.encode(), like.shingle)
            own, of = tokens((text or "").encode(), like.shingle), kept[hub]
            inter = len(np.intersect1d(own, of, assume_unique=True))
            sims.append((bool(linked(inter, len(own), len(of), like)), 1 - inter / (len(own) + len(of) - inter)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([s[0] for s in sims], pa.bool_()), pa.array([s[1] for s in sims], pa.float64())], names=["grp", "node", "hub", "near", "distance"])


def _whole(rows: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) of (grp, node, text), each group compared in one task."""
    return spread(rows.select("grp", "node", "text"), "grp").sortWithinPartitions("grp", "node").mapInArrow(_verified(["grp", "node", "text"], ["grp"], like), "a long, b long")


def _in_blocks(rows: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) of (grp, x, y, node, text, trusted), each pair of blocks compared in one task."""
    columns = ["grp", "x", "y", "node", "text", "trusted"]
    return spread(rows.select(*columns), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "node").mapInArrow(_verified(columns, ["grp", "x", "y"], like), "a long, b long")


def _all_blocks(left: DataFrame, texts: DataFrame, like: Likeness, block: int) -> DataFrame:
    """Links (a, b) of groups (grp, node, size), each pair of blocks of a group compared in one task; a group of one block as a whole."""
    parts = F.when(F.col("size") <= block, F.lit(1).cast("long")).otherwise(F.ceil(F.col("size") * 2 / block))
    rows = left.withColumn("own", F.pmod(F.xxhash64("node"), parts)).select("grp", "node", F.explode(_pairs(parts)).alias("pair"))
    rows = rows.select("grp", "pair.x", "pair.y", "node", F.lit(False).alias("trusted"))
    return _in_blocks(rows.join(texts.select("node", "text"), "node"), like)


def _border(held: DataFrame, texts: DataFrame, like: Likeness, block: int) -> DataFrame:
    """Links between nodes near their hub and nodes far from it, where there may be any."""
    limit = (like.under - like.over) / like.under + 1e-9
    far = held.where(~F.col("near") & (F.col("distance") <= 2 * limit))
    counts = far.groupBy("grp").agg(F.count("*").alias("n_far"), F.min("distance").alias("nearest"))
    near = held.join(counts, "grp").where(F.col("near") & (F.col("distance") + limit >= F.col("nearest")))
    counts = counts.join(near.groupBy("grp").agg(F.count("*").alias("n_near")), "grp")
    # a block of far nodes meets each block of near ones
    x, y = F.ceil(F.col("n_far") * 2 / block), F.ceil(F.col("n_near") * 2 / block)
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    rows = far.join(counts.drop("nearest"), "grp").select("grp", "node", own(x).alias("x"), F.explode(all_of(y)).alias("y"), F.lit(False).alias("trusted"))
    rows = rows.unionByName(near.drop("nearest", "n_far").join(counts.drop("nearest"), "grp").select("grp", "node", F.explode(all_of(x)).alias("x"), own(y).alias("y"), F.lit(True).alias("trusted")))
    return _in_blocks(rows.join(texts.select("node", "text"), "node"), like)


def links(risky: DataFrame, groups: DataFrame, like: Likeness, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the nodes of each candidate group (node, label); as many as components need.

    risky is a written table, and goes as soon as the texts of the groups are taken from it.
    """
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "label").select(F.col("label").alias("grp"), "size", "node")
    rows = written(risky.select("node", "text").join(members.hint("shuffle_hash"), "node"), "candidates")
    discard(risky)
    found = [written(_whole(rows.where(F.col("size") <= block), like), "small-groups")]
    rest = rows.where(F.col("size") > block).select("grp", "node", "text")
    left, reach = None, 2 * (like.under - like.over) / like.under + 1e-9
    for round_ in range(HUB_ROUNDS):
        if rest.isEmpty():
            break
        hubs = rest.join(rest.groupBy("grp").agg(F.min_by("node", F.xxhash64(F.lit(round_), "node")).alias("node")), ["grp", "node"])
        hubs = hubs.select("grp", F.col("node").alias("hub"), F.col("text").alias("hub_text")).dropDuplicates(["grp"])
        held = rest.join(hubs, "grp").select("grp", "node", "text", "hub", "hub_text").mapInArrow(partial(_held_to_hub, like=like), "grp long, node long, hub long, near boolean, distance double")
        held = written(held, "held-to-hub")
        found.append(held.where("near and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        n = held.agg(F.count_if(~F.col("near")).alias("far"), F.count_if(~F.col("near") & (F.col("distance") <= reach)).alias("border")).first()
        if n["border"]:
            found.append(written(_border(held, rest, like, block), "border-links"))
        if not n["far"]:
            return reduce(DataFrame.unionByName, found)
        far = held.where("not near").select("grp", "node")
        left = written(far.join(far.groupBy("grp").agg(F.count("*").alias("size")), "grp").select("grp", "node", "size"), "far-from-hub")
        few = left.where(F.col("size") <= FEW_BLOCKS * block)
        found.append(written(_all_blocks(few, rest, like, block), "few-links"))
        left = left.where(F.col("size") > FEW_BLOCKS * block)
        rest = written(rest.join(left.select("grp", "node"), ["grp", "node"], "left_semi"), "rest")
    if left is not None and not rest.isEmpty():
        found.append(_all_blocks(left, rest, like, block))
    return reduce(DataFrame.unionByName, found)


def at_risk(documents: DataFrame, docs: DataFrame, described: DataFrame, like: Likeness) -> DataFrame:
    """(node, text, unique) of the nodes that may link, one row for each; unique: their known unique tokens."""
    tested = described.where("node is not null").select("node", F.explode("tested").alias("token"))
    alone = tested.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("high")).where("node = high")
    alone = alone.groupBy("node").agg(F.collect_list("token").alias("unique"))  # bounded by the set itself
    # a node's text is that of one of its rows, found again by id and hash
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash")).alias("one")
    nodes = docs.where("n > 1").groupBy("node").agg(F.max("n").alias("n"), one)
    spare = F.expr(f"n - div({like.over} * n + {like.under - 1}, {like.under}) + 1")
    nodes = nodes.join(alone, "node", "left").where(F.coalesce(F.size("unique"), F.lit(0)) < spare).select("node", "one.*", "unique")
    texts = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash", "text")
    return texts.join(nodes.hint("shuffle_hash"), ["id", "text_hash"]).select("node", "text", "unique")


def _with_labels(documents: DataFrame, like: Likeness) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, text_hash, label; a component has one label, an empty set none."""
    fail_unless(("doc_id", "text"), documents, "documents")
    small_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    described = written(documents.mapInArrow(partial(_described, like=like), "doc_id long, node long, n long, text_hash long, tested array<long>"), "described")
    docs = described.select("doc_id", "node", "n", "text_hash")
    risky = written(at_risk(documents, docs, described, like), "at-risk")
    frequent = frequent_class(risky.select("text").mapInArrow(partial(_repeated, shingle=like.shingle), "token long, c long"))
    index = written(index_rows(risky, frequent, like), "index")
    edges = candidate_edges(index.select(F.explode("keys").alias("key"), "node"), index.select("node", "n", "bitmap"), like)
    groups = components(edges, "candidate-groups")
    discard(index)
    found = components(links(risky, groups, like), "links")
    nodes = docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    # only nodes with copies or links need another name than their own id
    named = nodes.join(found, "node", "left").where("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "node"))
    low = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    names = named.join(low, "label").select("node", "component_id", "label")
    out = docs.join(names, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", F.coalesce("label", "node").alias("label"))


def jaccard_components(documents: DataFrame, like: Likeness = OWN) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, text_hash."""
    return _with_labels(documents, like).drop("label")


#: rows of keys that may be broadcast, some 5 MB
BROADCAST_KEYS = 200_000


def one_of_each(documents: DataFrame, like: Likeness = OWN, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest id, ids before none.

    Rows that are equal in id and text are one document, with words or without, and one of them stays. Of
    several texts under the smallest id of a component, the one of the smallest hash stays.
    Documents without words are each a component.
    """
    id_, hash_ = free_names(documents, "id", "hash")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(id_), F.col("text_hash").alias(hash_)]
    found = written(_with_labels(documents, like), "components-of-documents")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = found.where("label is not null").groupBy("label").agg(F.min(order).alias("first"))
    rows = found.join(first, "label", "left").select(*key, (F.col("first").isNull() | (order == F.col("first"))).alias("stays"))
    keys = written(rows.groupBy(id_, hash_).agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")), "keys-of-documents")
    gone, repeated = keys.where("not stays").select(id_, hash_), keys.where("stays and rows > 1").select(id_, hash_)

    def sent(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if fits_broadcast(small, broadcast_keys) else small.hint("shuffle_hash")

    own = documents.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), hash_: F.xxhash64("text")})
    kept = own.join(sent(gone), [id_, hash_], "left_anti")
    if not repeated.isEmpty():  # else there is nothing to take out
        single = kept.join(sent(repeated), [id_, hash_], "left_anti")
        kept = single.unionByName(kept.join(sent(repeated), [id_, hash_], "left_semi").dropDuplicates([id_, hash_]))
    return kept.select(*own_columns(documents))
