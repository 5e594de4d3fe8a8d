"""Token counts (1): edit-aware counting over pre-token segment trees.

A document's pre-tokens are dealt into leaves of ``LEAF`` of them; a leaf knows its characters and
its tokens, and a segment tree sums both, so a count is the root and a place is found on one path.
An edit replaces characters. The scan for pre-tokens starts at the leaf before the first one the edit
touches (a pre-token ahead of the edit may grow into it) and ends where it meets an old leaf
boundary behind the edit: the pattern looks ahead but never back, so from there on all is as it
was. Only what was scanned is encoded again, and the sums above its leaves are updated. Leaves that
outgrow ``LEAF`` several times have the tree built anew from the leaves' counts.

Trees are a binary column, so they can be stored beside the texts and edited later.

Defined cases: null text counts as empty, an empty text has no tokens and one empty leaf; edits are
applied in falling order of start and must not overlap; an edit beyond the text is cut to it;
repeated rows are counted once each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fail_unless, remember, small_batches

LEAF = 16
GROWN = 8
MOST_PIECES = 400_000


class Counter:
    """Pre-tokens by the pattern of the tokenizer, tokens of a pre-token by its ranks, remembered."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= MOST_PIECES:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


_counters: dict[int, Counter] = {}


def counter(ranks: bytes, pattern: str) -> Counter:
    remember("token counts", _counters.clear)
    key = hash((ranks, pattern))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(ranks, pattern)
    return _counters[key]


def read_ranks(path: str | None = None) -> tuple[bytes, str]:
    """The ranks file and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return Path(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


class Tree:
    """Sums of (characters, tokens, pre-tokens) over leaves; node k has the children 2k and 2k + 1."""

    def __init__(self, leaves: np.ndarray):
        size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.n, self.size = len(leaves), size
        self.sums = np.zeros((2 * size, 3), np.int64)
        self.sums[size : size + len(leaves)] = leaves
        level = size
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @classmethod
    def of(cls, text: str, count: Counter) -> Tree:
        pieces = count.pattern.findall(text)
        if not pieces:
            return cls(np.zeros((1, 3), np.int64))
        own = np.array([(len(p), count.count(p), 1) for p in pieces], np.int64)
        return cls(np.add.reduceat(own, np.arange(0, len(own), LEAF)))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.n]

    def dump(self) -> bytes:
        return self.leaves.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        return cls(np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.int64))

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place, and where it starts; the last leaf for the end."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if place - start < left:
                node *= 2
            else:
                start, node = start + left, 2 * node + 1
        if node - self.size >= self.n:
            last = self.n - 1
            return last, int(self.sums[1, 0] - self.sums[self.size + last, 0])
        return node - self.size, start

    def put(self, leaf: int, values: np.ndarray) -> None:
        node = self.size + leaf
        self.sums[node] = values
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


#: characters behind an edit that are scanned at first, and those at the end of what is looked at that a piece must not reach
AHEAD, MARGIN = 256, 8


class Edited:
    """A tree and its text under edits from the end to the start.

    What stands behind the last edit is kept in parts, the nearest last, so that many edits of a long
    text cost what they change and not the text each time.
    """

    def __init__(self, tree: Tree, text: str, count: Counter):
        self.tree, self.count, self.ahead, self.upto, self.parts = tree, count, text, len(text), []

    def text(self) -> str:
        return self.ahead[: self.upto] + "".join(reversed(self.parts))

    def _next(self, n: int) -> tuple[str, bool]:
        """The next n characters behind the place reached, and whether they are all."""
        out, size = [], 0
        for part in reversed(self.parts):
            out.append(part[: n - size])
            size += len(out[-1])
            if size >= n:
                break
        return "".join(out), size == sum(map(len, self.parts)) if len(self.parts) <= len(out) else False

    def edit(self, start: int, end: int, new: str) -> int:
        """Let text[start:end] become new; the number of pre-tokens encoded. Edits come in falling order of start."""
        start = max(0, min(start, self.upto))
        end = max(start, min(end, self.upto))
        self.parts += [p for p in (self.ahead[end : self.upto], new) if p]
        self.upto = start
        tree, shift = self.tree, len(new) - (end - start)
        first, at = tree.find(start)
        while first and tree.leaves[first - 1, 0] >= 0:  # one leaf of context that holds characters
            first -= 1
            at -= int(tree.leaves[first, 0])
            if tree.leaves[first, 0]:
                break
        n = AHEAD + len(new)
        while True:
            behind, whole = self._next(n)
            found, last = self._scan(first, at, self.ahead[at:start] + behind, end, shift, whole)
            if found is not None:
                break
            n *= 4
        slots = last - first + 1
        own = np.array(found, np.int64).reshape(-1, 3)
        if len(own) > GROWN * LEAF * slots:
            self.tree = Tree(np.concatenate([tree.leaves[:first], np.add.reduceat(own, np.arange(0, len(own), LEAF)), tree.leaves[last + 1 :]]))
            return len(own)
        bounds = np.linspace(0, len(own), slots + 1).astype(int)
        for k in range(slots):
            tree.put(first + k, own[bounds[k] : bounds[k + 1]].sum(0))
        return len(own)

    def _scan(self, first: int, at: int, window: str, end: int, shift: int, whole: bool) -> tuple[list | None, int]:
        """Pre-tokens from ``at`` to an old leaf boundary behind the edit or the end; none if the window is too short."""
        tree = self.tree
        # the leaf whose end, moved by the edit, is the next place where old and new may agree
        last, old_end, position = first, at + int(tree.leaves[first, 0]), at
        found: list[tuple[int, int, int]] = []
        safe = len(window) if whole else len(window) - MARGIN

        def advance(limit: int) -> None:
            nonlocal last, old_end
            while last + 1 < tree.n and (old_end < end or old_end + shift < limit):
                last += 1
                old_end += int(tree.leaves[last, 0])

        advance(at)
        for m in self.count.pattern.finditer(window):
            if old_end >= end and position == old_end + shift and position > at:
                return found, last
            if m.end() > safe:  # what stands behind the window might make this piece another one
                return None, last
            found.append((m.end() - m.start(), self.count.count(m.group()), 1))
            position = at + m.end()
            advance(position)
        if not whole:
            return None, last
        return found, last if position < at + len(window) else tree.n - 1


def edit(tree: Tree, text: str, start: int, end: int, new: str, count: Counter) -> tuple[Tree, str, int]:
    """The tree and the text after text[start:end] became new, and how many pre-tokens were encoded."""
    own = Edited(tree, text, count)
    n = own.edit(start, end, new)
    return own.tree, own.text(), n


#: what is redacted, and by what: mail addresses, network addresses, telephone numbers
#: a mail address begins where a run of its characters does; runs of letters and digits are tried at one length alone, so that time is linear
REDACTED = re.compile(r"(?P<MAIL>(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+)|(?P<ADDRESS>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<PHONE>\+\d[\d ().-]{6,}\d)")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The edits of a redaction: every match becomes its name in brackets, and the text gets a final line break."""
    return [(m.start(), m.end(), f"[{m.lastgroup}]") for m in REDACTED.finditer(text)] + [(len(text), len(text), "\n")]


def with_trees(documents: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, text, tree) of documents."""
    sent = documents.sparkSession.sparkContext.broadcast((ranks, pattern))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*sent.value)
        for batch in batches:
            trees = [Tree.of(t or "", count).dump() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees, pa.binary())], names=["doc_id", "text", "tree"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, text string, tree binary")


def edited(trees: DataFrame, edits: Callable[[str], Iterable[tuple[int, int, str]]], ranks: bytes, pattern: str) -> DataFrame:
    """Counts before and after edits of each (doc_id, text, tree)."""
    sent = trees.sparkSession.sparkContext.broadcast((ranks, pattern))
    names = ["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*sent.value)
        for batch in batches:
            rows = []
            for doc_id, text, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text, tree = text or "", Tree.load(raw)
                pieces, before, todo, encoded = int(tree.sums[1, 2]), tree.tokens, sorted(edits(text), reverse=True), 0
                own = Edited(tree, text, count)
                for start, end, new in todo:
                    encoded += own.edit(start, end, new)
                rows.append((doc_id, pieces, before, len(todo), encoded, own.tree.tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names=names)

    return trees.mapInArrow(apply, ", ".join(f"{n} long" for n in names))


def token_counts(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Per document: pre-tokens, tokens, edits of its redaction, pre-tokens encoded for them, tokens after."""
    fail_unless(("doc_id", "text"), documents, "documents")
    small_batches(documents.sparkSession)
    ranks, pattern = read_ranks(ranks_path)
    return edited(with_trees(documents, ranks, pattern), redactions, ranks, pattern)
