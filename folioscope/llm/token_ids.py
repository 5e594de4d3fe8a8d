"""Token ids of whole texts by a public tokenizer file, through a memo of white-space separated chunks.

The tokenizer's pre-tokens never cross ASCII white space, so the ids of a text are those of its
chunks in order, and most chunks repeat. A new chunk in plain characters is cut into its pre-tokens,
which repeat more than chunks do; only new pre-tokens are merged by the tokenizer's model. Any other
chunk is encoded by the tokenizer as it is, and with a tokenizer of another build whole texts are.

Both memos have two generations: what was used since the last turn, and what was used before it. A
full young generation becomes the old one, whose entries go unless they are used again.
"""

from __future__ import annotations

import json
import os
import re
import struct
from pathlib import Path

import numpy as np

from .common import remember

#: bytes of both generations of a memo, as reckoned by ENTRY for each entry besides its content
MOST_BYTES, ENTRY = 192 << 20, 200
#: chunks of a text between which a generation may turn
CHUNKS_AT_ONCE = 1 << 16
#: pre-tokens of a chunk in plain characters: Latin letters that stay single letters in lower case, single digits, runs of signs
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+|[0-9]|[!-&(-/:;=?@\\[-`{}~]+")
# The build of tokenizer whose pre-tokens _PLAIN cuts.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Generations(dict):
    """key -> bytes: the young generation; ``old`` is the other. Subclasses say how a new key is learnt."""

    def __init__(self, most_bytes: int):
        super().__init__()
        self.half, self.held = most_bytes // 2, 0
        self.old: dict = {}

    def learnt(self, key) -> bytes:  # noqa: ANN001
        raise NotImplementedError

    def __missing__(self, key) -> bytes:  # noqa: ANN001
        out = self.old.get(key)
        if out is None:
            out = self.learnt(key)
        self.held += ENTRY + len(key) + len(out)
        self[key] = out
        return out

    def turn(self) -> None:
        if self.held > self.half:
            self.old, self.held = dict(self), 0
            self.clear()


class Pieces(Generations):
    """The ids of pre-tokens in plain characters, by the merges of the tokenizer's model."""

    def __init__(self, tokenizer, most_bytes: int):  # noqa: ANN001
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(most_bytes)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: letters beyond ASCII as the characters that stand for their bytes
        self.as_bytes = {n: level.pre_tokenize_str(chr(n))[0][0] for n in range(0xC0, 0x17F)}
        self.merge = tokenizer.model.tokenize

    def learnt(self, piece: str) -> bytes:
        ids = [t.id for t in self.merge(piece if piece.isascii() else piece.translate(self.as_bytes))]
        return struct.pack(f"<{len(ids)}I", *ids)


class ChunkMemo(Generations):
    """The ids of texts as little-endian unsigned 32-bit integers, from those of their chunks."""

    def __init__(self, tokenizer_json: str, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(most_bytes * 3 // 4)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.pieces = Pieces(self.tokenizer, most_bytes // 4)
        build = json.loads(tokenizer_json)
        steps = (build.get("normalizer") or {}).get("normalizers") or []
        cuts = (build.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.by_pieces = [s["type"] for s in steps] == _NORMALIZERS and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PATTERN} and not cuts[1]["add_prefix_space"]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learnt(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text.isalpha() and text.isascii():
            return self.pieces[text.lower()]
        found = _PLAIN.findall(text)
        if sum(map(len, found)) < len(text):
            return self._encode(text)
        return b"".join([self.pieces[f.lower()] for f in found])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8 bytes)."""
        if not self.by_pieces:
            return [self._encode(t.decode()) for t in texts]
        out, get = [], self.__getitem__
        for text in texts:
            chunks, parts = text.split(), []
            for k in range(0, len(chunks), CHUNKS_AT_ONCE):
                parts.append(b"".join(map(get, chunks[k : k + CHUNKS_AT_ONCE])))
                self.turn()
                self.pieces.turn()
            out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        return out


_memos: dict[int, ChunkMemo] = {}


def memo(tokenizer_json: str) -> ChunkMemo:
    """One memo for each tokenizer and worker process; it outlives the task."""
    remember("token ids", _memos.clear)
    key = hash(tokenizer_json)
    if key not in _memos:
        _memos.clear()
        _memos[key] = ChunkMemo(tokenizer_json)
    return _memos[key]


def read_tokenizer(path: str | None = None) -> str:
    """The text of a tokenizer file, read on the driver and sent to the tasks (a few MB at most)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")
