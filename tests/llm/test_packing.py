import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import packing as P
from folioscope.llm import token_ids as T

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = ["", "Plain words and plain words", "Don't we'll IT'S ' 't", "tabs\tand\x0bvertical\x0c\r\nlines", "Ünḯcode é  no break  em", "123 4 5,67!? #tag", "<|endoftext|> in <|startoftext|>text", "ΑΣ ς Σ", "日本語 テキスト", "a\x00b \x1c\x1d c\x85d", "ﬁ ﬂ İI", "word " * 5000, "x" * 3000, "🙂🙂 👩‍👩‍👧"]


def brute_ids(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_memo_gives_the_tokenizers_ids():
    memo = T.ChunkMemo(T.read_tokenizer(), most_bytes=4000)  # small, so that generations turn on the way
    letters = [chr(n) * k + "x" for n in range(0xC0, 0x180) for k in (1, 2)]
    for _ in range(2):
        texts = [*TEXTS, " ".join(letters), *(f"a{c}B {c}, {c}'s" for c in map(chr, range(33, 127)))]
        for text, ids in zip(texts, memo.ids([t.encode() for t in texts])):
            assert ids == brute_ids(text)[:-1].tobytes(), text
    assert memo.old and memo.pieces.old
    other = T.ChunkMemo(TOKENIZER.to_str().replace('"NFC"', '"NFD"'))
    assert not other.by_pieces and memo.by_pieces
    assert other.ids([b"caf\xc3\xa9"]) == [np.array(other.tokenizer.encode("caf\xe9", add_special_tokens=False).ids, "<u4").tobytes()]


def test_memo_is_bounded():
    memo = T.ChunkMemo(T.read_tokenizer(), most_bytes=1 << 20)
    for k in range(20):
        memo.ids([" ".join(f"w{n}" for n in range(k * 1000, k * 1000 + 1000)).encode()])
        for g in (memo, memo.pieces):
            assert len(g) + len(g.old) <= 2 * (g.half // T.ENTRY + 1000)


def test_a_very_long_word(spark):
    text = "y" * 5_000_000
    assert T.ChunkMemo(T.read_tokenizer()).ids([text.encode()])[0] == brute_ids(text)[:-1].tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_memo_on_any_text(texts):
    memo = T.ChunkMemo(T.read_tokenizer()) if not hasattr(test_memo_on_any_text, "memo") else test_memo_on_any_text.memo
    test_memo_on_any_text.memo = memo
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert memo.ids([t.encode() for t in texts]) == [brute_ids(t)[:-1].tobytes() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=9))
def test_bound_and_packing(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets, fills = P.best_fit_decreasing(lengths, 32)
    assert (fills <= 32).all() and fills.sum() == lengths.sum()

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        best = fewest(left[1:], [*rooms, 32 - left[0]]) if len(rooms) < 9 else 99
        for k in {r: i for i, r in enumerate(rooms) if r >= left[0]}.values():
            best = min(best, fewest(left[1:], [r - left[0] * (i == k) for i, r in enumerate(rooms)]))
        return best

    if len(lengths) <= 7:
        optimum = fewest(lengths.tolist(), [])
        assert P.lower_bound(lengths, 32) <= optimum <= len(fills)


def check(rows, packed, capacity):
    """Every token is placed once, gapless, in a sequence that holds it."""
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
    want = {i: brute_ids(t) for i, t in rows}
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [k * capacity for k in range(len(own))]
        assert sum(r.length for r in own) == len(want[i]) and all(r.length == capacity for r in own[:-1])
        for r in own:
            assert zlib.crc32(want[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_round_trip(spark):
    rows = [*enumerate(TEXTS), (100, None), *((200 + i, "word one two " * (i % 97)) for i in range(300))]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, part int, bin string")
    packed = P.best_fit_packing(df)
    n = check(rows, packed.collect(), P.SEQUENCE)
    assert n == -(-sum(len(brute_ids(t)) for _, t in rows) // P.SEQUENCE) and P.certificate(packed) == (n, n)
    cut = P.pieces(df, T.read_tokenizer(), 64)
    check(rows, P.pack(cut, 64, per_partition=50).collect(), 64)  # many rounds of exchange


def test_empty_and_repeated(spark):
    none = P.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == [] and P.certificate(none) == (0, 0)
    got = P.best_fit_packing(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 2), (1, 2)] and sorted(r.offset for r in got) == [0, 2, 4]


def test_column_missing(spark):
    with pytest.raises(ValueError, match="text"):
        P.pieces(spark.createDataFrame([(1,)], "doc_id long"), "")
