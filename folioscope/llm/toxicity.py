"""Toxicity (6): subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character 3- to 5-grams and of itself, a stretch of
``STRETCH`` words the mean of its words, and a linear softmax over the two labels scores it; vectors
and softmax are trained together (Joulin et al., 2017). A misspelling that was never seen shares
most n-grams with what was. Stretches, not documents, are averaged: one insult in a long text would
vanish in its mean. A document scores as its highest stretch, through a logistic curve fitted on
the documents of the sample. After a first pass, in which a stretch has the label of its document,
toxic documents train with their highest stretches alone. Stretches of clean documents take turns over the
epochs, ``NEGATIVES`` for each toxic one, so that none is left out before others come twice.

At most ``SAMPLE_ROWS`` labelled rows outside the held-out fold are used to fit (see ``labelled``).
Scores are computed from the whole text and nothing else.

Defined cases: null and empty texts are scored as a text without words; a word of any length counts whole, in
overlapping pieces; without labels all scores
are 0, with one label its value, kept within 0 to 1; repeated rows are scored once each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fail_unless
from .labelled import SAMPLE_ROWS, fold, sample, scored

BITS, WIDTH = 17, 8
PLACES = 1 << BITS
STRETCH = 8
#: bytes of a word; a longer one is cut into pieces that share so many bytes, four characters at least
PIECE, SHARED = 64, 16
GRAMS = (3, 4, 5)
MOST_WORDS = 300_000
EPOCHS, BATCH, RATE = 8, 2048, 0.08
#: stretches of label 0 in an epoch: so many for each one of label 1, and no fewer than so many; each waits its turn in a shuffled queue
NEGATIVES, LEAST_NEGATIVES = 12, 20_000
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)


def pieces(word: bytes) -> list[bytes]:
    """A long word as overlapping pieces of whole characters; each of its n-grams is in one."""
    out, start = [], 0
    while len(word) - start > PIECE:
        end = _boundary(word, start + PIECE)
        out.append(word[start:end])
        start = _boundary(word, end - SHARED)
    return [*out, word[start:]]


def _boundary(word: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins; characters have four bytes at most."""
    return next((k for k in range(at, at - 4, -1) if word[k] & 0xC0 != 0x80), at)


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(_SIGNS).split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [p for w in words for p in pieces(w)]


def places_of(word: bytes) -> list[int]:
    """The hashed n-grams of a word, over characters."""
    w = f"<{word.decode('utf-8', 'ignore')}>"
    grams = {w, *(w[k : k + n] for n in GRAMS for k in range(len(w) - n + 1))}
    return sorted(zlib.crc32(g.encode()) % PLACES for g in grams)


@dataclass
class Subwords:
    """A number for each n-gram: the difference of the two logits that its vector makes."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def __post_init__(self):
        self.words: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"words": {}}

    def word(self, w: bytes) -> float:
        out = self.words.get(w)
        if out is None:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            out = self.words[w] = float(self.table[places_of(w)].mean())
        return out

    def highest(self, text: bytes) -> float:
        """The highest logit of a stretch; stretches overlap by half."""
        words = words_of(text)
        if not words:
            return self.bias
        s = np.fromiter(map(self.word, words), np.float64, len(words))
        if len(s) <= STRETCH:
            return float(s.mean()) + self.bias
        total = np.concatenate([[0.0], np.cumsum(s)])
        starts = np.unique(np.append(np.arange(0, len(s) - STRETCH + 1, STRETCH // 2), len(s) - STRETCH))
        return float((total[starts + STRETCH] - total[starts]).max()) / STRETCH + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.array([self.highest(t) for t in texts])
        return 1 / (1 + np.exp(np.clip(-(self.slope * x + self.shift), -500, 500)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y on x, by Newton's method with a small penalty."""
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / spread, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + np.array([0.02, 0]) * b
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.02, 1e-6])
        move = np.linalg.solve(h, g)
        b -= np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-8:
            break
    return float(b[0] / spread), float(b[1] - b[0] * mean / spread)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Subwords:
    labels = (labels > 0).astype(np.int64)
    if len(set(labels.tolist())) < 2:
        return Subwords(np.zeros(PLACES), 0.0, 1.0, 0.0, float(labels[0]) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    stretches, owner = [], []
    for d, text in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        for k in range(0, len(ids), STRETCH):
            stretches.append(ids[k : k + STRETCH])
            owner.append(d)
    owner = np.array(owner)
    grams = [places_of(w) for w in vocabulary]
    sizes = np.array([len(g) for g in grams])
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.array([p for g in grams for p in g], np.int64)
    vectors = rng.normal(0, 0.1, (PLACES, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    square_v, square_o, square_b = np.full(PLACES, 1e-6, np.float32), np.full((WIDTH, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def gathered(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretch, the place and the share of each n-gram of the chosen stretches."""
        lens = np.array([len(stretches[c]) for c in chosen])
        word = np.concatenate([stretches[c] for c in chosen])
        of_word = np.repeat(np.arange(len(chosen)), lens)
        n = sizes[word]
        at = np.repeat(first[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.repeat(of_word, n), flat[at], np.repeat(1.0 / (n * lens[of_word]), n).astype(np.float32)

    def means(s: np.ndarray, p: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
        starts = np.searchsorted(s, np.arange(n))
        return np.add.reduceat(vectors[p] * share[:, None], starts, axis=0)

    positive, negative = np.flatnonzero(labels[owner] == 1), np.flatnonzero(labels[owner] == 0)
    use, queue = positive, np.zeros(0, np.int64)
    for epoch in range(EPOCHS):
        if epoch >= 2:  # toxic documents now teach by their highest stretches
            difference = vectors @ (out[:, 1] - out[:, 0])
            word_scores = np.add.reduceat(difference[flat], first[:-1]) / sizes
            score = np.array([word_scores[stretches[c]].mean() for c in positive])
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner[positive], score)
            use = positive[score >= 0.5 * top[owner[positive]] + np.where(top[owner[positive]] < 0, 0.5 * top[owner[positive]], 0)]
        turn = min(len(negative), max(NEGATIVES * len(use), LEAST_NEGATIVES))
        while len(queue) < turn:
            queue = np.concatenate([queue, rng.permutation(negative)])
        order, queue = rng.permutation(np.concatenate([use, queue[:turn]])), queue[turn:]
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            s, p, share = gathered(chosen)
            mean = means(s, p, share, len(chosen))
            logits = mean @ out + bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True)
            d[np.arange(len(chosen)), labels[owner[chosen]]] -= 1
            g_out, g_bias, g_mean = mean.T @ d, d.sum(0), d @ out.T
            pull = g_mean[s] * share[:, None]
            seen, place = np.unique(p, return_inverse=True)
            g = np.stack([np.bincount(place, pull[:, k], len(seen)) for k in range(WIDTH)], 1).astype(np.float32)
            square_v[seen] += (g * g).mean(1)
            vectors[seen] -= RATE * g / np.sqrt(square_v[seen])[:, None]
            square_o += g_out * g_out
            square_b += g_bias * g_bias
            out -= RATE * g_out / np.sqrt(square_o)
            bias -= RATE * g_bias / np.sqrt(square_b)
    model = Subwords((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), 1.0, 0.0)
    model.slope, model.shift = _curve(np.array([model.highest(t) for t in texts]), labels.astype(float))
    return model


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    fail_unless(("doc_id", "text"), documents, "documents")
    fail_unless(("doc_id", "toxic"), labels, "labels")
    model = fit(*sample(documents, labels, "toxic", rows))
    out, scores = scored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Subwords.scores, model, 1)
    score = F.col(scores)[0]
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
