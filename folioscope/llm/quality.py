"""Quality classifier (3): ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w x): one weight vector over hashed text features is shared
by all grades, the thresholds are ordered. The expected grade is the sum of the tail probabilities;
a text is selected if its tail probability at the asked grade reaches one half.

Features of the whole text, hashed into 2**16 places: words, shapes of words (runs of capitals,
small letters, digits and signs), pairs of shapes, repeated words, and the magnitude of the length;
each as the square root of its share.

The regression is fitted in numpy on at most ``SAMPLE_ROWS`` labelled rows (see ``labelled``). Ratings are
any whole numbers; ``ratings`` makes three grades of the two labels of a document.

Defined cases: null text counts as empty and is scored; a word counts whole, however long; without labels
every text has tail probability 1 and is selected (nothing is known against it); a single grade gives that
grade; repeated rows are scored once each; extra columns are kept by the filter, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fail_unless, own_columns, remember
from .labelled import SAMPLE_ROWS, sample, scored

BITS = 16
PLACES = 1 << BITS
MOST_WORDS = 300_000
PENALTY, STEPS = 3e-5, 400
_SHAPE = bytes(b"A"[0] if 65 <= b <= 90 else b"a"[0] if 97 <= b <= 122 or b >= 128 else b"0"[0] if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class Shapes(dict):
    """word -> (hash of the word, hash of its shape); bounded, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        short = _RUN.sub(rb"\1", word.translate(_SHAPE))
        out = self[word] = (zlib.crc32(b"w" + word.lower()) % PLACES) << 32 | zlib.crc32(b"s" + short)
        return out


_shapes = Shapes()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    words = text.split()
    n = len(words)
    if not n:
        return np.array([1]), np.ones(1)
    both = np.fromiter(map(_shapes.__getitem__, words), np.int64, n)
    word, shape = both >> 32, both & 0xFFFFFFFF
    same = np.count_nonzero(both[1:] == both[:-1])
    with np.errstate(over="ignore"):
        pair = ((shape[1:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + shape[:-1].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int64)
    places, counts = np.unique(np.concatenate([word, shape % PLACES, pair]), return_counts=True)
    extra = np.array([2, 3, 16 + n.bit_length()])
    return np.concatenate([places, extra]), np.concatenate([np.sqrt(counts / n), [np.sqrt(same / n), np.sqrt(len(set(words)) / n), 1.0]])


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each k but the last, by text."""
        eta = np.array([float(self.weights[p] @ v) for p, v in map(features, texts)])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -500, 500)))


def fit(texts: list[bytes], grades: np.ndarray) -> Ordinal:
    """Maximum likelihood with a small ridge penalty, by Adam over the whole sample."""
    levels, y = np.unique(grades, return_inverse=True)
    if len(levels) < 2:
        return Ordinal([int(g) for g in levels], np.zeros(PLACES, np.float64), np.zeros(0))
    parts = [features(t) for t in texts]
    row = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
    place, value = np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])
    k, n = len(levels) - 1, len(y)
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    start = np.log(share / (1 - share))
    # thresholds as a first one and the logarithms of the gaps, so that they stay ordered
    w, t = np.zeros(PLACES), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    moments = [np.zeros(PLACES), np.zeros(PLACES), np.zeros(k), np.zeros(k)]
    for step in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        eta = np.bincount(row, value * w[place], n)
        edge = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(eta[:, None] - theta[None, :], -500, 500))), np.ones((n, 1))], 1)
        high, low = edge[np.arange(n), y + 1], edge[np.arange(n), y]
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        d_eta = -(slope_high - slope_low) / p
        gw = -np.bincount(place, value * d_eta[row], PLACES) / n + PENALTY * w
        d_theta = np.zeros((n, k + 2))
        d_theta[np.arange(n), y + 1] += slope_high / p
        d_theta[np.arange(n), y] -= slope_low / p
        g_theta = d_theta[:, 1:-1].sum(0) / n
        after = np.cumsum(g_theta[::-1])[::-1]
        gt = -np.concatenate([after[:1], after[1:] * np.exp(t[1:])])
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (t, gt, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Ordinal([int(g) for g in levels], w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def _rate(model: Ordinal, texts: list[bytes]) -> np.ndarray:
    """Expected grade and tail probability of the asked grade, by text."""
    remember("quality", _shapes.clear)
    tails = model.tails(texts) if len(model.grades) > 1 else np.zeros((len(texts), 0))
    gaps = np.diff(np.array(model.grades, float)) if len(model.grades) > 1 else np.zeros(0)
    base = float(model.grades[0]) if model.grades else 0.0
    at = getattr(model, "asked", 0)
    tail = tails[:, at] if tails.shape[1] else np.ones(len(texts))
    return np.stack([base + tails @ gaps, tail], 1)


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, rating): 0 for a text of no quality, 1 for one of quality that is toxic, 2 for one that is neither.

    An unknown toxicity counts as none; an unknown quality gives no rating.
    """
    fail_unless(("doc_id", "quality", "toxic"), labels, "labels")
    good = F.col("quality").cast("int") > 0
    return labels.select("doc_id", F.when(~good, 0).when(good & (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) > 0), 1).when(good, 2).alias("rating"))


def rated(documents: DataFrame, graded: DataFrame, grade: int = 1, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """documents with the expected grade and the probability of ``grade`` or a higher one, in a column of the name returned.

    graded: (doc_id, rating), ratings being whole numbers.
    """
    fail_unless(("doc_id", "text"), documents, "documents")
    fail_unless(("doc_id", "rating"), graded, "ratings")
    model = fit(*sample(documents, graded, "rating", rows))
    model.asked = max(0, min(len(model.grades) - 2, int(np.searchsorted(model.grades, grade)) - 1))
    return scored(documents, _rate, model, 2)


def quality(documents: DataFrame, labels: DataFrame, grade: int = 1) -> DataFrame:
    """Per document: doc_id, expected_grade, tail_probability, selected."""
    out, scores = rated(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratings(labels), grade)
    tail = F.col(scores)[1]
    return out.select("doc_id", F.col(scores)[0].alias("expected_grade"), tail.alias("tail_probability"), (tail >= 0.5).alias("selected"))


def selected(documents: DataFrame, labels: DataFrame, grade: int = 1) -> DataFrame:
    """The documents of the asked grade, with all their columns."""
    out, scores = rated(documents, ratings(labels), grade)
    return out.where(F.col(scores)[1] >= 0.5).select(*own_columns(documents))
