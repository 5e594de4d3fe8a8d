"""Local hash embeddings and their cosine; the provider interface."""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class EmbeddingProvider(ABC):
    """name, model and dimensions, and vectors of texts."""

    name: str
    model: str
    dimensions: int

    @abstractmethod
    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


def tokens(text: str) -> list[str]:
    """Letters, digits, _ and -; camel case is cut before an upper-case letter behind a lower-case one or a digit."""
    out, current, open_ = [], "", False
    for c in text:
        if not (c.isalnum() or c in "_-"):
            out.append(current)
            current, open_ = "", False
            continue
        if c.isupper() and open_ and current:
            out.append(current)
            current = ""
        open_ = c.islower() or c.isnumeric()
        current += c.lower()
    return [t for t in (*out, current) if t]


class HashEmbedding(EmbeddingProvider):
    """Signed feature hashing of tokens (weight 1) and their character 2- and 3-grams (weight .35), in 384 dimensions."""

    name, model, dimensions = "local-hash", "token-ngram-v1", 384

    def embed(self, text: str) -> list[float]:
        counts: Counter[bytes] = Counter()
        for t in tokens(text):
            counts[f"token:{t}".encode()] += 1
            for width in (2, 3):
                counts.update(f"ngram:{width}:{t[k : k + width]}".encode() for k in range(len(t) - width + 1))
        vector = np.zeros(self.dimensions, np.float32)
        for feature in sorted(counts):  # the order of additions is part of the result
            d = hashlib.sha256(feature).digest()
            weight = np.float32(1.0 if feature.startswith(b"token:") else 0.35)
            frequency = np.float32(1.0) + np.float32(math.log(np.float32(counts[feature])))
            at = int.from_bytes(d[:8], "little") % self.dimensions
            vector[at] += (np.float32(-1) if d[8] & 1 else np.float32(1)) * weight * frequency
        norm = math.sqrt(float((vector.astype(np.float64) ** 2).sum()))
        return (vector.astype(np.float64) / norm).astype(np.float32).tolist() if norm else vector.tolist()


def embed_column(provider: EmbeddingProvider):
    """A pandas UDF text -> array<float>."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider.embed_batch(texts.fillna("").tolist()))

    return embed


def cosine(a: Column, b: Column) -> Column:
    """In doubles; null unless both are finite and of one size, 0 for a zero vector, within -1 to 1."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    value = F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm(a) * norm(b)))))
    fine = (F.size(a) == F.size(b)) & ~F.exists(F.concat(a, b), lambda v: F.coalesce(~(F.abs(v) < F.lit(float("inf"))), F.lit(True)))
    return F.when(fine, value)
