"""Embedding whitening (13): an exact integer scatter, then the eigenvectors of the covariance.

Each entry c of a vector becomes the integer x = floor(64 c) + 1000000. Tasks subtract the shift 1000000 and add up
sums and cross-products of the distinct vectors without rounding: integers are cut into limbs whose products
a float matrix product carries exactly, and what it gives goes into integers of any length. The tasks' sums are
dealt out as parts of 32 bits, which Spark adds up by entry. n X'X - S S' is then formed of integers, and only
its quotient by n^2 is a float, which eigh decomposes.

What the driver holds is the matrix of one entry for each pair of dimensions, whatever the number of rows; tasks
hold the same. Rows are written once (distinct vectors) and read again for the covariance of the whitened.

Defined cases: rows whose vector is null or holds nulls, NaN or infinities are dropped, rows of empty vectors have no
component and give no rows; vectors of another length are another space and are whitened among themselves; repeated
rows are fitted once and returned each; null ids are kept; entries beyond 2^62 / 64 count as that; components whose
variance is zero, or so far below the largest that rounding in eigh leaves fewer than four digits of it (NOISE), cannot be
scaled and give no rows (so does a single vector, or copies of one); a deviation of over 38 digits is null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fail_unless, written

#: fixed values of the contract: entries are x = floor(SCALE c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: components returned
MOST = 16
#: entries are held within this
WITHIN = float(1 << 62)
#: variances at most this times the largest, for each dimension, are rounding
NOISE = 1e4 * np.finfo(float).eps
#: bits of a limb and rows of a matrix product: 2 * 20 + 12 bits are exact in a float
LIMB, ROWS = 20, 1 << 12
#: matrix products added up in 64 bits before they go into integers of any length
PRODUCTS = 1 << 10


def shifted(vector: Column) -> Column:
    """The entries x - SHIFT of a vector of finite entries."""
    scaled = F.transform(vector, lambda c: F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), F.lit(-WITHIN)), F.lit(WITHIN))))
    return scaled.cast("array<bigint>")


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, dim, y) of the rows that remain, y being the entries without the shift."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).select("vec_id", F.size(v).alias("dim"), shifted(v).alias("y"))


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places in the batch, matrix of the rows there) for each length and at most ROWS rows."""
    dims = batch.column("dim").to_numpy()
    flat = batch.column("y").flatten().to_numpy()
    ends = np.cumsum(dims.astype(np.int64))
    for dim in np.unique(dims):
        places = np.flatnonzero(dims == dim)
        for k in range(0, len(places), ROWS):
            at = places[k : k + ROWS]
            yield int(dim), at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as floats of at most LIMB bits, lowest first."""
    out = []
    while True:
        if not len(y) or -(1 << LIMB) <= y.min() and y.max() <= 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


class Scatter:
    """Exact count, sums and cross-products of integer rows."""

    def __init__(self, dim: int) -> None:
        self.n, self.sums, self.products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        self.open: dict[int, list[np.ndarray]] = {}  # by power of the limb
        self.added = 0

    def add(self, y: np.ndarray) -> None:
        self.n += len(y)
        parts = limbs(y)
        for a, low in enumerate(parts):
            self._open(a)[0][:] += low.sum(0).astype(np.int64)
            for b, high in enumerate(parts):
                self._open(a + b)[1][:] += (low.T @ high).astype(np.int64)
        self.added += 1
        if self.added >= PRODUCTS // len(parts):
            self.close()

    def _open(self, power: int) -> list[np.ndarray]:
        dim = len(self.sums)
        return self.open.setdefault(power, [np.zeros(dim, np.int64), np.zeros((dim, dim), np.int64)])

    def close(self) -> None:
        for power, (s, p) in self.open.items():
            self.sums += s.astype(object) * (1 << LIMB * power)
            self.products += p.astype(object) * (1 << LIMB * power)
        self.open, self.added = {}, 0

    def entries(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, value): the count at (-1, -1), sums at (-1, j), cross-products at i <= j."""
        self.close()
        yield -1, -1, self.n
        for j, s in enumerate(self.sums):
            yield -1, j, int(s)
        for i in range(len(self.sums)):
            for j in range(i, len(self.sums)):
                yield i, j, int(self.products[i, j])


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Scatter] = {}
    for batch in batches:
        for dim, _, y in blocks(batch):
            found.setdefault(dim, Scatter(dim)).add(y)
    for dim, scatter in found.items():
        out = [(dim, i, j, k, part) for i, j, value in scatter.entries() for k, part in _parts(value)]
        for at in range(0, len(out), 1 << 16):
            columns = list(zip(*out[at : at + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["dim", "i", "j", "k", "part"])


def _parts(value: int) -> Iterator[tuple[int, int]]:
    """The parts of 32 bits of a value that are not zero, each with its sign."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if part := value & 0xFFFFFFFF:
            yield k, sign * part
        value, k = value >> 32, k + 1


class Space:
    """What is fitted to the vectors of one length: n, sums S (of y), components as columns, variances, trace of the covariance."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int]) -> None:
        dim = len(sums)
        self.n, self.sums = n, sums
        exact = {(i, j): n * products.get((i, j), 0) - sums[i] * sums[j] for i in range(dim) for j in range(i, dim)}
        covariance = np.zeros((dim, dim))
        for (i, j), value in exact.items():
            covariance[i, j] = covariance[j, i] = value / (n * n)
        self.trace = sum(exact[i, i] for i in range(dim)) / (n * n)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:MOST], vectors[:, ::-1][:, :MOST]
        kept = values > max(values[0], 0.0) * dim * NOISE
        self.variances, self.components = values[kept], np.ascontiguousarray(vectors[:, kept])

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n y - S, as 64-bit integers where these hold it."""
        largest = max(abs(int(y.min())), abs(int(y.max()))) if len(y) else 0
        if self.n * largest + max(map(abs, self.sums)) < 1 << 62:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.components / np.sqrt(self.variances)

    def deviations(self, centred: np.ndarray) -> list[int]:
        if centred.dtype != object:
            largest = max(abs(int(centred.min())), abs(int(centred.max())))
            if largest * largest * centred.shape[1] < 1 << 63:
                return (centred * centred).sum(1).tolist()
        return [int(x) for x in (centred.astype(object) ** 2).sum(1)]


def fitted(vectors: DataFrame) -> dict[int, Space]:
    """The space of each length in vectors (dim, y), each row once."""
    parts = vectors.mapInArrow(_scatter, "dim int, i int, j int, k int, part long").groupBy("dim", "i", "j", "k").agg(F.sum("part").alias("part"))
    values: dict[int, dict[tuple[int, int], int]] = {}
    for dim, i, j, k, part in parts.collect():  # an entry for each pair of dimensions
        own = values.setdefault(dim, {})
        own[i, j] = own.get((i, j), 0) + (part << 32 * k)
    return {dim: Space(own.pop((-1, -1)), [own.pop((-1, j), 0) for j in range(dim)], own) for dim, own in values.items()}


def identity_error(vectors: DataFrame, spaces: dict[int, Space]) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity; null without components.

    Each task centres what it has seen and merges the means; what it gives is a row for each pair of components.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, y in blocks(batch):
                space = spaces[dim]
                w = space.whitened(space.centred(y))
                own = w.mean(0)
                n, mean, m2 = state.get(dim, (0, np.zeros(w.shape[1]), np.zeros((w.shape[1], w.shape[1]))))
                apart, both = own - mean, n + len(w)
                m2 = m2 + (w - own).T @ (w - own) + np.outer(apart, apart) * (n * len(w) / both)
                state[dim] = both, mean + apart * (len(w) / both), m2
        rows = [(dim, i, j, float(n), float(mean[i]), float(mean[j]), float(m2[i, j])) for dim, (n, mean, m2) in state.items() for i in range(len(mean)) for j in range(i, len(mean))]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 4
        names = ["dim", "i", "j", "n", "a", "b", "m2"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    each = vectors.mapInArrow(moments, "dim int, i int, j int, n double, a double, b double, m2 double")
    n, a, b = F.sum("n"), F.sum(F.col("n") * F.col("a")), F.sum(F.col("n") * F.col("b"))
    covariance = F.sum(F.col("m2") + F.col("n") * F.col("a") * F.col("b")) / n - (a / n) * (b / n)
    off = each.groupBy("dim", "i", "j").agg(covariance.alias("v")).select(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("off"))
    return off.agg(F.max("off")).first()[0]


def whitening(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Per remaining row and component up to MOST: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    fail_unless(("vec_id", vector), rows, "embeddings")
    kept = integers(rows, vector)
    vectors = written(kept.select("dim", "y").distinct(), "distinct-vectors")
    spaces = fitted(vectors)
    error = identity_error(vectors, spaces)
    kind = rows.schema["vec_id"].dataType
    decimal = pa.decimal128(38, 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, y in blocks(batch):
                space = spaces[dim]
                k = len(space.variances)
                if not k:
                    continue
                centred = space.centred(y)
                exact = [d if d < 10**38 else None for d in space.deviations(centred)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, space.n, np.int64)),
                        pa.array(exact, decimal).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(space.whitened(centred).ravel()), pa.array(np.tile(space.variances / space.trace, len(at))),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    out = kept.mapInArrow(project, f"vec_id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double")
    return out.withColumn("identity_error", F.lit(error).cast("double"))
