"""A bounded sample of labelled texts for the classifiers, and their scoring loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, small_batches, written

#: rows of labels that a classifier is fitted on, at most; a documented parameter of each
SAMPLE_ROWS = 4000
#: bytes of text from which on no further row is taken into the sample; texts are never cut
SAMPLE_BYTES = 160_000_000
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def sample(documents: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE_ROWS, held_out: bool = True, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of at most ``most`` labelled rows, the first by a hash of the id.

    Rows of the held-out fold are left out. The chosen ids are few, by the bound, and broadcast. Of ids that
    repeat, 2 * most rows at most are taken, in the same order. Where the texts are very long, rows are taken
    until they hold ``most_bytes``, so that the driver holds no more than that and one text.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").distinct()
    if held_out:
        rows = rows.where(fold(F.col("doc_id")) != 0)
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    place = ["order", "doc_id", "label", "hash"]
    got = texts.join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("hash"))
    # rows that repeat are one row and their number, so that a third of all rows under one id does no harm
    got = written(got.groupBy(*place).agg(F.first("text").alias("text"), F.count("*").alias("copies")), "labelled-sample")
    found = got.select(*place, "copies", F.octet_length("text").alias("size")).orderBy(*place).limit(2 * most).collect()  # numbers only
    held, taken, end = 0, {}, None
    for row in found:
        if held >= most_bytes or sum(taken.values()) >= 2 * most:
            break
        held, end = held + row["size"], row
        taken[tuple(row[c] for c in place)] = min(row["copies"], 2 * most - sum(taken.values()))
    if end is not None and end is not found[-1]:
        got = got.where(F.struct(*place) <= F.struct(*(F.lit(end[c]).cast(got.schema[c].dataType).alias(c) for c in place)))
    own = got.select(*place, "text").limit(2 * most).toArrow()
    texts, places = own["text"].cast(pa.binary()).to_pylist(), zip(*(own[c].to_pylist() for c in place))
    table = sorted((t, p[2]) for t, p in zip(texts, places) for _ in range(taken.get(p, 0)))
    return [t for t, _ in table], np.array([y for _, y in table], np.int64)


def scored(documents: DataFrame, score: Callable[[object, list[bytes]], np.ndarray], model: object, width: int) -> tuple[DataFrame, str]:
    """documents with one more column, ``width`` doubles for each whole text, and its name; null counts as empty."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    text_at = documents.columns.index("text")
    (name,) = free_names(documents, "scores")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score(sent.value, batch.column(text_at).cast(pa.binary()).fill_null(b"").to_pylist())
            values = pa.FixedSizeListArray.from_arrays(pa.array(np.asarray(got, np.float64).reshape(-1)), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    plain = [f"c{k}" for k in range(len(documents.columns))]  # mapInArrow looks columns up by name, and names may hold anything
    fields = [T.StructField(c, f.dataType) for c, f in zip(plain, documents.schema.fields)]
    out = documents.toDF(*plain).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
    return out.toDF(*documents.columns, name), name
