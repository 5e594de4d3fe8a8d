"""The corpus pipeline: stages that each filter or pack all that their predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents.

Defined cases: null texts pass the filters and are one piece with its closing id; rows without an id pass;
of rows that repeat the near-copy stage keeps one; extra columns are kept, whatever their names, and ignored
by the last stage; empty tables of documents, labels or benchmark give what is left, or an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontamination, jaccard_join, line_dedup, packing, quality
from folioscope.llm.common import table, written

#: what the near-copy stage links: five words of a shingle, a similarity of 0.8
NEAR_COPIES = jaccard_join.Likeness(5, 80, 100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: the lowest of three grades, by the tail probability of the second."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, all but their first occurrence."""
    return line_dedup.without_boilerplate(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that share four fifths of their five-word shingles stays; of repeated rows one."""
    return jaccard_join.one_of_each(docs, NEAR_COPIES)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that still repeat go, all but their first occurrence; then contaminated documents go.

    The passages come after the near copies, of which each shares most of its passages with another.
    """
    docs = written(line_dedup.without_passages(docs), "without-passages")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
