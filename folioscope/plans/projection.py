"""Markdown pages out of the documents table, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.sources import tree

from .tables import table


def path_of(x: str) -> str:
    return f"(CASE ({x})%5 WHEN 0 THEN 'notes/' WHEN 1 THEN 'ideas/' WHEN 2 THEN 'projects/' WHEN 3 THEN 'sdd/' ELSE '' END || 'doc-' || ({x}))"


def raw_sql(source: str = "documents") -> str:
    return f"SELECT doc_id, {path_of('doc_id')} || '.md' AS path, text FROM {source}"


def markdown_sql(n: str, source: str = "documents") -> str:
    """Pages with headings, resolved, dangling, repeated and fenced links, and entities; n: the number of documents."""
    following, third = path_of(f"((doc_id*7+1)%{n})"), path_of(f"((doc_id*3)%{n})")
    tick, nl = "chr(96)", "chr(10)"
    fence = f"{tick} || {tick} || {tick}"
    parts = [
        "'# Doc ' || doc_id", nl, nl, "text", nl, nl, "'## Links'", nl, nl, "'See [['", following, "'|next]] and [['", third, "']] and [[missing/'", "doc_id%11", "']].'", nl,
        f"CASE WHEN doc_id%4=0 THEN '[[' || {following} || '#top|again]]' || {nl} ELSE '' END", fence, nl, "'[[fenced/link]]'", nl, fence, nl, nl, "'## API'", nl, nl,
        "'fn handler_'", "doc_id%23", "'() '", tick, "'Svc_'", "doc_id%17", tick, "' reads '", tick, "'cfg.key_'", "doc_id%13", tick, "' in src/m_'", "doc_id%7", "'.rs '", "CASE WHEN doc_id%6=0 THEN '城池任务' ELSE '' END", nl,
    ]
    return f"SELECT doc_id, {path_of('doc_id')} || '.md' AS path, {' || '.join(parts)} AS text FROM {source}"


def raw(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Documents as pages with their texts as they are; those of a condition alone if it is given."""
    return tree.pages_of_table(spark.sql(raw_sql("{documents}"), documents=table(spark, sf_dir, "documents").where(where)))


def markdown(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Documents as Markdown pages; those of a condition alone if it is given, with links among all."""
    documents = table(spark, sf_dir, "documents")
    return tree.pages_of_table(spark.sql(markdown_sql(str(documents.count()), "{documents}"), documents=documents.where(where)))
