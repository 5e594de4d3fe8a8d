"""Line dedup (5): distinct-site spread of lines, removal of cross-site boilerplate.

Lines are compared by the digest of their trimmed text: the report of the query trims spaces alone, as its
SQL does; the filters trim all ASCII white space, so that pages with CRLF and LF line ends meet. A HyperLogLog sketch of the sites of each
line is aggregated, merging what each task has sketched. Lines whose estimate is clearly below the
threshold stay; lines clearly above it are boilerplate; for those near it the distinct sites are
counted exactly. Of a boilerplate line the first occurrence of the corpus stays (smallest id,
then smallest place), all others are removed from their documents.

Passages, lines of more than ``PASSAGE`` words, are no matter of sites: without_passages removes each that
stands in two documents, all but its first occurrence. It is meant for documents that are no near
copies of one another, since near copies share most of their passages.

DataFrame functions only. What is shuffled are digests; the texts move once, to meet the places of
their removed lines.

Defined cases: null text has no lines and stays null; empty and blank lines are never boilerplate;
a null site is a site of its own; repeated rows are occurrences like any other (a row is told apart
by its id and its text; rows equal in both keep or lose the same lines); extra columns are kept, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fail_unless, fits_broadcast, free_names, own_columns, written

#: sites on which a line must stand to be boilerplate
SITES = 10
#: log2 of the sketch's registers; a relative standard error of 1.04 / sqrt(2**10), about 3.3 %
SKETCH = 10
#: estimates within this factor of the threshold are counted exactly; over six standard errors
NEAR = 1.25
#: so many lines to remove are broadcast, some 10 MB; beyond, they are dealt out by so many salts, since one line may stand in a third of all rows
BROADCAST_LINES, SALTS = 100_000, 32
#: a line of more words (runs between white space) is a passage
PASSAGE = 50
#: what the filters trim
WHITE = " \t\n\r\v\f"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _occurrences(documents: DataFrame, longer: int = 0, white: str = " ") -> DataFrame:
    """(id, text_hash, at, site, line): one row for each line of more than ``longer`` words, line being its digest without the ``white`` around it."""
    site = F.coalesce(F.col("source").cast("string"), F.lit("\x00"))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), site.alias("site"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(white))).where("line <> ''")
    if longer:  # so many words have as many characters and the spaces between
        rows = rows.where((F.char_length("line") > 2 * longer) & (F.size(F.split("line", "\\s+")) > longer))
    return rows.withColumn("line", F.substring(F.unhex(F.sha2("line", 256)), 1, 16))


def spread_of_lines(rows: DataFrame, sites: int = SITES) -> DataFrame:
    """(line, sites, exact, id, at) of boilerplate lines, id and at being those of the occurrence that stays."""
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")).alias("first")
    sketched = rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH)).alias("sketch"), first)
    sketched = sketched.select("line", F.hll_sketch_estimate("sketch").alias("estimate"), "first.id", "first.at").where(F.col("estimate") >= sites / NEAR)
    sketched = written(sketched, "spread-lines")
    near = sketched.where(F.col("estimate") < sites * NEAR)
    # exact counts: distinct pairs first, so that a frequent line is small before it is shuffled
    pairs = rows.select("line", "site").join(near.select("line"), "line", "left_semi").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites)
    sure = sketched.where(F.col("estimate") >= sites * NEAR).select("line", F.col("estimate").alias("sites"), F.lit(False).alias("exact"), "id", "at")
    return sure.unionByName(near.join(exact, "line").select("line", "sites", F.lit(True).alias("exact"), "id", "at"))


def passages_of(rows: DataFrame) -> DataFrame:
    """(line, id, at) of the lines that stand in two documents, id and at being those of the occurrence that stays."""
    document = F.struct("id", "text_hash")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")).alias("first")
    found = rows.groupBy("line").agg(F.min(document).alias("low"), F.max(document).alias("high"), first)
    return found.where(~F.col("low").eqNullSafe(F.col("high"))).select("line", "first.id", "first.at")


def marked(documents: DataFrame, sites: int = SITES, white: str = " ") -> tuple[DataFrame, str]:
    """documents with one more column, the places of lines to remove (null for none), and its name."""
    fail_unless(("doc_id", "text", "source"), documents, "documents")
    rows = written(_occurrences(documents, white=white), "line-digests")
    return _with_places(documents, rows, written(spread_of_lines(rows, sites), "boilerplate"))


def _with_places(documents: DataFrame, rows: DataFrame, spread: DataFrame, broadcast_lines: int = BROADCAST_LINES) -> tuple[DataFrame, str]:
    """documents with the places in rows of the lines of spread but for the occurrence that stays, and the column's name."""
    lines = spread.select("line", F.col("id").alias("stays_id"), F.col("at").alias("stays_at"))
    if fits_broadcast(lines, broadcast_lines):
        hit = rows.join(F.broadcast(lines), "line")
    else:
        salted = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = rows.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["line", "salt"])
    hit = hit.where(~(F.col("id").eqNullSafe(F.col("stays_id")) & (F.col("at") == F.col("stays_at"))))
    gone_at, id_, hash_ = free_names(documents, "gone", "of_id", "of_hash")
    gone = hit.groupBy(F.col("id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.collect_set("at").alias(gone_at))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    return documents.join(gone.hint("shuffle_hash"), same, "left").drop(id_, hash_), gone_at


def cleaned_text(gone_at: str) -> Column:
    kept = F.filter(lines_of(F.col("text")), lambda line, at: ~F.array_contains(F.col(gone_at), at))
    return F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def report(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_chars_kept, text_sha256 of the cleaned text."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    marks, gone_at = marked(slim, sites)
    return marks.withColumn("clean", cleaned_text(gone_at)).select(
        "doc_id", F.coalesce(F.size(lines_of(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("n_removed"),
        F.char_length("clean").cast("long").alias("n_chars_kept"), F.sha2("clean", 256).alias("text_sha256"),
    )


def without_boilerplate(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """documents with cleaned texts, all columns as they were (n_chars is counted anew if it is there).

    A document that had text and lost all of it is dropped: each of its lines stands in another one.
    """
    return _cleaned(documents, *marked(documents, sites, WHITE))


def without_passages(documents: DataFrame, longer: int = PASSAGE) -> DataFrame:
    """documents without the lines of more than ``longer`` words that stand in an earlier document or place too.

    Columns and emptied documents as in without_boilerplate.
    """
    fail_unless(("doc_id", "text", "source"), documents, "documents")
    rows = written(_occurrences(documents, longer, WHITE), "passage-digests")
    return _cleaned(documents, *_with_places(documents, rows, written(passages_of(rows), "passages")))


def _cleaned(documents: DataFrame, marks: DataFrame, gone_at: str) -> DataFrame:
    (clean,) = free_names(marks, "clean")
    out = marks.withColumn(clean, cleaned_text(gone_at))
    out = out.where(F.col(gone_at).isNull() | (F.trim(F.regexp_replace(clean, "\\s+", " ")) != ""))
    counted = {"n_chars": F.char_length(clean).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {}
    return out.withColumns({"text": F.col(clean), **counted}).select(*own_columns(documents))
