"""Overview of a knowledge base: counts, categories, areas, newest page, heads and log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Caps and defaults of the command.
MOST_PAGES, MOST_LOG, MOST_HEAD, HEAD = 5000, 50, 2000, 200
ROOT_DOCUMENTS = ("AGENTS.md", "index.md", "log.md")
LOG_MARK = "## ["


def summary(pages: DataFrame) -> DataFrame:
    """One row: pages, categories (sorted), newest page (of equals the first by path), presence flags."""
    root = F.col("path").isin(*ROOT_DOCUMENTS)
    folder = F.when(F.col("path").contains("/"), T.category(F.col("path")))
    # of categories there are few; the set is theirs, not the pages'
    return pages.agg(
        F.count_if(~root).alias("pages"), F.array_sort(F.collect_set(folder)).alias("categories"), F.min_by(F.when(~root, F.col("path")), F.when(~root, F.struct(-F.col("modified_at"), "path"))).alias("newest"),
        F.bool_or(F.col("path") == "AGENTS.md").alias("has_agents"), F.bool_or(F.col("path") == "index.md").alias("has_index"), (F.count_if(~root) >= MOST_PAGES).alias("truncated"),
    )


def demand_base(pages: DataFrame, root: str) -> None:
    """LookupError unless the folder looks like a knowledge base: a root document, or a page in an area."""
    seen = pages.where(F.col("path").isin(*ROOT_DOCUMENTS) | T.area(F.col("path")).isNotNull()).limit(1)
    if seen.isEmpty():
        raise LookupError(f"{root} does not look like a knowledge base; --no-strict reads it all the same")


def newest_page(pages: DataFrame) -> DataFrame:
    """path, modified_at, modified: the newest page, the first by path of equals."""
    rows = pages.where(~F.col("path").isin(*ROOT_DOCUMENTS)).orderBy(F.desc("modified_at"), "path").limit(1)
    return rows.select("path", "modified_at", F.date_format(F.timestamp_seconds("modified_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))


def areas(pages: DataFrame) -> DataFrame:
    """area, rank, pages for every knowledge area, empty ones too."""
    spark = pages.sparkSession
    names = spark.createDataFrame(list(enumerate(T.AREAS)), "rank long, area string")
    counts = pages.select(T.area(F.col("path")).alias("area")).where("area is not null").groupBy("area").agg(F.count("*").alias("pages"))
    return names.join(counts, "area", "left").select("area", "rank", F.coalesce("pages", F.lit(0)).alias("pages"))


def head(pages: DataFrame, path: str, n: int = HEAD) -> DataFrame:
    """body, partial: the first n lines of a root document and whether there are more."""
    n = max(1, min(MOST_HEAD, n))
    lines = T.lines(F.col("text"))
    return pages.where(F.col("path") == path).select(F.array_join(F.slice(lines, 1, n), "\n").alias("body"), (F.size(lines) > n).alias("partial"))


def log_tail(pages: DataFrame, n: int) -> DataFrame:
    """path, entry, body: the last n entries of each log; without any mark, the last n lines."""
    n = max(0, min(MOST_LOG, n))
    rows = pages.select("path", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    mark = T.trimmed(F.col("line")).startswith(LOG_MARK)
    so_far = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("path")
    rows = rows.withColumn("entry", F.sum(mark.cast("int")).over(so_far)).withColumn("entries", F.max("entry").over(all_)).withColumn("last", F.max("k").over(all_))
    kept = rows.where(F.when(F.col("entries") > 0, (F.col("entry") > F.col("entries") - n) & (F.col("entry") > 0)).otherwise(F.col("k") > F.col("last") - n))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("path", "entry").agg(body.alias("body"))


def text(pages: DataFrame, log_last: int = 0, heads: int = HEAD, with_agents: bool = True, with_index: bool = True) -> str:
    """The overview as text, from one row, four counts and two bounded heads."""
    s = summary(pages).first()
    out = ["# Overview", f"Pages: {s['pages']}" + (" (capped)" if s["truncated"] else ""), f"Categories: {', '.join(s['categories']) or '(none)'}"]
    out += [f"- {r['area']}: {r['pages']}" for r in areas(pages).orderBy("rank").collect()]
    if s["newest"]:
        out.append(f"Newest: {s['newest']}")
    for path, wanted in (("AGENTS.md", with_agents), ("index.md", with_index)):
        row = head(pages, path, heads).first() if wanted else None
        if row:
            out += ["", f"## {path}" + (" (partial)" if row["partial"] else ""), row["body"]]
    if log_last:
        out += ["", "## log.md", *(r["body"] for r in log_tail(pages.where("path = 'log.md'"), log_last).orderBy("entry").collect())]
    return "\n".join(out) + "\n"
