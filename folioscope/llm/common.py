"""Shared helpers: bounded batches, free names, components; the shared folder is that of the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.tables import BATCH_BYTES, BATCH_ROWS, discard, shared_folder, small_batches, table, written  # noqa: F401

#: what a worker process remembers between tasks, by operator
_remembered: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None]) -> None:
    """To be called as a task starts: worker processes serve one operator after another, and only the
    operator at work keeps its memos; those of all others are emptied."""
    for other in [k for k in _remembered if k != name]:
        _remembered.pop(other)()
    _remembered[name] = forget


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of df needs."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[str]:
    """The columns of df as select takes them, whatever dots, blanks or back-ticks their names have."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by a hash of keys into as many partitions as the session shuffles to."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def fits_broadcast(df: DataFrame, limit: int) -> bool:
    """True if df has at most limit rows; at most limit + 1 of them are looked at."""
    return df.limit(limit + 1).count() <= limit


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of (a long, b long): rows (node, label), label the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a partial
    aggregation and an equi-join that adaptive execution can split, written to the shared
    folder after each round. Rounds grow with the logarithm of the number of nodes.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(most_rounds):
        # large star: larger neighbours of u hang on the smallest node next to u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        done, e = e, written(small, name)
        discard(done)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def fail_unless(columns: Iterable[str], df: DataFrame, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
