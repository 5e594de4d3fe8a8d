"""URL filters (2): host-suffix and path-prefix expressions, hash prefixes, full digests, precedence.

Each url becomes its host's suffixes at dots times its path's prefixes: those that end at a slash,
and for rules whose path does not end in one, those of the rules' path lengths. Suffixes of more labels
and prefixes of more characters than any rule has fit none, and are not made: an url has at most as many
expressions as the longest rule allows, however long it is. An expression's
SHA-256 has a short prefix on which it is equi-joined with the rules; the full digest confirms.
Of the rules that fit, the longest wins (host and path together; of equals the longer host).

Rules up to ``BROADCAST_RULES`` are broadcast, a checked size; beyond, both sides are dealt out by
prefix and a salt, so that an expression in a third of all urls is many keys.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; so does
an empty host; urls that fit no rule get the default verdict (allow); rules are unique by host and
path (of repeated ones, block goes before allow); repeated rows are judged once each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fail_unless, fits_broadcast

ALLOW, BLOCK = "allow", "block"
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]
PREFIX_BYTES = 4
BROADCAST_RULES = 100_000
SALTS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to a slash, question mark, hash or the end. Path: from there up to the latter three."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepared(rules: DataFrame) -> DataFrame:
    """(prefix, full, host, path, verdict) of the rules (host, path, verdict)."""
    one = rules.groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    full = digest(F.concat("rule_host", "rule_path"))
    return one.select(F.substring(full, 1, 2 * PREFIX_BYTES).alias("prefix"), full.alias("full"), "rule_host", "rule_path", "rule_verdict")


def expressions(lengths: list[int], most_labels: int, longest: int) -> Column:
    """All expressions of the columns host and path that a rule may have.

    ``lengths`` are those of rule paths without a final slash, ``most_labels`` the labels of the rule host
    with most of them, ``longest`` the length of the longest rule path: longer suffixes and prefixes fit no rule.
    """
    labels = F.split(F.substring_index("host", ".", most_labels and -most_labels), "\\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.split(F.substring("path", 1, longest), "/", -1)
    ending = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k < F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    other = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("path"))
    paths = F.array_union(ending, F.transform(other, lambda n: F.substring(F.col("path"), F.lit(1), n)))
    product = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(F.col("host") != "", F.array_distinct(product)).otherwise(F.array().cast("array<string>"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = ALLOW, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict."""
    fail_unless(("page_id", "url"), pages, "pages")
    rules = prepared(rules)
    lengths = sorted(r["n"] for r in rules.where(~F.col("rule_path").endswith("/")).select(F.char_length("rule_path").alias("n")).distinct().collect())
    most = rules.agg(F.max(F.size(F.split("rule_host", "\\.", -1))).alias("labels"), F.max(F.char_length("rule_path")).alias("path")).first()
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = split.select("page_id", "url", F.explode(expressions(lengths, most["labels"] or 0, most["path"] or 0)).alias("expression")).withColumn("digest", digest(F.col("expression"))).withColumn("prefix", F.substring("digest", 1, 2 * PREFIX_BYTES))
    if fits_broadcast(rules, broadcast_rules):
        fits = rows.join(F.broadcast(rules), "prefix")
    else:
        copies = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fits = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(copies, ["prefix", "salt"])
    fits = fits.where(F.col("digest") == F.col("full"))
    order = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), F.char_length("rule_host").alias("h"), "rule_host", "rule_path", "rule_verdict")
    best = fits.groupBy(F.col("page_id").alias("of_id"), F.col("url").alias("of_url")).agg(F.max(order).alias("best"))
    same = split["page_id"].eqNullSafe(best["of_id"]) & (split["url"] == best["of_url"])
    out = split.join(best.hint("shuffle_hash"), same, "left")
    return out.select("page_id", "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def standing_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")
