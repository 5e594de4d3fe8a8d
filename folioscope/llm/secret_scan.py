"""Secret scans (11): base patterns, and runs that a model of random strings explains better than one of identifiers.

Two character Markov models of first order, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a run of at least RUN characters is a secret if the logarithm of the ratio of its likelihoods is at
least LEAST. Three patterns with fixed names of kinds come before; what they find always stays, and a run that
lies within one of their spans adds nothing.

DataFrame functions only. Texts are never shuffled: matches, their places (sums of the lengths of the pieces between
them) and scores are expressions of a row. The model is a table of one integer for each pair of characters, and all that the
driver holds. Places of m matches in one text take m to the power of 1.5 steps.

Random strings are made by a rule (digests in three alphabets). Ordinary identifiers are the words of at most
SAMPLE documents of the sample table whose label says that they are of quality, in customary forms of identifiers; what
the base patterns find is cut out before.

Defined cases: null text is an empty string; a row is a document, whatever its id; empty texts have no spans; without ordinary
words (empty sample) the models cannot be compared and the base patterns stand alone; runs without a letter or without a
digit are no random strings; places count code points; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fail_unless

#: fixed values of the contract: patterns of the kinds, and the least length of what counts
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
#: the kind of what the models find, and its runs
RANDOM, RUN = "random", 20
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: logarithms are counted in thousandths; odds of about 22,000 to 1 are asked for
UNIT, LEAST = 1000, 10_000
#: documents of ordinary words at most, those of the smallest digests of their ids, and random strings
SAMPLE, STRINGS = 300, 6_000


def places(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches of the pattern in text, leftmost and apart: array of (start, end, found), those whose group is shorter than least left out."""
    whole, own = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("size"), whole.alias("found"), F.transform(own, F.char_length).alias("own"))
    steps = F.slice(steps, 1, F.size(whole))
    ends = running(F.transform(steps, lambda s: s["gap"] + s["size"]))
    spans = F.zip_with(steps, ends, lambda s, e: F.struct((e - s["size"]).alias("start"), e.alias("end"), s["found"].alias("found"), s["own"].alias("own")))
    return F.filter(spans, lambda s: s["own"] >= least)


def running(lengths: Column) -> Column:
    """Running sums of an array, by blocks of the square root of its size."""
    zero = F.lit(0)

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(F.array().cast("array<int>").alias("all"), start.cast("int").alias("last"))
        step = lambda a, x: F.struct(F.concat(a["all"], F.array((a["last"] + x).cast("int"))).alias("all"), (a["last"] + x).cast("int").alias("last"))
        return F.aggregate(values, first, step, lambda a: a["all"])

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    blocks = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / width).cast("int")), lambda k: F.slice(lengths, k * width + 1, width))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    parts = F.zip_with(blocks, sums(totals, zero), lambda b, end: sums(b, end - F.aggregate(b, zero, lambda a, x: a + x)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(F.flatten(parts))


def pairs_of(strings: Column) -> Column:
    """Each string as the places in CHARACTERS of its characters' pairs, one number a pair."""
    known = F.lit(CHARACTERS)
    codes = F.transform(F.split(strings, ""), lambda c: F.instr(known, c) - 1)
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * len(CHARACTERS) + b)


def random_strings(spark: SparkSession, n: int = STRINGS) -> DataFrame:
    """(text, random): digests in the alphabets of base 64, of lower and of upper case letters with digits."""
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    bits = F.base64(F.unhex(digest))
    text = F.when(F.col("id") % 3 == 0, bits).when(F.col("id") % 3 == 1, F.regexp_replace(bits, "[^A-Za-z0-9]", "")).otherwise(F.upper(F.regexp_replace(bits, "[^A-Za-z0-9]", "")))
    return spark.range(n).select(text.alias("text"), F.lit(True).alias("random"))


def ordinary_strings(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, random): words of at most ``most`` documents of quality in forms of identifiers, each once."""
    chosen = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    chosen = chosen.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(most)
    text = documents.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("id"), "left_semi").select("text")  # at most ``most`` rows
    cut = F.col("text")
    for _, pattern, _, _ in BASE:
        cut = F.regexp_replace(cut, pattern, " ")
    words = text.select(F.explode(F.regexp_extract_all(cut, F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w")).where(F.char_length("w") < RUN).distinct()
    w = F.col("w")
    named = F.initcap(w)
    forms = F.array(w, F.upper(w), F.concat(w, named, named), *(F.concat(F.lit(x), w, F.lit(x)) for x in "_-/+="))
    rulers = words.limit(1).select(F.explode(F.array(*(F.repeat(F.lit(x), 1000) for x in "_-/+="))).alias("text"))
    return words.select(F.explode(forms).alias("text")).unionByName(rulers).select("text", F.lit(False).alias("random"))


def ratios(samples: DataFrame) -> list[int] | None:
    """The logarithm, in UNITs, of how much likelier each pair of CHARACTERS is in random samples than in others; None without either.

    samples: (text, random) of texts of CHARACTERS alone. The likelihoods are those of the second character
    after the first, each pair counted once more than it is seen.
    """
    size = len(CHARACTERS)
    counted = samples.select("random", F.explode(pairs_of(F.col("text"))).alias("pair")).groupBy("random", "pair").count()
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for random, pair, n in counted.collect():  # at most two for each pair of characters
        counts[random][pair] = n
    if not counts[True] or not counts[False]:
        return None
    out = []
    for a in range(size):
        seen = {k: sum(counts[k].get(a * size + b, 0) for b in range(size)) + size for k in counts}
        for b in range(size):
            likely = {k: (counts[k].get(a * size + b, 0) + 1) / seen[k] for k in counts}
            out.append(round(UNIT * math.log(likely[True] / likely[False])))
    return out


def score(run: Column, table: list[int]) -> Column:
    """The log-likelihood ratio of a run of CHARACTERS, in UNITs."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return F.aggregate(F.transform(pairs_of(run), lambda p: F.element_at(values, p + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


def secrets(documents: DataFrame, table: list[int] | None, run: int = RUN, least: int = LEAST) -> DataFrame:
    """documents' doc_id with text, base and spans: arrays of (start, order of the kind, end, kind) by start, spans having the models' too."""
    fail_unless(("doc_id", "text"), documents, "documents")
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for k, (kind, pattern, group, shortest) in enumerate(BASE):
        rows = rows.withColumn(kind, F.when(F.col("text").rlike(pattern), places(F.col("text"), pattern, group, shortest)))
        rows = rows.withColumn(kind, _spans(F.col(kind), k, kind))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(F.coalesce(kind, _none()) for kind, *_ in BASE))))
    if table is None:
        return rows.withColumn("spans", F.col("base"))
    runs = rf"[A-Za-z0-9+/_-]{{{run},}}={{0,2}}"
    rows = rows.withColumn("runs", F.when(F.col("text").rlike(runs), places(F.col("text"), runs, 0, run)))
    likely = F.filter("runs", lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]") & (score(s["found"], table) >= least))
    rows = rows.withColumn("runs", _spans(likely, len(BASE), RANDOM))
    new = F.filter("runs", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(new, _none()))))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")


def _spans(matches: Column, k: int, kind: str) -> Column:
    return F.transform(matches, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans; the models are trained on documents and labels."""
    table = ratios(random_strings(documents.sparkSession).unionByName(ordinary_strings(documents, labels)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = secrets(documents, table)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *(count(kind) for kind, *_ in BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
