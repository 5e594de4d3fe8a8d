"""Full-text search over chunks: postings, phrases, BM25, LIKE and regular expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: letters with their marks, as the tokenizer folds them: Latin with diacritics to plain letters
_MARKED = [c for n in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", c := chr(n))) > 1 and d[0].isascii()]
_FOLD_FROM, _FOLD_TO = "".join(_MARKED), "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
TOKEN = r"(?U)([^\W_]+)"


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, _FOLD_FROM, _FOLD_TO))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(1))


def query_tokens(word: str) -> list[str]:
    return re.findall(r"[^\W_]+", word.translate(str.maketrans(_FOLD_FROM, _FOLD_TO)).lower())


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, col, pos), in both columns of a chunk."""
    parts = [chunks.select(F.col("id").alias("chunk_id"), F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in ("text", "heading_path")]
    return parts[0].unionByName(parts[1]).select("term", "chunk_id", "col", "pos")


def term_counts(chunks: DataFrame) -> DataFrame:
    """(term, n, df, places) of chunks: occurrences, chunks that hold the term, sum of places.

    Texts are dealt by chunk first: all rows of a chunk and term are then in one task, and only sums by term are sent.
    """
    places = F.concat(*(F.transform(tokens(F.col(c)), lambda t, at: F.struct(t.alias("term"), at.alias("pos"))) for c in ("text", "heading_path")))
    rows = chunks.select("id", "text", "heading_path").repartition("id").select("id", F.explode(places).alias("p")).select("id", "p.term", "p.pos")
    own = rows.groupBy("id", "term").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("places"))
    return own.groupBy("term").agg(F.sum("n").alias("n"), F.count("id").alias("df"), F.sum("places").alias("places"))


def phrase_hits(posts: DataFrame, words: list[str]) -> DataFrame:
    """(chunk_id, f): occurrences of adjacent words in one column. One shuffle by place, no self-join."""
    rows = posts.where(F.col("term").isin(*words))
    if len(words) == 1:
        return rows.groupBy("chunk_id").agg(F.count("*").alias("f"))
    # each posting votes for the start of a phrase it may be of
    offsets = F.array(*(F.when(F.col("term") == w, F.lit(k)) for k, w in enumerate(words)))
    votes = rows.select("chunk_id", "col", F.explode(F.transform(F.filter(offsets, lambda k: k.isNotNull()), lambda k: F.struct((F.col("pos") - k).alias("start"), k.alias("k")))).alias("v"))
    starts = votes.groupBy("chunk_id", "col", "v.start").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
    return starts.groupBy("chunk_id").agg(F.count("*").alias("f"))


def lengths(posts: DataFrame) -> DataFrame:
    """(chunk_id, len): tokens of each chunk that has some."""
    return posts.groupBy("chunk_id").agg(F.count("*").alias("len"))


def fts(posts: DataFrame, query: str, known_lengths: DataFrame | None = None) -> DataFrame | None:
    """(chunk_id, bm25): chunks that hold every white-space word of the query as a phrase; lower is better.

    None if a word has no token: nothing can match it. With the lengths of all chunks given, posts may be those of the query's terms alone.
    """
    words = [query_tokens(w) for w in query.split()]
    if not words or not all(words):
        return None
    own_lengths = lengths(posts) if known_lengths is None else known_lengths
    total = own_lengths.agg(F.count("*").alias("total"), F.avg("len").alias("mean"))
    hits = [phrase_hits(posts, w).withColumnRenamed("f", f"f{k}") for k, w in enumerate(words)]
    sizes = [h.agg(F.count("*").alias(f"n{k}")) for k, h in enumerate(hits)]
    found = reduce(lambda a, b: a.join(b, "chunk_id"), hits).join(own_lengths, "chunk_id")
    facts = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [total, *sizes])  # one row each
    found = found.join(F.broadcast(facts), F.lit(True))
    of_word = [(F.col(f"f{k}"), F.col(f"n{k}")) for k in range(len(words))]
    return found.select("chunk_id", bm25(of_word, F.col("total"), F.col("len"), F.col("mean")).alias("bm25"))


def bm25(words: list[tuple[Column, Column]], total: Column, length: Column, mean: Column) -> Column:
    """The score of a chunk of ``length`` tokens: words are (occurrences in it, chunks that hold the word); lower is better."""

    def part(f: Column, n: Column) -> Column:
        idf = F.greatest(F.ln((total - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))

    return -reduce(lambda a, b: a + b, [part(f, n) for f, n in words])


def like(chunks: DataFrame, query: str) -> DataFrame:
    return chunks.where(F.col("text").rlike(T.like_pattern(query)))


def regex(chunks: DataFrame, pattern: str) -> DataFrame:
    return chunks.where(T.Matcher(pattern, regex=True).matches(F.col("text")))
