"""Column expressions over Markdown text: lines, headings, links, paths, areas, matching."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The knowledge areas, in their order.
AREAS = ("notes", "ideas", "projects", "sdd")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lines(text: Column) -> Column:
    """Lines end at a line feed, with or without a carriage return before it; no empty line at the end."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def trimmed(c: Column) -> Column:
    """Without blanks around it; a run of blanks inside is looked at once, from its first."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")


HEADING = r"^(#{1,6}) (.*)$"


def heading_text(rest: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(rest), "#+$", ""))


def title(text: Column, path: Column) -> Column:
    """The first heading, else the file's stem, else untitled."""
    heads = F.filter(F.transform(lines(text), trimmed), lambda line: line.rlike(r"(?s)^#{1,6} "))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    first = heading_text(F.regexp_extract(F.get(heads, F.lit(0)), r"(?s)^#{1,6} (.*)$", 1))
    return F.coalesce(first, F.when(stem != "", stem), F.lit("untitled"))


def category(path: Column) -> Column:
    """The first component of a path; for a root page its own name."""
    return F.split(path, "/")[0]


def area(path: Column) -> Column:
    """The knowledge area of a page, null outside all areas."""
    return F.when(path.contains("/"), F.when(category(path).isin(*AREAS), category(path)))


def area_rank(path: Column) -> Column:
    return F.coalesce(*(F.when(area(path) == name, F.lit(k)) for k, name in enumerate(AREAS)), F.lit(len(AREAS)))


def link_target(raw: Column) -> Column:
    """A link's target as stored: slashes, no leading ./, no trailing .md."""
    return F.regexp_replace(F.regexp_replace(F.translate(trimmed(raw), "\\", "/"), r"^(\./)+", ""), r"(\.md)+$", "")


def graph_path(c: Column) -> Column:
    """A page's name in graph commands: as a link target, cut at the first hash sign."""
    return trimmed(F.regexp_replace(link_target(F.split(c, "#")[0]), r"(\.md)+$", ""))


def retrieval_path(c: Column) -> Column:
    """A page's name in retrieval: anchors stay, one .md of either case goes."""
    return F.regexp_replace(F.regexp_replace(F.translate(trimmed(c), "\\", "/"), r"^(\./)+", ""), r"(?i)\.md$", "")


FENCE = r"(?mdU)^[\s&&[^\n]]*(```|~~~).*$"


def without_code(text: Column) -> Column:
    """Text with fenced blocks and inline code blanked, line by line as it was.

    Fence lines cut the text into pieces, every second one of which is code; either mark closes the other.
    Backticks cut a line in the same way, so an odd one blanks the rest of its line.
    """
    def plain(line: Column) -> Column:
        parts = F.transform(F.split(line, "`", -1), lambda p, k: F.when(k % 2 == 1, F.repeat(F.lit(" "), F.char_length(p))).otherwise(p))
        return F.when(line.contains("`"), F.array_join(parts, " ")).otherwise(line)

    pieces = F.split(F.regexp_replace(text, "\r\n", "\n"), FENCE, -1)
    clean = F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.regexp_replace(p, r"[^\n]+", "")).otherwise(F.array_join(F.transform(F.split(p, "\n", -1), plain), "\n")))
    return F.array_join(clean, "")


def links_between(pieces: Column) -> Column:
    """The links of a text cut at each closing bracket: array of (target, label), label null without a bar.

    A link ends where a piece is followed by an empty one that is not the last. It begins at the piece's first two opening
    brackets that have a target behind them, and its target ends at the first bar: one step a piece, whatever
    else is open.
    """
    following = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))

    def link(piece: Column, after: Column) -> Column:
        rest = F.substring(piece, F.regexp_instr(piece, F.lit(r"\[\[[^|]")) + 2, F.char_length(piece))
        bar = F.instr(rest, F.lit("|"))
        one = F.struct(F.when(bar == 0, rest).otherwise(F.substring(rest, F.lit(1), bar - 1)).alias("target"), F.when(bar > 0, F.substring(rest, bar + 1, F.char_length(rest))).alias("label"))
        return F.when((after == "") & piece.rlike(r"\[\[[^|]") & ((bar == 0) | (bar < F.char_length(rest))), one)

    return F.filter(F.zip_with(pieces, following, link), lambda m: m.isNotNull())


def truncated(c: Column, n: int) -> Column:
    """Cut after n characters, with dots behind."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def excerpt(c: Column, n: int = 360) -> Column:
    """The non-blank lines, trimmed, in one line, truncated."""
    kept = F.filter(F.transform(lines(c), trimmed), lambda line: line != "")
    return truncated(F.array_join(kept, " "), n)


# -- matching --------------------------------------------------------------------------------------


def quoted(literal: str) -> str:
    """A pattern for the literal; java.util.regex and RE2 read it alike."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&~\-\s])", lambda m: "\\" + m[1] if not m[1].isspace() else m[1], literal)


def compiled(pattern: str) -> None:
    """ValueError for a pattern that the engine cannot read, before any task fails on it."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {str(e).splitlines()[0]}") from None


class Matcher:
    """A compiled query: a literal, literals joined by AND with a phrase for ranking, or a regular expression."""

    GAP = r"[\s\p{P}\p{S}/_-]*"

    def __init__(self, query: str, regex: bool = False, case_sensitive: bool = False):
        if not query:
            raise ValueError("the query must not be empty")
        if regex and re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)\\[1-9]", query):
            raise ValueError("look-around and back-references are not supported")
        self.query, self.regex, self.flags = query, regex, "(?U)" if case_sensitive else "(?iuU)"
        if regex:
            compiled(query)
        words = query.split()
        self.tokens = None if regex or len(words) <= 1 else words
        self.phrase = None if self.tokens is None else self.flags + self.GAP.join(map(quoted, words))
        whole = query if regex else quoted(query)
        self.patterns = [self.flags + whole] if self.tokens is None else [self.flags + quoted(w) for w in words]

    def matches(self, text: Column) -> Column:
        """Every token stands somewhere in the text."""
        return reduce(lambda a, b: a & b, [text.rlike(p) for p in self.patterns])

    def line_matches(self, line: Column) -> Column:
        """Any token stands in the line."""
        return reduce(lambda a, b: a | b, [line.rlike(p) for p in self.patterns])

    def phrase_hits(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.phrase)) if self.phrase else F.lit(0)

    def token_hits(self, text: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in self.patterns])


def like_pattern(query: str) -> str:
    """The pattern of LIKE '%query%': percent and underscore are wildcards, letters match in either ASCII case."""
    body = "".join(".*" if c == "%" else "." if c == "_" else quoted(c) for c in query)
    return f"(?is){body}"
