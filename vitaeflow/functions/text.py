"""Text columns: white space, noise lines, keywords, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a keyword query ignores.
STOP_WORDS = ("year", "years", "the", "a", "an", "in", "at", "of", "and", "or", "with", "to", "for", "is", "are")
#: Fixed value: a line that is nothing but an encoded string or a rule.
NOISE_LINE = r"^[A-Za-z0-9+/=_~\-]{20,}$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Text without white space (of any script) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def filled(text: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(text, F.lit(""))


def clean_noise_lines(text: Column) -> Column:
    """Text without the lines that are noise as a whole."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~strip(line).rlike(NOISE_LINE)), "\n")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def pdf_cleanup(text: Column) -> Column:
    """No blanks at line ends, no more than one blank line, none at the ends."""
    return strip(collapse_blank_lines(F.regexp_replace(text, r"(?m)[ \t]+$", "")))


def docx_cleanup(text: Column) -> Column:
    """Joins bold runs that meet, then as :func:`pdf_cleanup` but for line ends."""
    return strip(collapse_blank_lines(F.replace(text, F.lit("****"), F.lit(""))))


def line_number(text: Column, offset: Column) -> Column:
    """Line (from 1) of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def like_pattern(part: str | Column) -> Column:
    """Pattern for a case-insensitive search anywhere; % and _ stay wildcards, backslashes don't escape."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.concat(F.lit("%"), F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def contains_like(text: Column, part: str | Column) -> Column:
    return F.call_function("ilike", text, like_pattern(part))


def keywords(query: Column) -> Column:
    """Words of a query that are neither numbers nor stop words."""
    parts = F.split(F.translate(query, ",/", "  "), r"(?U)\s+")
    return F.filter(parts, lambda w: (w != "") & ~w.rlike(r"(?U)^\d+$") & ~F.lower(w).isin(*STOP_WORDS))


def keyword_list(query: str) -> list[str]:
    """:func:`keywords` for one query, without a session."""
    ignored = {"", *STOP_WORDS}
    return [w for w in re.split(r"[,/\s]+", query) if w.lower() not in ignored and not w.isdecimal()]


def cell(value: Column, width: int = 0) -> Column:
    """A table cell: - for nothing, long texts end in two dots."""
    shown = F.coalesce(filled(value.cast("string")), F.lit("-"))
    return F.when(F.length(shown) > width, F.concat(F.substring(shown, 1, width - 2), F.lit(".."))).otherwise(shown) if width else shown
