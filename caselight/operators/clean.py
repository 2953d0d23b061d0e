"""Cleaning: line-wrap repair, junk and repeated lines, white space, Bangla punctuation, reports.

Every step is a column expression on one text, so a whole clean-up is a single projection: no shuffle, and the scan
below it still prunes columns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import lexicon as lex
from ..functions.chars import BLANK, WORD, java, let, lines, rstrip, strip

MIN_REPEATS = 4


@F.pandas_udf(StringType())
def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition; Spark has no function for it."""
    for s in parts:
        yield s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def join_wraps(c: Column) -> Column:
    """``respon-⏎dent`` becomes ``respondent``: a hyphen between word characters at a line's end."""
    return F.regexp_replace(c, f"({WORD})-\n({WORD})", "$1$2")


def is_junk(line: Column, patterns: list[str] = lex.JUNK_EN) -> Column:
    """Page numbers, web footers and court headers; blank lines are not junk."""
    return let(strip(line), lambda s: (s != "") & s.rlike(java(patterns)))


def drop_junk(ls: Column, patterns: list[str] = lex.JUNK_EN) -> Column:
    return F.filter(ls, lambda x: ~is_junk(x, patterns))


def repeated(ls: Column, least: int = MIN_REPEATS) -> Column:
    """The distinct stripped lines that occur at least ``least`` times, sorted.

    In a sorted array a value occurs so often where it equals the one ``least - 1`` places on: n log n, not n².
    """
    s = F.array_sort(F.filter(F.transform(ls, strip), lambda x: x != ""))
    return let(s, lambda v: F.array_distinct(F.filter(v, lambda x, i: x == F.get(v, i + (least - 1)))))


def drop_lines(ls: Column, many: Column) -> Column:
    """Without the lines that, stripped, are among ``many``."""
    return F.when(F.size(many) == 0, ls).otherwise(F.filter(ls, lambda x: ~F.array_contains(many, strip(x))))


def drop_repeated(ls: Column, least: int = MIN_REPEATS) -> Column:
    """All occurrences of repeated lines go; blank lines stay."""
    return let(ls, lambda v: let(repeated(v, least), lambda many: drop_lines(v, many)))


def collapse_whitespace(c: Column) -> Column:
    """Right-strip lines, at most one blank line in a row, strip the whole."""
    text = F.array_join(F.transform(lines(c), rstrip), "\n")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def bangla_stops(c: Column) -> Column:
    """A full stop before white space and a Bangla character becomes a danda."""
    return F.regexp_replace(c, f"\\.({BLANK}+)(?=[\u0980-\u09ff])", "।$1")


def stray_english_lines(c: Column) -> Column:
    """Lines over 70 % of whose Latin and Bangla letters are Latin."""
    def mostly(x: Column) -> Column:
        both = F.length(F.regexp_replace(x, "[^A-Za-z\u0980-\u09ff]", ""))
        latin = F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
        return let(both, lambda n: (n > 0) & (latin / F.greatest(n, F.lit(1)) > 0.7))

    return F.size(F.filter(lines(c), mostly))


def kept_lines(c: Column, patterns: list[str]) -> Column:
    return drop_junk(lines(join_wraps(c)), patterns)


def clean_en(c: Column) -> Column:
    return collapse_whitespace(F.array_join(drop_repeated(kept_lines(c, lex.JUNK_EN)), "\n"))


def clean_bn(composed: Column) -> Column:
    """Clean-up of a text that :func:`nfc` has composed in an earlier projection (Python has no place inside lambdas)."""
    return bangla_stops(collapse_whitespace(F.array_join(drop_repeated(kept_lines(composed, lex.JUNK_BN)), "\n")))


def reduction(before: Column, after: Column) -> Column:
    """Percentage of characters removed; 0 for an empty text."""
    n = F.length(before)
    return F.when(n > 0, 100.0 * (1.0 - F.length(after) / n)).otherwise(0.0)
