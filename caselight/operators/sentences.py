"""Text normalisation and the two sentence splitters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.chars import BLANK, strip, unix_lines

DECISION_LEAST, EVIDENCE_LEAST = 25, 35


def normalize(c: Column) -> Column:
    """Paragraph breaks kept, single newlines and blanks folded, no white space before punctuation."""
    t = unix_lines(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, f"\n{BLANK}*\n+", "<PARA>")
    t = F.regexp_replace(F.regexp_replace(t, "\n+", " "), "[ \t]+", " ")
    t = F.regexp_replace(t, "<PARA>", "\n\n")
    return strip(F.regexp_replace(t, f"{BLANK}+([,.;:!?])", "$1"))


def decision_sentences(c: Column, least: int = DECISION_LEAST) -> Column:
    """Split after ``. ! ? ।`` or at newlines."""
    parts = F.split(normalize(c), f"(?<=[.!?।]){BLANK}+|\n+", -1)
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) >= least)


def evidence_sentences(c: Column, least: int = EVIDENCE_LEAST) -> Column:
    """Split after ``. ! ?`` or at paragraph breaks; legal abbreviations do not end a sentence."""
    t = normalize(c)
    for a in lex.ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a[:-1] + "<prd>"))
    parts = F.split(t, f"(?<=[.!?]){BLANK}+|\n\n+", -1)
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit("<prd>"), F.lit(".")))), lambda s: F.length(s) >= least)
