"""Decision evidence: the tail of a judgment and the sentences in it that decide or reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.chars import java, last_n
from .sentences import decision_sentences

SHARE, LEAST, MOST = 0.25, 20, 120
KEEP_DECISIONS, KEEP_REASONS = 10, 8


def tail_size(n: Column) -> Column:
    """Reported size of the tail; it is not clamped to the number of sentences."""
    return F.when(n == 0, 0).otherwise(F.least(F.greatest(F.lit(LEAST), F.floor(n * SHARE).cast("int")), F.lit(MOST)))


def matches(s: Column, patterns: list[str]) -> Column:
    return s.rlike(java(patterns))


def text_with_fallback(items: DataFrame, english: DataFrame, bangla: DataFrame, key: str = "id") -> DataFrame:
    """The English text, else the Bangla one, else empty, with its provenance; presence decides, not length.

    For texts in tables of their own; see :func:`choose_text` for texts of one row.
    """
    e, b = english.select(key, F.col("text").alias("_e")), bangla.select(key, F.col("text").alias("_b"))
    out = items.join(e, key, "left").join(b, key, "left")
    return out.withColumn("text", F.coalesce("_e", "_b", F.lit(""))).withColumn(
        "text_source", F.when(F.col("_e").isNotNull(), "en_clean").when(F.col("_b").isNotNull(), "bn_clean").otherwise("missing")
    ).drop("_e", "_b")


def choose_text(english: Column, bangla: Column) -> tuple[Column, Column]:
    """(text, provenance) where both texts are columns of one row, null where a file is missing: no join."""
    source = F.when(english.isNotNull(), "en_clean").when(bangla.isNotNull(), "bn_clean").otherwise("missing")
    return F.coalesce(english, bangla, F.lit("")), source


def final_decisions(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tail_sentences_examined``, ``final_reasoning_evidence``, ``final_decision_evidence``, ``decision_found``."""
    df = df.withColumn("_s", decision_sentences(F.col(text)))
    df = df.withColumn("tail_sentences_examined", tail_size(F.size("_s")).cast("int"))
    df = df.withColumn("_tail", last_n(F.col("_s"), F.greatest("tail_sentences_examined", F.lit(1))))
    df = df.withColumn("final_reasoning_evidence", last_n(F.filter("_tail", lambda s: matches(s, lex.REASONING)), KEEP_REASONS))
    df = df.withColumn("final_decision_evidence", last_n(F.filter("_tail", lambda s: matches(s, lex.DECISION)), KEEP_DECISIONS))
    return df.withColumn("decision_found", F.size("final_decision_evidence") > 0).drop("_s", "_tail")


def decision_coverage(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("decision_found").alias("n_found"))
