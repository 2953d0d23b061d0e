"""Classification: case type, word count, document type, lookups with defaults, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import WS, strip, word_count

SHORT_BELOW = 300


def case_type(name: Column) -> Column:
    """The words before a case number; the whole name without one; ``Unknown`` for an empty name."""
    s = strip(F.coalesce(name, F.lit("")))
    rx = f"^([A-Za-z.(){WS[1:-1]}]+?){WS}*\\p{{Nd}}"
    return F.when(s == "", "Unknown").when(s.rlike(rx), strip(F.regexp_extract(s, rx, 1))).otherwise(s)


def doc_type(n_words: Column, short_below: int = SHORT_BELOW) -> Column:
    return F.when(n_words < short_below, "short_order").otherwise("full_judgment")


def classify(docs: DataFrame, metadata: DataFrame, structured: DataFrame, key: str = "id") -> DataFrame:
    """``docs(key, text)`` with case type, word count, type and whether facts were found.

    ``metadata(key, case_name)`` and ``structured(key, sections_found)`` may lack rows: ``Unknown`` and no sections.
    """
    m = metadata.select(key, case_type(F.col("case_name")).alias("case_type"))
    s = structured.select(key, "sections_found")
    n = word_count(F.col("text"))
    out = docs.select(key, n.alias("word_count")).join(m, key, "left").join(s, key, "left")
    return out.select(
        key, F.coalesce("case_type", F.lit("Unknown")).alias("case_type"), "word_count", doc_type(F.col("word_count")).alias("doc_type"),
        F.coalesce(F.array_contains("sections_found", "facts"), F.lit(False)).alias("facts_found"),
    )


def type_summary(classified: DataFrame, by: str = "case_type") -> DataFrame:
    return classified.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("word_count").alias("avg_words"),
        F.count_if(F.col("doc_type") == "full_judgment").alias("n_full"), F.count_if("facts_found").alias("n_facts"),
    )


def type_totals(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count_if(F.col("doc_type") == "full_judgment").alias("n_full"), F.count_if(F.col("doc_type") == "short_order").alias("n_short"))
