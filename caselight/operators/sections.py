"""Sectioning: first heading of each class, slices between headings, position fallback, confidence, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.chars import java, lines, strip


def heading(patterns: list[str]) -> str:
    """Headings match from a line's start, also those without an anchor of their own."""
    return java("^(?:" + "|".join(patterns) + ")")


def first_heading(stripped: Column, patterns: list[str]) -> Column:
    """Index of the first line that opens the class; null if none does."""
    at = F.array_position(F.transform(stripped, lambda x: (x != "") & x.rlike(heading(patterns))), True)
    return F.when(at > 0, (at - 1).cast("int"))


def split_sections(df: DataFrame, text: str = "text", sections: dict[str, list[str]] = lex.SECTIONS) -> DataFrame:
    """Adds a column per section, ``sections_found`` (in order of discovery), ``facts_inferred`` and ``confidence``."""
    df = df.withColumn("_ls", lines(F.col(text))).withColumn("_ss", F.transform("_ls", strip))
    df = df.withColumns({f"_at_{k}": first_heading(F.col("_ss"), p) for k, p in sections.items()})
    starts = F.array(*[F.struct(F.col(f"_at_{k}").alias("at"), F.lit(i).alias("rank"), F.lit(k).alias("name")) for i, k in enumerate(sections)])
    df = df.withColumn("_found", F.array_sort(F.filter(starts, lambda s: s["at"].isNotNull())))

    def piece(i: int, k: str) -> Column:
        at = F.col(f"_at_{k}")
        later = F.filter("_found", lambda s: (s["at"] > at) | ((s["at"] == at) & (s["rank"] > i)))
        end = F.coalesce(F.get(later, F.lit(0))["at"], F.size("_ls"))
        return F.when(at.isNull(), "").otherwise(strip(F.array_join(F.slice("_ls", at + 1, F.greatest(end - at, F.lit(0))), "\n")))

    first = F.get("_found", F.lit(0))["at"]
    before = F.when(F.col("_at_facts").isNull() & first.isNotNull(), strip(F.array_join(F.slice("_ls", F.lit(1), F.coalesce(first, F.lit(0))), "\n"))).otherwise("")
    df = df.withColumns({k: piece(i, k) for i, k in enumerate(sections)}).withColumn("_before", before)
    n = F.size("_found")
    return df.withColumns({
        "facts": F.when(F.col("_at_facts").isNull(), F.col("_before")).otherwise(F.col("facts")),
        "facts_inferred": F.col("_before") != "",
        "sections_found": F.transform("_found", lambda s: s["name"]),
        "confidence": F.when(n == len(sections), "high").when(n > 0, "partial").otherwise("low"),
    }).drop("_ls", "_ss", "_found", "_before", *[f"_at_{k}" for k in sections])


def section_report(df: DataFrame) -> DataFrame:
    """Documents, inferred facts and missing sections by confidence."""
    miss = {f"no_{k}": F.count_if(~F.array_contains("sections_found", k)).alias(f"no_{k}") for k in lex.SECTIONS}
    return df.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("facts_inferred").alias("n_inferred"), *miss.values())


def missing_samples(df: DataFrame, key: str = "doc_id", n: int = 3) -> DataFrame:
    """Per section the number of documents without it and the first ``n`` of their keys (a top-n report)."""
    each = df.select(key, F.explode(F.array_except(F.array(*[F.lit(k) for k in lex.SECTIONS]), "sections_found")).alias("section"))
    top = F.slice(F.array_sort(F.collect_list(key)), 1, n)
    counts = each.groupBy("section").agg(F.count(F.lit(1)).alias("n_missing"))
    first = each.withColumn("r", F.row_number().over(W.partitionBy("section").orderBy(key))).where(F.col("r") <= n)  # a rank limit: Spark prunes within each task first
    return counts.join(first.groupBy("section").agg(top.alias("first_ids")), "section")
