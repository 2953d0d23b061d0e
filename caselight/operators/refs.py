"""Proxy references: the closing, operative part of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.chars import last_n, let, lines, strip, word_count, words

MIN_WORDS, MAX_WORDS = 40, 250


def order_tail(text: Column, least: int = MIN_WORDS, most: int = MAX_WORDS, markers: list[str] = lex.ORDER_MARKERS) -> Column:
    """Paragraphs from the end until one with an order marker (and ``least`` words) or ``most`` words; at most ``most`` words.

    A fold over the paragraphs of one row: nothing is exploded or shuffled.
    """
    paras = F.filter(lines(text), lambda p: strip(p) != "")

    def step(a: Column, p: Column) -> Column:
        total = a["total"] + p["n"]
        stop = ((total >= least) & p["m"]) | (total >= most)
        return F.when(a["stop"], a).otherwise(F.struct(total.alias("total"), (a["taken"] + 1).alias("taken"), stop.alias("stop")))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("taken"), F.lit(False).alias("stop"))

    def taken(ps: Column) -> Column:
        back = F.transform(F.reverse(ps), lambda p: F.struct(word_count(p).alias("n"), p.rlike("|".join(markers)).alias("m")))
        return F.aggregate(back, start, step)["taken"]

    def cut(proxy: Column) -> Column:
        return let(words(proxy), lambda w: F.when(F.size(w) > most, F.array_join(last_n(w, most), " ")).otherwise(proxy))

    tail = let(paras, lambda ps: let(taken(ps), lambda n: let(strip(F.array_join(last_n(ps, n), "\n")), cut)))
    return F.when(word_count(text) <= most, strip(text)).otherwise(tail)


def proxy_references(docs: DataFrame, classified: DataFrame, key: str = "id") -> DataFrame:
    """``docs(key, text)`` with case type (default ``Unknown``), proxy reference and its kind."""
    return docs.join(classified.select(key, "case_type"), key, "left").select(
        key, F.coalesce("case_type", F.lit("Unknown")).alias("case_type"), order_tail(F.col("text")).alias("reference_summary_bn"), F.lit("proxy_order_extraction").alias("reference_type")
    )


def reference_template(refs: DataFrame, key: str = "id") -> DataFrame:
    """The same rows with empty summaries, to be filled in by hand."""
    return refs.select(key, "case_type", F.lit("").alias("reference_summary_bn"))
