"""Scores of summaries: ROUGE, BLEU, factual precision and recall, greedy embedding match, averages."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import lexicon as lex
from ..functions.chars import WS, let, strip, word_count, words

LEAST_TOKEN = 3
#: Pairs whose tokens are Python objects at a time.
PAIRS = 256


def scoring_pairs(references: DataFrame, hypotheses: DataFrame, key: str = "id") -> DataFrame:
    """(key, case_type, ref, hyp, model): pairs with both sides non-blank; driven by references."""
    r = references.select(key, "case_type", F.col("reference_summary_bn").alias("ref")).where(strip(F.coalesce("ref", F.lit(""))) != "")
    h = hypotheses.select(key, "model", F.col("summary_bn").alias("hyp")).where(strip(F.coalesce("hyp", F.lit(""))) != "")
    return r.join(h, key)


def skipped(references: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    return references.select(key).join(pairs.select(key), key, "left_anti")


def _f(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(0.0)


def overlaps(pairs: DataFrame, orders: tuple[int, ...], key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, o1, h1, r1, ...): clipped overlap of ``h`` and ``r`` tokens' n-grams and both totals, for each order.

    Pairs are counted where they are, in Arrow batches, a few at a time: no gram becomes a row, nothing is shuffled. Every
    pair has a row; ``keep`` are numbers that go along.
    """
    def count(h: list[str], r: list[str]) -> Iterator[int]:
        for n in orders:
            a, b = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (h, r))
            yield from (sum(min(k, b[g]) for g, k in a.items() if g in b), max(len(h) - n + 1, 0), max(len(r) - n + 1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                some = batch.slice(at, PAIRS)
                h, r = (some.column(some.schema.get_field_index(c)).to_pylist() for c in ("h", "r"))
                counts = zip(*(count(x or [], y or []) for x, y in zip(h, r, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([*some.columns[:-2], *(pa.array(c, pa.int64()) for c in counts)], names=names)

    t = pairs.select(key, *keep, "h", "r")
    names = [key, *keep, *(f"{c}{n}" for n in orders for c in "ohr")]
    kinds = [t.schema[c].dataType.simpleString() for c in (key, *keep)] + ["long"] * (3 * len(orders))
    return t.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds, strict=True)))


def rouge(pairs: DataFrame, orders: tuple[int, ...] = (1, 2), key: str = "id") -> DataFrame:
    """(key, rougeN_p, rougeN_r, rougeN_f, ...) for every order at once."""
    return rouge_of_tokens(pairs.select(key, words(F.col("hyp")).alias("h"), words(F.col("ref")).alias("r")), orders, key)


def rouge_of_tokens(pairs: DataFrame, orders: tuple[int, ...], key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    c = overlaps(pairs, orders, key, keep)
    out = []
    for n in orders:
        p = F.when(F.col(f"h{n}") > 0, F.col(f"o{n}") / F.greatest(f"h{n}", F.lit(1))).otherwise(0.0)
        r = F.when(F.col(f"r{n}") > 0, F.col(f"o{n}") / F.greatest(f"r{n}", F.lit(1))).otherwise(0.0)
        out += [p.alias(f"rouge{n}_p"), r.alias(f"rouge{n}_r"), _f(p, r).alias(f"rouge{n}_f")]
    return c.select(key, *keep, *out)


def rouge_n(pairs: DataFrame, n: int, key: str = "id") -> DataFrame:
    """(key, rougeN_p, rougeN_r, rougeN_f): clipped overlap of n-grams."""
    return rouge(pairs, (n,), key)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer side."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & where.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


_SPLIT = re.compile(f"{WS}+")


def tokens_of(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text or "") if w]


def lcs_f(hyp: str, ref: str) -> float:
    """F of the longest common subsequence of words."""
    h, r = tokens_of(hyp), tokens_of(ref)
    n = lcs_length(h, r) if h and r else 0
    return 2 * (n / len(h)) * (n / len(r)) / (n / len(h) + n / len(r)) if n else 0.0


@F.pandas_udf(DoubleType())
def rouge_l(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A column for pairs that are stored; computed ones go through :func:`rouge_l_scores`."""
    for hyp, ref in parts:
        yield pd.Series([lcs_f(h, r) for h, r in zip(hyp, ref, strict=True)], dtype=float)


def rouge_l_scores(pairs: DataFrame, key: str = "id") -> DataFrame:
    """(key, rougeL_f): bit-parallel in Arrow batches; no built-in has a longest common subsequence."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "rougeL_f": pd.Series([lcs_f(h, r) for h, r in zip(p["hyp"], p["ref"], strict=True)], dtype=float)})

    t = pairs.select(key, "hyp", "ref")
    return t.mapInPandas(run, f"{key} {t.schema[key].dataType.simpleString()}, rougeL_f double")


def bleu_tokens(text: str) -> list[str]:
    """The public 13a tokenisation: entities, then punctuation apart, periods and commas kept inside numbers."""
    s = (text or "").replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in s:
        for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            s = s.replace(a, b)
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {s} ")
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def sentence_bleu(hyp: str, ref: str, order: int = 4) -> float:
    """0 to 100: effective order, exponential smoothing, brevity penalty; no match of any order: 0."""
    h, r = bleu_tokens(hyp), bleu_tokens(ref)
    if not h or not r:
        return 0.0
    logs, smooth, any_hit, used = 0.0, 1.0, False, 0
    for n in range(1, order + 1):
        hc = Counter(zip(*(h[i:] for i in range(n)), strict=False))
        rc = Counter(zip(*(r[i:] for i in range(n)), strict=False))
        total = sum(hc.values())
        if not total:
            break
        hit = sum((hc & rc).values())
        any_hit |= hit > 0
        if hit:
            logs += math.log(100.0 * hit / total)
        else:
            smooth *= 2
            logs += math.log(100.0 / (smooth * total))
        used = n
    if not any_hit:
        return 0.0
    brevity = 1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))
    return brevity * math.exp(logs / used)


@F.pandas_udf(DoubleType())
def bleu(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A column for pairs without a key; tables of pairs have :func:`bleu_scores`, without Python."""
    for hyp, ref in parts:
        yield pd.Series([sentence_bleu(h, r) for h, r in zip(hyp, ref, strict=True)], dtype=float)


def tokens_13a(text: Column) -> Column:
    """The tokens of :func:`bleu_tokens` as a column."""
    c = F.coalesce(text, F.lit(""))
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, to in (
        (r"([\{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return words(c)


def bleu_scores(pairs: DataFrame, key: str = "id", order: int = 4) -> DataFrame:
    """(key, bleu), 0 to 100: effective order, exponential smoothing, brevity penalty; no match of any order: 0."""
    t = pairs.select(key, tokens_13a(F.col("hyp")).alias("h"), tokens_13a(F.col("ref")).alias("r"))
    c = overlaps(t, tuple(range(1, order + 1)), key)
    hit, used, misses, logs = F.lit(0), F.lit(0), F.lit(0), F.lit(0.0)
    for n in range(1, order + 1):
        o, h = F.col(f"o{n}"), F.col(f"h{n}")
        there = h > 0
        hit, used = hit + o, used + F.when(there, 1).otherwise(0)
        misses = misses + F.when(there & (o == 0), 1).otherwise(0)
        precision = F.when(o > 0, 100.0 * o / F.greatest(h, F.lit(1))).otherwise(100.0 / (F.pow(F.lit(2.0), misses) * F.greatest(h, F.lit(1))))
        logs = logs + F.when(there, F.log(precision)).otherwise(0.0)
    brevity = F.when(F.col("h1") >= F.col("r1"), 1.0).otherwise(F.exp(1 - F.col("r1") / F.greatest("h1", F.lit(1))))
    score = F.when((hit > 0) & (F.col("r1") > 0), brevity * F.exp(logs / F.greatest(used, F.lit(1)))).otherwise(0.0)
    return c.select(key, score.alias("bleu"))


def content_tokens(text: Column) -> Column:
    """Distinct numbers and words of three characters and more, edge punctuation stripped."""
    t = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.btrim(w, F.lit(lex.EDGE_PUNCTUATION)))
    return F.array_distinct(F.filter(t, lambda w: (F.length(w) >= LEAST_TOKEN) | w.rlike(f"^(?:{lex.NUMERIC})\\z")))


def factual(summary: Column, source: Column, reference: Column) -> tuple[Column, Column]:
    """Of content tokens: share of the summary's in the source, share of the reference's in the summary."""
    s, src, ref = summary, source, reference
    none = F.size(s) == 0
    p = F.when(none, 0.0).otherwise(F.size(F.array_intersect(s, src)) / F.greatest(F.size(s), F.lit(1)))
    r = F.when(none | (F.size(ref) == 0), 0.0).otherwise(F.size(F.array_intersect(s, ref)) / F.greatest(F.size(ref), F.lit(1)))
    return p, r


def factual_scores(pairs: DataFrame, key: str = "id") -> DataFrame:
    """``pairs(key, hyp, ref, source)`` → factual precision, recall, F1; rows without a source are skipped."""
    t = pairs.where(F.col("source").isNotNull()).select(key, *[content_tokens(F.col(c)).alias(c) for c in ("hyp", "source", "ref")])
    p, r = factual(F.col("hyp"), F.col("source"), F.col("ref"))
    t = t.select(key, p.alias("factual_precision"), r.alias("factual_recall"))
    return t.withColumn("factual_f1", _f(F.col("factual_precision"), F.col("factual_recall")))


def greedy_match(tokens: DataFrame, pair: str = "pair_id") -> DataFrame:
    """``tokens(pair_id, side 'hyp'|'ref', tok, vec)`` → precision, recall, F1 of best cosine matches per pair.

    The join is within a pair, whose sides are sentences.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    t = tokens.withColumn("u", let(norm(F.col("vec")), lambda n: F.transform("vec", lambda x: x.cast("double") / n)))
    h = t.where("side = 'hyp'").select(pair, F.col("tok").alias("h"), F.col("u").alias("hu"))
    r = t.where("side = 'ref'").select(pair, F.col("tok").alias("r"), F.col("u").alias("ru"))
    j = h.join(r, pair).select(pair, "h", "r", F.aggregate(F.zip_with("hu", "ru", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("c"))
    p = j.groupBy(pair, "h").agg(F.max("c").alias("c")).groupBy(pair).agg(F.avg("c").alias("p"))
    q = j.groupBy(pair, "r").agg(F.max("c").alias("c")).groupBy(pair).agg(F.avg("c").alias("r"))
    return p.join(q, pair).select(pair, "p", "r", _f(F.col("p"), F.col("r")).alias("f1"))


def evaluate(pairs: DataFrame, key: str = "id") -> DataFrame:
    """All lexical scores of ``pairs(key, case_type, model, hyp, ref)`` in one row per pair."""
    base = pairs.select(key, "case_type", "model", word_count(F.col("hyp")).alias("hyp_len_words"), word_count(F.col("ref")).alias("ref_len_words"), rouge_l("hyp", "ref").alias("rougeL_f"))
    return base.join(rouge(pairs, (1, 2), key).drop("rouge2_p", "rouge2_r"), key).join(bleu_scores(pairs, key), key)


def averages(scores: DataFrame, columns: list[str]) -> DataFrame:
    return scores.agg(*[F.round(F.avg(c), 4).alias(c) for c in columns])
