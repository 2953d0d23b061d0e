"""Line dedup by winnowing over line hashes; DataFrame functions only.

Non-blank lines (trimmed) are hashed; every run of ``k`` hashes is a gram; of each ``w`` consecutive grams the smallest
(the first of equals) is selected as a fingerprint. So any run of ``k + w - 1`` lines contains a selected gram, at the
same place in every copy, and only selected grams are shuffled, each with the hashes of the lines around it that windows
selecting it reach.

Positions are joined by fingerprint; those that occur once go. A match is extended to the left and to the right, line by
line, as far as those windows reach: occurrences that agree on all the lines of a window form one class, whose first
place (by document id, then line) stays. Every later one is a repeat, and repeats that overlap or touch join into maximal
runs, which are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import let
from .common import discard, materialize, spread_join

GRAM = 2
WINDOW = 2
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(doc_id, th, fp, at, lo, hi, around): one row per selected gram.

    ``at`` numbers its first line among the non-blank ones, ``lo`` to ``hi`` are the starts of the windows that select it,
    and ``around`` has the hashes of their lines, from line ``lo`` to the last line of window ``hi``.
    """
    run = k + w - 1
    t = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
        F.transform(F.filter(F.transform(_lines("text"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("h"),
    ).where(F.size("h") >= run)

    def selected(g: Column) -> Column:
        def one(s: Column) -> Column:
            return let(F.slice(g, s, w), lambda win: s + F.array_position(win, F.array_min(win)).cast("int") - 1)

        return F.transform(F.sequence(F.lit(1), F.size(g) - (w - 1)), one)

    def places(sel: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(sel)), lambda s: (s == 1) | (F.get(sel, s - 1) != F.get(sel, s - 2)))
        return let(first, lambda f: F.transform(f, lambda s, i: F.struct(F.get(sel, s - 1).alias("at"), s.alias("lo"), (F.coalesce(F.get(f, i + 1), F.size(sel) + 1) - 1).alias("hi"))))

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k)))

    rows = let(F.col("h"), lambda h: let(grams(h), lambda g: let(selected(g), lambda sel: F.transform(places(sel), lambda x: F.struct(
        F.get(g, x["at"] - 1).alias("fp"), x["at"].alias("at"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.slice(h, x["lo"], x["hi"] - x["lo"] + run).alias("around"))))))
    return t.select("doc_id", "th", F.inline(rows))


def repeated_runs(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(doc_id, th, runs): the runs (from, to) of non-blank lines to delete; documents that lose none have no row."""
    spark, run = docs.sparkSession, k + w - 1
    found = materialize(fingerprints(docs, k, w), "line-fp")
    classes = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = materialize(classes, "line-classes")
    shared = spread_join(found, classes, ["fp"])
    # each window that selects the gram: the lines it adds to its left, and those to its right
    left = lambda s: F.slice("around", s - F.col("lo") + 1, F.col("at") - s)
    right = lambda s: F.slice("around", F.col("at") + k - F.col("lo") + 1, s + run - F.col("at") - k)
    each = F.transform(F.sequence("lo", "hi"), lambda s: F.struct(s.alias("s"), F.xxhash64(F.col("at") - s, left(s), right(s)).alias("sides")))
    windows = materialize(shared.select("doc_id", "th", "fp", F.inline(each)), "line-extended")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "s")
    firsts = windows.groupBy("fp", "sides").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts, "line-firsts")
    late = spread_join(windows, firsts, ["fp", "sides"]).where(place != F.col("first"))

    def joined(starts: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: (i == 0) | (F.get(starts, i) > F.get(starts, i - 1) + run))
        return let(heads, lambda b: F.transform(b, lambda i, j: F.struct(F.get(starts, i).alias("a"), (F.get(starts, F.coalesce(F.get(b, j + 1), F.size(starts)) - 1) + (run - 1)).alias("b"))))

    starts = late.select("doc_id", "th", "s").distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("s")).alias("starts"))
    runs = materialize(starts.select("doc_id", "th", let(F.col("starts"), joined).alias("runs")), "line-runs")
    discard(spark, found, classes, windows, firsts)
    return runs


def dedup_lines(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and ``n_lines``, ``n_removed`` beside it.

    Defined results: null text stays null with 0 lines; blank lines are never part of a run and always stay; of equal
    runs the one in the smallest ``doc_id`` stays (null ids last, then the text's hash, then the place); rows that
    share both id and text are one document and fare alike; runs shorter than ``k + w - 1`` lines stay.
    Columns of ``docs`` named like the two new ones are replaced; no other name clashes, as names with ``__line_`` are ours.
    """
    runs = repeated_runs(docs, k, w).select(F.col("doc_id").alias("__line_id"), F.col("th").alias("__line_th"), F.col("runs").alias("__line_runs"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__line_id")) & (F.xxhash64(docs["text"]) == F.col("__line_th"))
    t = docs.join(runs.hint("merge"), same, "left")  # merged at every size: what is found grows with the corpus
    lines, at = _lines("text"), F.col("__line_runs")

    def kept(ls: Column) -> Column:
        """The lines but for those of the runs, which number the non-blank ones."""
        blank = lambda x: F.btrim(x, F.lit(BLANKS)) == ""
        full = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: ~blank(F.get(ls, i)))
        gone = let(full, lambda f: F.flatten(F.transform(at, lambda r: F.slice(f, r["a"], r["b"] - r["a"] + 1))))
        return let(gone, lambda g: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), g), lambda i: F.get(ls, i)), "\n"))

    text = F.when(at.isNull(), docs["text"]).otherwise(let(_lines("text"), kept))
    removed = F.aggregate(at, F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1)
    out = [text.alias("text") if c == "text" else docs[c] for c in names]
    return t.select(*out, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(removed, F.lit(0)).alias("n_removed"))
