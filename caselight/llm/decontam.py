"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by ``budget`` edits. Cut into ``budget + 1`` pieces, at least one piece
must occur in the passage unchanged; one automaton finds all pieces of all items in a text. Pieces are short, so hits
by chance are sorted out from the piece upwards: of a run of pieces with as many edits as it has pieces, less one, one
half again has fewer edits than pieces; so some piece has only ancestors, up to the item, that are within their own
budget (Navarro and Baeza-Yates, 1999). What is left is verified with Myers' bit-parallel edit distance over the
item's reach around it. No match is lost on the way.

Texts and items are compared lower-cased, with every run of anything but letters and digits as one space.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, keep_rows, materialize, raw

#: Edits allowed as a share of an item's characters.
ERROR_RATE = 0.1
#: Items with fewer words say too little for edits: they have to be there as they are, with a blank, a sign or an
#: end of the text on both sides; where scripts have no spaces, two characters are a word.
LEAST_WORDS = 5
WORD_CHARS = 2
#: Characters of items that one automaton holds; more items are searched in further passes.
BLOCK_CHARS = 8_000_000

_APART = re.compile(r"[\W_]+")
#: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: bytes | str | None) -> str:
    s = text.decode("utf-8", "replace") if isinstance(text, bytes) else text or ""
    return _APART.sub(" ", s.lower()).strip()


def edit_budget(n: int) -> int:
    return int(n * ERROR_RATE)


def words_of(item: str) -> int:
    return len(_UNSPACED.sub(" ", item).split()) + len(_UNSPACED.findall(item)) // WORD_CHARS


def budget_of(item: str) -> int:
    return edit_budget(len(item)) if words_of(item) >= LEAST_WORDS else 0


def cuts_of(item: str) -> list[int]:
    """Offsets that cut the item into budget + 1 pieces."""
    k = budget_of(item) + 1
    return [i * len(item) // k for i in range(k + 1)]


@cache
def ancestors(pieces: int, at: int) -> list[tuple[int, int]]:
    """The runs of pieces, halved again and again, that piece ``at`` lies in: from two or three pieces up to all."""
    lo, hi, found = 0, pieces, []
    while hi - lo > 1:
        found.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if at < mid else (mid, hi)
    return found[::-1]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` within ``budget`` edits; the first of equals."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # an occurrence may start anywhere
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """All items of one block; built once per Python worker."""

    _built: dict[int, Matcher] = {}

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        self.trie = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.cuts = [cuts_of(item) for _, item in items]
        self.whole = [words_of(item) < LEAST_WORDS for _, item in items]
        for i, (_, item) in enumerate(items):
            for k, (a, b) in enumerate(pairwise(self.cuts[i])):
                at[item[a:b]].append((i, k))
        for piece, places in at.items():
            self.trie.add_word(piece, (len(piece), places))
        if at:
            self.trie.make_automaton()

    @classmethod
    def of(cls, key: int, items: list[tuple[int, str]]) -> Matcher:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(items)
        return cls._built[key]

    def likely(self, i: int, k: int, p: int, s: str) -> bool:
        """Whether piece ``k`` of item ``i``, found at ``p``, has only ancestors within their budgets (the item aside)."""
        item, cuts = self.items[i][1], self.cuts[i]
        up = ancestors(len(cuts) - 1, k)
        if not up:
            return True
        base, (lo, hi) = p - cuts[k], up[0]
        e = hi - lo - 1
        a, b = (cuts[lo], cuts[k]) if k > lo else (cuts[k + 1], cuts[hi])  # the piece itself has no edits: its sibling has them
        part = [a + j * (b - a) // (e + 1) for j in range(e + 2)]
        if not any(s.find(item[x:y], max(0, base + x - e), max(0, base + y + e)) >= 0 for x, y in pairwise(part)):
            return False
        for lo, hi in up[:-1]:
            e = hi - lo - 1
            if not myers(item[cuts[lo] : cuts[hi]], s[max(0, base + cuts[lo] - e) : base + cuts[hi] + e], e):
                return False
        return True

    def find(self, text: bytes, first: bool = False) -> list[tuple[int, int, int, int, str]]:
        """(item_id, distance, start, end, passage) of the best match of each item; ``first``: one item is enough."""
        if not self.items:
            return []
        s = normal(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (n, places) in self.trie.iter(s):
            for i, k in places:
                at = end + 1 - n - self.cuts[i][k]
                if self.whole[i] and not (s[end - n : end - n + 1] in ("", " ") and s[end + 1 : end + 2] in ("", " ")):
                    continue  # a short item inside longer words
                if at not in starts[i] and self.likely(i, k, end + 1 - n, s):
                    starts[i].add(at)
        found = []
        for i, at in sorted(starts.items()):
            item_id, item = self.items[i]
            e, best, till = budget_of(item), None, None
            spans: list[list[int]] = []
            for a in sorted(at):
                lo, hi = max(0, a - e), min(len(s), a + len(item) + e)
                if till is not None and lo <= spans[-1][1] - len(item):
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
                till = hi
            for lo, hi in spans:
                got = myers(item, s[lo:hi], e)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
                    if not got[0]:
                        break
            if best:
                start = max(0, best[1] - len(item))
                found.append((item_id, best[0], start, best[1], s[start : best[1]]))
                if first:
                    break
        return found


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The test set in blocks of bounded size: what is sent to the executors at once does not grow with it."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        item = normal(r["text"])
        if not item:
            continue
        block.append((r["item_id"], item))
        held += len(item)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def _each_block(spark: SparkSession, benchmark: DataFrame, step: Callable[[Callable[[], Matcher], bool], None]) -> None:
    """``step`` for each block of items, with what gives a worker its matcher, and whether further blocks follow.

    All but the last block's broadcast go once the step is done, so that executors hold one block at a time.
    """
    blocks = item_blocks(benchmark)
    items = next(blocks, None)
    while items is not None:
        following = next(blocks, None)
        shared, key = spark.sparkContext.broadcast(items), hash(tuple(items))
        step(lambda shared=shared, key=key: Matcher.of(key, shared.value), following is not None)
        if following is not None:
            shared.destroy()
        items = following


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start, end, passage): the best match of every item in every whole text.

    Offsets count characters of the normalised text. Defined results: null and empty texts match nothing; items that
    are null or without letters and digits are not looked for, those of fewer than ``LEAST_WORDS`` words exactly;
    repeated documents give a row each, repeated rows of the test set count once. Extra columns are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, start int, end int, passage string"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("t"))
    parts: list[DataFrame] = []

    def step(matcher_of: Callable[[], Matcher], more: bool) -> None:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of()
            for batch in it:
                for part, texts in batches_of(batch):
                    ids = batch.column("doc_id").slice(part.start, part.stop - part.start).to_pylist()
                    rows = [(d, *m) for d, t in zip(ids, texts, strict=True) for m in matcher.find(t)]
                    cols = list(zip(*rows, strict=True)) or [()] * 6
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end", "passage"])

        found = source.mapInArrow(run, schema)
        parts.append(materialize(found, "decontam") if more else found)

    _each_block(spark, benchmark, step)
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, all columns as they are; one pass over the texts per block of items."""
    kept = [docs]

    def step(matcher_of: Callable[[], Matcher], more: bool) -> None:
        out = keep_rows(kept[-1], lambda texts: np.array([not matcher_of().find(t, first=True) for t in texts], bool))
        kept.append(materialize(out, "decontam") if more else out)

    _each_block(docs.sparkSession, benchmark, step)
    return kept[-1]
