"""Substring dedup by recompression: remove every word inside a window of words that also starts elsewhere.

A text is a sequence of word symbols. A level names maximal runs of one symbol, then pairs whose left symbol falls in one
half of the alphabet and whose right symbol in the other, so pairs never overlap, and the parse of a stretch depends on
that stretch and a symbol or so to each side; each symbol carries the exact reach of words that its existence depends on.
Names follow from what they stand for, so equal runs and pairs get equal names in every task, document and round.

Levels are grouped into Spark rounds. A round aggregates the names that its symbols got in all distinct texts into one
table, which tells the shared symbols from those with one place in the corpus. A symbol whose reach lies in a window is
interior to it, and equal windows have equal interior symbols: a window with an interior symbol that is not shared is
unique and goes. Only the stretches with windows left take part in the next round, which names larger symbols.

The windows that are left are verified by symbol identity and extension: the names of all their interior symbols, the
words from the window's start to the first of them and from the last to the window's end, and 32 more bits over all words.
They are counted over the corpus by partial aggregation. Exact: nothing is lost, and only hash collisions (2**-96 a
pair) could remove more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bucketed, materialize, raw, release, small_batches, spread_join

WINDOW = 35
#: Levels that each Spark round names. After four a symbol has about three words and reaches ten to either side, so that a
#: window has about six interior ones; larger symbols are interior to few windows.
LEVELS = (4, 1)
#: Reaches beyond this are all the same: no window holds them.
FAR = 1 << 10
#: Words that numpy works on at once.
WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EVEN = np.uint64((1 << 64) - 2)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for reuse while small."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, np.uint64(pow(key, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 6_000_000:
            return out[0], out[1]
        _powers[key] = (out[0], out[1])
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each span, position-free."""
    p, inv = _power(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inv[starts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the offsets of each text's words among them."""
    whole = b"\n".join(texts) + b"\n"
    b = np.frombuffer(whole, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], gap]).view(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    h = mix(spans_hash(_BYTE[b], starts, ends, _P) + (ends - starts).astype(np.uint64) * _Q)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(starts, offsets)


class Symbols:
    """The symbols of texts laid end to end: names (even), spans and reaches in words, and each word's text."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, name: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray):
        self.words, self.ends = words, ends  # ``ends``: where each text ends
        self.doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.name, self.end = name, np.cumsum(size)
        self.start = self.end - size
        self.left, self.right = self.start - before, self.end + after

    @classmethod
    def of_words(cls, words: np.ndarray, offsets: np.ndarray) -> Symbols:
        one, none = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)
        return cls(words, offsets[1:], words & _EVEN, one, none, none)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each symbol and the next are of one text, and the reaches of the symbols before and behind each."""
        d = self.doc[self.start]
        joined = d[1:] == d[:-1]
        before = np.where(np.append(False, joined), np.append(0, self.left[:-1]), self.start - FAR)
        behind = np.where(np.append(joined, False), np.append(self.right[1:], 0), self.end + FAR)
        return joined, before, behind

    def level(self, r: int) -> None:
        """Name runs, then pairs; ``r`` deals the alphabet into halves."""
        m = len(self.name)
        if not m:
            return
        joined, before, behind = self._neighbours()
        head = np.flatnonzero(np.append(True, ~(joined & (self.name[1:] == self.name[:-1]))))
        tail = np.append(head[1:], m)
        count = tail - head
        name = self.name[head]
        self.name = np.where(count > 1, mix(name * _Q + count.astype(np.uint64)) & _EVEN, name)
        self.start, self.end = self.start[head], self.end[tail - 1]
        self.left, self.right = before[head], behind[tail - 1]  # a run ends where its neighbours differ
        m = len(self.name)
        joined, before, behind = self._neighbours()
        bit = (mix(self.name ^ np.uint64(2 * r + 1)) >> np.uint64(63)).astype(bool)
        pair = joined & ~bit[:-1] & bit[1:]
        first, second = np.append(pair, False), np.append(False, pair)
        # a left symbol that stays single must know the next one, a right one the one before
        left = np.where(~first & bit, np.minimum(self.left, before), self.left)
        right = np.where(~second & ~bit, np.maximum(self.right, behind), self.right)
        keep = np.flatnonzero(~second)
        nxt = np.minimum(keep + 1, m - 1)
        two = first[keep]
        self.name = np.where(two, mix(self.name[keep] * _P + mix(self.name[nxt] + np.uint64(0xABCD))) & _EVEN, self.name[keep])
        self.start, self.end = self.start[keep], np.where(two, self.end[nxt], self.end[keep])
        self.left, self.right = left[keep], np.where(two, right[nxt], right[keep])

    def starts(self, width: int) -> np.ndarray:
        """For each word whether a window from there stays in its text."""
        return np.arange(len(self.words)) + width <= self.ends[self.doc] if len(self.words) else np.zeros(0, bool)

    def interior(self, alive: np.ndarray, width: int) -> np.ndarray:
        """For each symbol whether it is interior to a window that is ``alive``."""
        seen = np.append(0, np.cumsum(alive))
        lo, hi = np.clip(self.right - width, 0, len(alive)), np.clip(self.left + 1, 0, len(alive))
        return (hi > lo) & (seen[hi] > seen[lo])

    def without(self, dead: np.ndarray, alive: np.ndarray, width: int) -> np.ndarray:
        """``alive`` without the windows that have a ``dead`` symbol as an interior one."""
        mark = np.zeros(len(alive) + 1, np.int64)
        lo, hi = np.maximum(self.right[dead] - width, 0), self.left[dead] + 1
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi, -1)
        return alive & (np.cumsum(mark)[:-1] == 0)

    def keys(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """64 bits by symbol identity and extension, and 32 bits over all words, of the windows from each of ``at``."""
        till = at + width
        a = np.searchsorted(np.maximum.accumulate(self.left), at, "left")
        b = np.searchsorted(np.minimum.accumulate(self.right[::-1])[::-1], till, "right")
        some = b > a
        inner, last = np.minimum(a, len(self.name) - 1), np.maximum(b - 1, 0)
        from_, to = np.where(some, self.start[inner], till), np.where(some, self.end[last], till)
        names = np.where(some, mix(spans_hash(self.name, np.where(some, a, 0), np.where(some, b, 0), _P)), np.uint64(0))
        k = mix(spans_hash(self.words, at, from_, _P) + (from_ - at).astype(np.uint64)) + names * _Q
        k = mix(k) * _P + mix(spans_hash(self.words, to, till, _P) + (till - to).astype(np.uint64))
        c = mix(spans_hash(mix(self.words), at, till, _Q))
        return mix(k), (c >> np.uint64(32)).astype(np.uint32).view(np.int32)


_SCHEMA = "words array<long>, name array<long>, size array<int>, before array<int>, after array<int>, alive array<int>"


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def _state(x: Symbols, alive: np.ndarray, pick: np.ndarray) -> dict[str, pa.Array]:
    """Columns of the texts in ``pick``: their words, symbols and starts of live windows."""
    n = len(x.ends)
    per = np.bincount(x.doc[x.start], minlength=n) if len(x.start) else np.zeros(n, np.int64)
    begin = np.append(0, x.ends[:-1])
    mark = np.flatnonzero(alive)
    edge = np.flatnonzero(np.append(True, (np.diff(mark) > 1) | (np.diff(x.doc[mark]) > 0))) if len(mark) else np.zeros(0, int)
    lo, hi = mark[edge], mark[np.append(edge[1:], len(mark)) - 1] if len(mark) else mark
    spans = np.stack([lo, hi], 1).reshape(-1) - np.repeat(begin[x.doc[lo]], 2) if len(mark) else mark
    full = {
        "words": _lists(x.words, np.diff(x.ends, prepend=0), pa.int64()), "name": _lists(x.name, per, pa.int64()), "size": _lists(x.end - x.start, per, pa.int32()),
        "before": _lists(np.minimum(x.start - x.left, FAR), per, pa.int32()), "after": _lists(np.minimum(x.right - x.end, FAR), per, pa.int32()),
        "alive": _lists(spans, 2 * np.bincount(x.doc[lo], minlength=n) if len(mark) else np.zeros(n, int), pa.int32()),
    }
    return {k: v.take(pa.array(pick)) for k, v in full.items()}


def _parse(width: int, levels: int):
    """Texts to the state of the first round."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in batches_of(batch, limit=2_000_000):
                x = Symbols.of_words(*word_hashes(texts))
                for r in range(levels):
                    x.level(r)
                long = np.flatnonzero(np.diff(x.ends, prepend=0) >= width)
                state = _state(x, x.starts(width), long)
                keep = [batch.column(k).slice(part.start, part.stop - part.start).take(pa.array(long)) for k in ("h1", "h2", "copies")]
                at = pa.array(np.zeros(len(long), np.int32))
                yield pa.RecordBatch.from_arrays([*keep, at, *state.values()], names=["h1", "h2", "copies", "at", *state])

    return run


def _loaded(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, Symbols, np.ndarray]]:
    """(rows, symbols, live window starts) of a state joined with its ``shared`` names, some texts at a time."""
    for batch in it:
        sizes = np.diff(batch.column("words").offsets.to_numpy())
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // WORDS, prepend=0)) if len(sizes) else []
        for a, b in zip([0, *cut], [*cut, len(batch)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            col = {k: part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for k in ("words", "name", "size", "before", "after", "alive", "shared")}
            ends = np.cumsum(sizes[a:b])
            x = Symbols(col["words"].view(np.uint64), ends, col["name"].view(np.uint64), col["size"], col["before"], col["after"])
            spans = col["alive"].reshape(-1, 2)
            own = np.diff(part.column("alive").offsets.to_numpy()) // 2
            base = np.repeat(ends - sizes[a:b], own)
            mark = np.zeros(len(x.words) + 1, np.int64)
            np.add.at(mark, spans[:, 0] + base, 1)
            np.add.at(mark, spans[:, 1] + base + 1, -1)
            alive = np.cumsum(mark)[:-1] > 0
            asked = x.interior(alive, width)
            dead = asked & ~np.isin(x.name, col["shared"].view(np.uint64))
            yield part, x, x.without(dead, alive, width)


def _stretches(x: Symbols, alive: np.ndarray, width: int) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, live starts, text, place) of the stretches that live windows cover, each a text of its own now.

    Symbols that an edge cuts fall apart into words of unlimited reach, so that whatever depends on them is interior to no
    window; a window's interior symbols lie in its stretch, so they stay as they are.
    """
    mark = np.zeros(len(x.words) + 1, np.int64)
    at = np.flatnonzero(alive)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    cover = np.cumsum(mark)[:-1] > 0
    first = cover & np.append(True, ~cover[:-1] | (np.diff(x.doc) > 0))
    stretch = np.where(cover, np.cumsum(first), 0)
    whole = (stretch[x.start] == stretch[x.end - 1]) & cover[x.start]
    inside = np.zeros(len(x.words) + 1, np.int64)
    np.add.at(inside, x.start[whole], 1)
    np.add.at(inside, x.end[whole], -1)
    loose = np.flatnonzero(cover & (np.cumsum(inside)[:-1] == 0))
    order = np.argsort(np.append(x.start[whole], loose), kind="stable")
    far, one = np.full(len(loose), FAR), np.ones(len(loose), np.int64)
    both = lambda a, b: np.append(a, b)[order]
    begin = np.flatnonzero(first)
    out = Symbols(
        x.words[cover], np.cumsum(np.bincount(stretch[cover] - 1, minlength=len(begin))), both(x.name[whole], x.words[loose] & _EVEN), both((x.end - x.start)[whole], one),
        both((x.start - x.left)[whole], far), both((x.right - x.end)[whole], far),
    )
    return out, alive[cover], x.doc[begin], begin - np.append(0, x.ends[:-1])[x.doc[begin]]


def _go_on(width: int, done: int, levels: int):
    """The state of the next round: stretches of live windows, their symbols named for ``levels`` more levels."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, alive in _loaded(it, width):
            if not alive.any():
                continue
            x, alive, text, place = _stretches(x, alive, width)
            for r in range(done, done + levels):
                x.level(r)
            state = _state(x, alive, np.arange(len(x.ends)))
            keep = [rows.column(k).take(pa.array(text)) for k in ("h1", "h2", "rid")]
            at = pa.array((rows.column("at").to_numpy()[text] + place).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*keep, at, *state.values()], names=["h1", "h2", "rid", "at", *state])

    return run


def _windows(width: int):
    """(w1, rest, rid) of every live window; ``rest`` packs the other 32 bits, the start, and whether its own text repeats it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, alive in _loaded(it, width):
            at = np.flatnonzero(alive)
            if not len(at):
                continue
            rid = rows.column("rid").to_numpy()
            w1, w2 = x.keys(at, width)
            i = x.doc[at]
            s = at - (x.ends - np.diff(x.ends, prepend=0))[i]
            # windows that a stretch itself repeats are settled here; all but the first go on under keys of their own,
            # so that no key has more rows than there are stretches
            order = np.lexsort((s, w2, w1, i))
            same = (np.diff(i[order]) == 0) & (np.diff(w1[order]) == 0) & (np.diff(w2[order]) == 0)
            later, own = np.zeros(len(s), bool), np.zeros(len(s), bool)
            later[order[1:]] = same
            own[order[1:]] = same
            own[order[:-1]] |= same
            s = s + rows.column("at").to_numpy()[i]
            w1 = np.where(later, mix(w1 + rid[i].view(np.uint64) * _P + s.astype(np.uint64) * _Q), w1).view(np.int64)
            rest = (w2.astype(np.int64) << 32) | (s.astype(np.int64) << 1) | own  # one number: fewer bytes to write
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(rest), pa.array(rid[i])], names=["w1", "rest", "rid"])

    return run


def _remove(width: int, with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in batches_of(batch):
                col = lambda k: batch.column(k).slice(part.start, part.stop - part.start)  # noqa: B023, E731
                total, gone, shas, kept = [], [], [], []
                for t, every, starts in zip(texts, col("every").to_pylist(), col("starts"), strict=True):
                    words = t.split()
                    n = len(words)
                    if every and n >= width:
                        rest: list[bytes] = []
                    elif starts.is_valid and len(starts.values):
                        mark = np.zeros(n + 1, np.int32)
                        s = starts.values.to_numpy()
                        np.add.at(mark, s, 1)
                        np.add.at(mark, s + width, -1)
                        rest = [words[i] for i in np.flatnonzero(np.cumsum(mark)[:n] == 0)]
                    else:
                        rest = words
                    line = b" ".join(rest)
                    total.append(n)
                    gone.append(n - len(rest))
                    shas.append(hashlib.sha256(line).hexdigest())
                    kept.append(line if with_text else None)
                yield pa.RecordBatch.from_arrays([col("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def shared_names(state: DataFrame, reps: DataFrame) -> DataFrame:
    """(h1, h2, shared): of each text's names those that occur elsewhere, too, or twice in it.

    The round's table has one row a name; hot names, which many texts have, are spread by :func:`spread_join`.
    """
    spark = state.sparkSession
    asked = state.select("rid", F.explode("name").alias("name"))
    names = asked.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    names = materialize(names, "sub-names")
    release(spark)
    found = spread_join(asked, names, ["name"]).groupBy("rid").agg(F.collect_set("name").alias("shared"))
    found = materialize(found, "sub-found-names")
    release(spark, names)
    out = materialize(found.join(reps.hint("merge"), "rid").select("h1", "h2", "shared"), "sub-shared")
    release(spark, found)
    return out


def _with_shared(state: DataFrame, shared: DataFrame) -> DataFrame:
    """Every row of the state with its text's shared names; the state is in buckets of its key and is not shuffled."""
    s = state.join(shared.hint("merge"), ["h1", "h2"], "left")
    return s.withColumn("shared", F.coalesce("shared", F.array().cast("array<long>")))


def repeated_windows(docs: DataFrame, width: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(h1, h2, every, starts): per distinct text that has any, the starts of its repeated windows.

    ``every``: the text occurs in several rows, so all its windows do. Texts are merged by their hash at every size:
    what is found grows with the corpus.
    """
    spark = docs.sparkSession
    texts = docs.select(*text_key(), raw().alias("t")).where(F.length("t") >= 2 * width - 1)
    texts = texts.groupBy("h1", "h2").agg(F.any_value("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    state = texts.mapInArrow(_parse(width, levels[0]), f"h1 long, h2 long, copies long, at int, {_SCHEMA}")
    with small_batches(spark):
        state = bucketed(state.withColumn("rid", F.monotonically_increasing_id()), "sub-state", ["h1", "h2"])
        release(spark)
        reps = materialize(state.select("rid", "h1", "h2", "copies"), "sub-texts")
        done = levels[0]
        for more in levels[1:]:
            shared = shared_names(state, reps)
            nxt = _with_shared(state, shared).mapInArrow(_go_on(width, done, more), f"h1 long, h2 long, rid long, at int, {_SCHEMA}")
            nxt = bucketed(nxt, "sub-state", ["h1", "h2"])
            release(spark, state, shared)
            state = nxt
            done += more
        shared = shared_names(state, reps)
        win = _with_shared(state, shared).mapInArrow(_windows(width), "w1 long, rest long, rid long")
        win = materialize(win.select("w1", F.shiftright("rest", 32).alias("w2"), F.shiftright(F.col("rest").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int").alias("s"), (F.col("rest") % 2 != 0).alias("own"), "rid"), "sub-windows")
    release(spark, state, shared)
    many = materialize(win.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sub-many")
    again = spread_join(win.where("not own"), many, ["w1", "w2"]).select("rid", "s").union(win.where("own").select("rid", "s"))
    hits = again.groupBy("rid").agg(F.collect_list("s").alias("starts"))
    found = reps.join(hits, "rid", "left").where((F.col("copies") > 1) | F.col("starts").isNotNull())
    every = F.col("copies") > 1
    found = materialize(found.select("h1", "h2", every.alias("every"), F.when(~every, F.col("starts")).alias("starts")), "sub-found")
    release(spark, reps, win, many)
    return found


def text_key() -> tuple:
    """128 bits that stand for a whole text (null: the empty one)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("second"), t).alias("h2")


def remove_repeats(docs: DataFrame, width: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as ``kept``, if asked) of every row.

    Windows are judged on the input. Defined results: null and empty texts have no words; texts shorter than a window
    stay; a repeated row is a copy, so both lose all their windows; ids may be null or repeated. Extra columns are not read.
    """
    found = repeated_windows(docs, width).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "every", "starts").hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    texts = texts.join(found, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
    out = texts.select("doc_id", raw().alias("t"), F.coalesce("every", F.lit(False)).alias("every"), "starts").mapInArrow(_remove(width, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out.drop("kept")
