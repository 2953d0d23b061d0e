"""Toxicity by a linear-chain conditional random field over words.

Labelled tokens: documents carry a label, tokens do not, so the token labels are derived. A word of a toxic
training document is labelled toxic if it, or a stem that starts it, is significantly more frequent in toxic than in other training documents.
The chain (states: other, toxic) is then trained on runs of such tokens by gradient ascent on the exact
log-likelihood. In a text, forward-backward marginals give each word's probability; they aggregate to the document's
score by a logistic curve fitted on training documents, and words above ``SPAN`` join into offending byte offsets.

Features of a word are its own hash, two prefixes and a suffix, so an emission depends on the word alone and is looked
up once per distinct word; the two-state recursion is one number per position, run over many texts at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_map, fold_of, keep_rows, labelled_sample, raw, sampled_docs

#: Bounds of the fit: training documents of each class, words of the lexicon, runs of each kind, words in a run.
PER_CLASS = 3000
LEXICON = 4096
RUNS = 5000
RUN_WORDS = 48
#: A word labels tokens if its smoothed odds are so many deviations above four times the odds of the other class; the
#: halves added to each count are the only prior, so that a word needs about 15 documents even if no other class has it.
Z = 1.4
LEAST_DOCS = 3
DIM = 1 << 18
SPAN = 0.5
#: Bytes of a word that count, wherever words are counted, trained or scored.
WORD_BYTES = 64
#: Lengths of stems, in bytes, that may label words.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_/\\=+~`"


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(_EDGE)[:WORD_BYTES] for w in text.lower().split()]


def features(word: bytes) -> tuple[int, int, int, int]:
    return zlib.crc32(b"w" + word) % DIM, zlib.crc32(b"p" + word[:5]) % DIM, zlib.crc32(b"q" + word[:7]) % DIM, zlib.crc32(b"s" + word[-3:]) % DIM


def keys(word: bytes) -> list[bytes]:
    """What may label a word: itself, or a stem that starts it."""
    return [b"w" + word, *(b"p" + word[:k] for k in STEMS if len(word) > k)]


def _lexicon(train: DataFrame) -> set[bytes]:
    """Words and stems by significance; counting runs on the executors, at most ``LEXICON`` come back.

    ``train`` has a row per document, so a word is in no more documents than there are of the class.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in it:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                seen[y].update({k for w in set(words_of(t)) if len(w) > 1 for k in keys(w)})
        ws = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array([seen[0][w] for w in ws], pa.int64()), pa.array([seen[1][w] for w in ws], pa.int64())], names=["w", "n0", "n1"])

    found = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = (float(found.get(y, 0)) for y in (0, 1))
    c = train.select("y", "t").mapInArrow(count, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (n1 + 1 - a + 0.5)) - F.log(b / (n0 + 1 - b + 0.5))
    z = (odds - F.log(F.lit(4.0))) / F.sqrt(1 / a + 1 / b)  # significantly more than four times the odds
    rows = c.withColumn("z", z).where((F.col("n1") >= LEAST_DOCS) & (F.col("z") >= Z)).orderBy(F.desc("z"), "w").limit(LEXICON).collect()
    return {bytes(r["w"]) for r in rows}


def _runs(train: DataFrame, lexicon: set[bytes]) -> list[tuple[list[bytes], list[int]]]:
    """Bounded token runs with derived labels, by hash order, with and without toxic tokens."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for d, y, t in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                ws = words_of(t)
                for i in range(0, len(ws), RUN_WORDS):
                    part = ws[i : i + RUN_WORDS]
                    tags = bytes(1 if y and any(k in lexicon for k in keys(w)) else 0 for w in part)
                    rows.append((any(tags), zlib.crc32(b"%d %d" % (d, i)), b" ".join(w or b"-" for w in part), tags))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.bool_(), pa.int64(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.bool_(), pa.int64(), pa.binary(), pa.binary())], names=["hot", "r", "ws", "tags"])

    runs = train.select("doc_id", "y", "t").mapInArrow(cut, "hot boolean, r long, ws binary, tags binary")
    got = []
    for hot in (True, False):
        got += runs.where(F.col("hot") == hot).orderBy("r", "ws").limit(RUNS).collect()
    return [(bytes(r["ws"]).split(b" "), list(r["tags"])) for r in got]


def _marginals(u: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic : other) and log-odds of the marginals; rows sorted by falling length.

    ``u`` are emissions (log-odds) padded to ``(texts, positions)``; ``trans[i, j]`` log-potentials from i to j.
    """
    n, width = u.shape
    e = np.exp(np.clip(u, -30, 30))
    t = np.exp(trans)
    fwd, bwd = np.zeros_like(u), np.ones_like(u)
    alive = np.searchsorted(-lengths, -np.arange(width), "left")  # texts longer than each position
    fwd[:, 0] = e[:, 0]
    for j in range(1, width):
        k = alive[j]
        r = fwd[:k, j - 1]
        fwd[:k, j] = e[:k, j] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
    for j in range(width - 2, -1, -1):
        k = alive[j + 1]
        r = e[:k, j + 1] * bwd[:k, j + 1]
        bwd[:k, j] = (t[1, 0] + r * t[1, 1]) / (t[0, 0] + r * t[0, 1])
    return fwd, bwd, np.log(np.maximum(fwd, 1e-30)) + np.log(np.maximum(bwd, 1e-30))


def _train_chain(runs: list[tuple[list[bytes], list[int]]], epochs: int = 12, step: float = 0.3, batch: int = 256) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and transitions by AdaGrad on the exact gradient of the log-likelihood."""
    rng = np.random.default_rng(7)
    weights, bias, trans = np.zeros(DIM), -3.0, np.zeros((2, 2))
    g2, gb2, gt2 = np.full(DIM, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    made = [(np.array([features(w) for w in ws]), np.array(tags, float)) for ws, tags in runs if ws]
    for _ in range(epochs if made else 0):
        order = rng.permutation(len(made))
        for i in range(0, len(order), batch):
            part = sorted((made[k] for k in order[i : i + batch]), key=lambda x: -len(x[1]))
            lengths = np.array([len(y) for _, y in part])
            width = lengths[0]
            real = np.arange(width) < lengths[:, None]
            x = np.zeros((len(part), width, 4), int)
            y = np.zeros((len(part), width))
            for r, (f, tag) in enumerate(part):
                x[r, : len(f)], y[r, : len(f)] = f, tag
            u = np.where(real, weights[x].sum(-1) + bias, 0)
            fwd, bwd, odds = _marginals(u, trans, lengths)
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            d = np.where(real, y - p, 0) / len(part)
            t, e = np.exp(trans), np.exp(np.clip(u, -30, 30))
            both = real[:, 1:]
            r, s = fwd[:, :-1], e[:, 1:] * bwd[:, 1:]  # pair posteriors, other state scaled to 1
            pairs = np.stack([np.broadcast_to(t[0, 0], r.shape), s * t[0, 1], r * t[1, 0], r * s * t[1, 1]])
            pairs = pairs / pairs.sum(0)
            a, b = y[:, :-1], y[:, 1:]
            seen = np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b])
            gt = ((seen - pairs) * both).sum((1, 2)).reshape(2, 2) / len(part) - 1e-3 * trans
            gw = np.bincount(x.reshape(-1), np.repeat(d.reshape(-1), 4), DIM)
            touched = np.flatnonzero(gw)
            gw = gw[touched] - 1e-4 * weights[touched]
            g2[touched] += gw**2
            weights[touched] += step * gw / np.sqrt(g2[touched])
            gb = d.sum()
            gb2 += gb**2
            bias += step * gb / np.sqrt(gb2)
            gt2 += gt**2
            trans += step * gt / np.sqrt(gt2)
    return weights.astype(np.float32), float(bias), trans


class Chain:
    """The trained chain; picklable, about a megabyte whatever the corpus."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray):
        self.weights, self.bias, self.trans = weights, bias, trans
        self.curve = np.array([-6.0, 0.0, 0.0, 0.0])  # until it is fitted nothing is toxic
        self._known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def emissions(self, ws: list[bytes]) -> np.ndarray:
        known = self._known
        new = {w for w in ws if w not in known}
        if new:
            if len(known) > 1_000_000:
                known.clear()
                new = set(ws)
            f = np.array([features(w) for w in new])
            known.update(zip(new, (self.weights[f].sum(1) + self.bias).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, ws), np.float64, len(ws))

    def marginals(self, texts: list[bytes], group: int = 1_500_000) -> list[np.ndarray]:
        """Each word's probability of being toxic, for whole texts of any length."""
        us = [self.emissions(words_of(t)) for t in texts]
        out: list[np.ndarray] = [np.zeros(0)] * len(us)
        order = sorted((i for i in range(len(us)) if len(us[i])), key=lambda i: -len(us[i]))
        at = 0
        while at < len(order):
            take = max(1, group // len(us[order[at]]))
            part, at = order[at : at + take], at + take
            lengths = np.array([len(us[i]) for i in part])
            u = np.zeros((len(part), lengths[0]))
            for r, i in enumerate(part):
                u[r, : lengths[r]] = us[i]
            odds = _marginals(u, self.trans, lengths)[2]
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            for r, i in enumerate(part):
                out[i] = p[r, : lengths[r]]
        return out

    def summary(self, ps: list[np.ndarray]) -> np.ndarray:
        """(texts, 4) from marginals: one, expected toxic words (log), largest marginal, length (log)."""
        x = np.zeros((len(ps), 4))
        for i, p in enumerate(ps):
            x[i] = 1, np.log1p(p.sum()), p.max(initial=0), np.log1p(len(p)) / 10
        return x

    def scores(self, ps: list[np.ndarray]) -> np.ndarray:
        """The documents' scores from their marginals."""
        return 1 / (1 + np.exp(-np.clip(self.summary(ps) @ self.curve, -40, 40)))

    def spans(self, text: bytes) -> list[tuple[int, int, float]]:
        return spans(text, self.marginals([text])[0])


def spans(text: bytes, p: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, probability) in bytes of each maximal run of words whose marginal reaches ``SPAN``."""
    if p.max(initial=0) < SPAN:
        return []
    found: list[list] = []
    last = -2
    for i, m in enumerate(re.finditer(rb"[^\x20\x09-\x0d]+", text)):
        if p[i] >= SPAN:
            if last == i - 1:
                found[-1][1], found[-1][2] = m.end(), max(found[-1][2], float(p[i]))
            else:
                found.append([m.start(), m.end(), float(p[i])])
            last = i
    return [tuple(x) for x in found]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b), -2, 2)
    return b


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, label: str = "toxic", per_class: int = PER_CLASS) -> Chain:
    """Train on at most ``per_class`` labelled documents of each class outside the held-out fold.

    Without both classes the chain knows nothing and every score is near zero.
    """
    ids, totals = labelled_sample(labels, label, modulus, held, per_class)
    train = sampled_docs(docs, ids)
    lexicon = _lexicon(train)
    chain = Chain(*_train_chain(_runs(train, lexicon)))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def summarise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = shared.value.summary(shared.value.marginals(batch.column("t").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(x[:, i]) for i in range(4))], names=["y", "x0", "x1", "x2", "x3"])

    rows = train.select("y", "t").mapInArrow(summarise, "y int, x0 double, x1 double, x2 double, x3 double").collect()  # a few numbers per sampled document
    if rows and len({r["y"] for r in rows}) == 2:
        a = np.array([tuple(r) for r in rows], float)
        share = {y: totals[y] / sum(a[:, 0] == y) for y in (0, 1)}
        weight = np.where(a[:, 0] == 1, share[1], share[0])
        chain.curve = logistic(a[:, 1:], a[:, 0], weight / weight.mean())
    return chain


def score(docs: DataFrame, chain: Chain, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending spans (byte offsets and probability) of every row.

    Defined results: null and empty texts are scored as texts without words; a null id is not held out; repeated rows
    are scored alike and, when they train, count once (of several texts under one id the smallest). Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(texts: list[bytes]) -> dict[str, list]:
        ps = shared.value.marginals(texts)
        s = shared.value.scores(ps)
        found = [[{"start": a, "end": b, "p": p} for a, b, p in spans(t, m)] for t, m in zip(texts, ps, strict=True)]
        return {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32), "spans": found}

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", span)])
    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce(fold_of(ids, modulus) == held, F.lit(False)).alias("held_out"), raw().alias("t")).mapInArrow(
        column_map(run, schema, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    )


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents that score below the threshold, all columns as they are; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    return keep_rows(docs, lambda texts: shared.value.scores(shared.value.marginals(texts)) < THRESHOLD)
