"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees of one depth, flattened into arrays (feature, threshold, leaf), so that a batch
of documents walks all trees with a few numpy gathers. The fit uses a bounded sample of labelled rows; scoring is one
pass over whole texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_map, fold_of, labelled_sample, raw, sampled_docs

#: Bound of the fit: labelled documents of each class.
PER_CLASS = 4000
TREES, DEPTH, BINS = 80, 4, 64
RATE, RIDGE, LEAST_WEIGHT = 0.15, 2.0, 8.0
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)  # 0 other ASCII punctuation
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[10] = 5
_KIND[128:] = 6
_KIND[list(b".,;:!?'\"")] = 7
_KIND[list(b"|*#$%&@^~<>=+_\\/{}[]")] = 8
N_FEATURES = 24


def statistics(text: bytes) -> np.ndarray:
    """Statistics of one whole text."""
    x = np.zeros(N_FEATURES)
    n = len(text)
    if not n:
        return x
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 9)
    x[0] = np.log1p(n)
    x[1:10] = kinds / n
    words = text.split()
    k = len(words)
    if not k:
        return x
    lens = np.fromiter(map(len, words), np.int64, k)
    seen = Counter(words)
    top = max(seen.values())
    lines = text.split(b"\n")
    filled = [s for s in map(bytes.strip, lines) if s]
    x[10] = np.log1p(k)
    x[11], x[12], x[13] = lens.mean(), lens.std(), np.log1p(lens.max())
    x[14] = len(seen) / k
    x[15] = top / k
    x[16] = len(seen) / np.sqrt(k)
    x[17] = sum(c for c in seen.values() if c == 1) / k
    x[18] = np.log1p(k / max(1, len(filled)))
    x[19] = len(set(filled)) / max(1, len(filled))
    x[20] = sum(w[-1:] in b".!?" for w in words) / k
    x[21] = sum(w[:1].isupper() for w in words) / k
    pairs = list(zip(words, words[1:], strict=False))
    x[22] = len(set(pairs)) / max(1, len(pairs))
    x[23] = len(zlib.compress(text, 1)) / n
    return x


class Trees:
    """Flattened ensemble; node ``i`` of a tree has children ``2i+1`` and ``2i+2``."""

    def __init__(self, base: float):
        self.base = base
        self.feature = np.zeros((0, (1 << DEPTH) - 1), np.int32)
        self.cut = np.zeros((0, (1 << DEPTH) - 1))
        self.leaf = np.zeros((0, 1 << DEPTH))

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            at = np.zeros((len(part), len(trees)), np.int32)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.cut[trees, at])
            out[a : a + 4096] += self.leaf[trees, at - self.cut.shape[1]].sum(1)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([statistics(t) for t in texts]).reshape(-1, N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Second-order boosting on quantile-binned statistics."""
    rate = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3) if len(y) else 0.5
    model = Trees(float(np.log(rate / (1 - rate))))
    if len(set(y.tolist())) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # x <= cuts[b] if bin <= b
    inner = (1 << DEPTH) - 1
    f = np.full(len(y), model.base)
    feature, cut, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        tf, tc = np.zeros(inner, np.int32), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            node = at - first
            gain, pick = np.full(width, 1e-6), np.full((width, 2), -1)
            for j in range(x.shape[1]):
                nb = len(cuts[j]) + 1
                if nb < 2:
                    continue
                key = node * nb + binned[:, j]
                gs = np.bincount(key, g, width * nb).reshape(width, nb).cumsum(1)
                hs = np.bincount(key, h, width * nb).reshape(width, nb).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                v = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                v[(hl < LEAST_WEIGHT / 8) | (ht - hl < LEAST_WEIGHT / 8)] = -1
                b = v.argmax(1)
                better = v[np.arange(width), b] > gain
                gain = np.where(better, v[np.arange(width), b], gain)
                pick[better] = np.stack([np.full(width, j), b], 1)[better]
            for i in np.flatnonzero(pick[:, 0] >= 0):
                tf[first + i], tc[first + i] = pick[i, 0], cuts[pick[i, 0]][pick[i, 1]]
            at = 2 * at + 1 + (x[np.arange(len(y)), tf[at]] > tc[at])
        at -= inner
        value = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        f = f + value[at]
        feature.append(tf)
        cut.append(tc)
        leaf.append(value)
    model.feature, model.cut, model.leaf = np.array(feature), np.array(cut), np.array(leaf)
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, label: str = "quality", per_class: int = PER_CLASS) -> Trees:
    """Fit on at most ``per_class`` labelled documents of each class outside the held-out fold, weighted to the classes' true shares."""
    ids, totals = labelled_sample(labels, label, modulus, held, per_class)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = [statistics(t).tolist() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sampled_docs(docs, ids).select("y", "t").mapInArrow(measure, "y int, x array<double>").collect()  # numbers only, bounded by the sample
    y = np.array([r["y"] for r in rows], float)
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    share = {k: totals.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return boost(x, y, weight / weight.mean() if len(y) else weight)


def score(docs: DataFrame, model: Trees, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Defined results: null and empty texts have all statistics zero; a null id is not held out; repeated rows are scored
    alike. Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> dict[str, list]:
        s = shared.value.scores(texts)
        return {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce(fold_of(ids, modulus) == held, F.lit(False)).alias("held_out"), raw().alias("t")).mapInArrow(
        column_map(run, schema, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double, predicted int"
    )
