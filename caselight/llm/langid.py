"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is exact over every training row and runs where the rows are: a task keeps one dense count vector per
language and emits its non-zero entries once. The log-probability matrix is broadcast in blocks of languages. A batch of
texts is scored as a sparse matrix: its (text, bucket, count) entries gather matrix rows, which are summed per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, column_map, fold_of, materialize, raw

BUCKETS = 1 << 15
#: n-gram lengths, in characters of the lower-cased text.
LENGTHS = (1, 2, 3, 4)
ALPHA = 0.5
#: Languages of one block of the matrix, which takes BUCKETS * 4 bytes a language. There may be any number of blocks.
BLOCK = 512
#: Bytes of text that are scored at once.
BATCH = 1_000_000

_WORDY = re.compile(r"[^\W\d_]")
_SPACES = re.compile(r"\s+")


def characters(text: bytes) -> str:
    """What n-grams are taken from: the lower-cased text; bytes that are no UTF-8 count as U+FFFD, white space as one blank."""
    return _SPACES.sub(" ", text.decode("utf-8", "replace").lower())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of whole texts; no n-gram reaches across texts."""
    chars = [characters(t) for t in texts]
    lens = np.fromiter(map(len, chars), np.int64, len(chars))
    c = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(chars), dtype=np.uint32), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(c))  # characters from here to the text's end
    rows, out = [], []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        if n in LENGTHS:
            inside = left[: len(h)] >= n
            rows.append(of[: len(h)][inside])
            out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(17))[inside])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return np.concatenate(rows), np.concatenate(out)


def sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the texts' n-grams, sorted by text and bucket."""
    row, bucket = grams(texts)
    if len(texts) <= 1 << 17:
        key = np.sort((row << np.uint32(15)) | bucket)
    else:
        key = np.sort((row.astype(np.uint64) << np.uint64(15)) | bucket)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    key, n = key[first], np.diff(np.append(first, len(key)))
    return (key >> key.dtype.type(15)).astype(np.int64), (key & key.dtype.type(BUCKETS - 1)).astype(np.int64), n


def has_letter(text: bytes) -> bool:
    """Whether a character of a category L* is there; fractions, circled and Roman numerals are none."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text.decode("utf-8", "replace")))


class Bayes:
    """Languages and log-priors, and the blocks of the log-probability matrix, each (buckets, languages) and broadcast."""

    def __init__(self, langs: list[str], prior: np.ndarray, blocks: list[Broadcast]):
        self.langs, self.prior, self.blocks = langs, prior, blocks

    def block(self, i: int) -> np.ndarray:
        """One block is kept by the worker; of several, each is loaded as it is needed."""
        b = self.blocks[i]
        return b.value if len(self.blocks) == 1 or b._path is None else b.load_from_path(b._path)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) log-posteriors up to a constant."""
        out = np.tile(self.prior, (len(texts), 1))
        row, bucket, n = sparse(texts)
        if not len(row):
            return out
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        seen, at = row[starts], 0
        for i in range(len(self.blocks)):
            log = self.block(i)
            for j in range(log.shape[1]):
                out[seen, at + j] += np.add.reduceat(log[:, j][bucket] * n, starts)
            at += log.shape[1]
        return out

    def predict(self, texts: list[bytes]) -> dict[str, list]:
        if not self.langs:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        s = self.scores(texts)
        best = s.argmax(1)
        p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
        ok = [has_letter(t) for t in texts]
        return {"lang_pred": [self.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)], "score": [float(x) if k else 0.0 for x, k in zip(p, ok, strict=True)]}


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities of (buckets, languages) counts; columns are laid out one after the other."""
    p = counts + ALPHA
    return np.asfortranarray((np.log(p) - np.log(p.sum(0))).astype(np.float32))


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, block: int = BLOCK) -> Bayes:
    """Learn from text and non-null ``lang`` of every row outside the held-out fold (null ids belong to no fold and are left out)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), modulus) != held))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in it:
            for part, texts in batches_of(batch, limit=BATCH):
                by: dict[str, list[bytes]] = {}
                for lang, t in zip(batch.column("lang").slice(part.start, part.stop - part.start).to_pylist(), texts, strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, ts in by.items():
                    if lang not in seen:
                        seen[lang], n[lang] = np.zeros(BUCKETS, np.int64), 0
                    seen[lang] += np.bincount(grams(ts)[1], minlength=BUCKETS)
                    n[lang] += len(ts)
        for lang, v in seen.items():
            b = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(b) + 1)), pa.array(np.append(b, -1), pa.int32()), pa.array(np.append(v[b], n[lang]))], names=["lang", "b", "n"])

    per = rows.select("lang", raw().alias("t")).mapInArrow(count, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n"))
    spark: SparkSession = docs.sparkSession
    langs, prior, blocks, held_langs = [], [], [], []

    def close() -> None:
        if held_langs:
            blocks.append(spark.sparkContext.broadcast(log_probabilities(np.array(held_langs).T)))
            held_langs.clear()

    for r in materialize(per, "lang-counts").orderBy("lang", "b").toLocalIterator():  # a block of languages at a time
        if not langs or langs[-1] != r["lang"]:
            if len(held_langs) == block:
                close()
            langs.append(r["lang"])
            held_langs.append(np.zeros(BUCKETS))
            prior.append(0.0)
        if r["b"] < 0:
            prior[-1] = float(np.log(r["n"]))
        else:
            held_langs[-1][r["b"]] = r["n"]
    close()
    return Bayes(langs, np.array(prior), blocks)


def predict(docs: DataFrame, model: Bayes, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Defined results: null texts and texts without a letter are ``und`` with score 0; a null id is not held out;
    nothing learned means ``und`` everywhere. Extra columns are not read.
    """
    ids = F.col("doc_id").cast("long")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return docs.select(ids.alias("doc_id"), F.coalesce(fold_of(ids, modulus) == held, F.lit(False)).alias("held_out"), raw().alias("t")).mapInArrow(
        column_map(model.predict, schema, ["doc_id", "held_out"], limit=BATCH), "doc_id long, held_out boolean, lang_pred string, score double"
    )
