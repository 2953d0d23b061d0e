"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: 64 bits; a bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's
three-word shingles, repeats included. Texts of one or two words have one shingle, the whole sequence; a text
without words (null, empty, blank) has fingerprint zero and links like any other.

Covering (after Pagh, 2016): each bit position gets a non-zero vector of ``radius + 1`` bits; for every non-zero
query vector a mask keeps the positions whose vectors have odd parity with it. Whatever ``radius`` positions
differ, some mask avoids all of them, so every pair within the radius agrees under some mask: recall is 1 by
construction, not by luck.

Equal fingerprints are collapsed before the tables are built, so a group of exact copies costs one key. A bucket
beyond ``BLOCK`` members is dealt into bounded blocks, each pair of blocks a task of its own, and each emits a
spanning forest only: no cap, no all-pairs output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_map, components, discard, materialize, min_labels, raw, whole_groups

RADIUS = 3
WIDTH = 3
BLOCK = 1024


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, 42)]
    begins = [0, *ends[:-width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], 42) for a, b in zip(begins, stops, strict=True)]


def fingerprints(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        hs = shingle_hashes(t, width)
        if hs:
            bits = np.unpackbits(np.array(hs, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[i] = weights[bits.sum(axis=0, dtype=np.int64) * 2 > len(hs)].sum(dtype=np.uint64)
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) of every row; whole texts, one scan, no shuffle. ``th`` is the text's hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])
    fn = column_map(lambda texts: {"fp": fingerprints(texts)}, schema, ["doc_id", "th"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), raw().alias("t"))
    return rows.mapInArrow(fn, "doc_id long, th long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The ``2**(radius+1) - 1`` covering masks as signed 64-bit integers."""
    n = 1 << (radius + 1)
    vector = [1 + i % (n - 1) for i in range(64)]
    found = []
    for q in range(1, n):
        m = sum(1 << i for i in range(64) if (vector[i] & q).bit_count() & 1)
        found.append(m - (1 << 64) if m >> 63 else m)
    return found


def block_forest(radius: int):
    """Links of each block of fingerprints, as stars onto the first of each linked set."""

    def links_of(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(starts[1:], len(x))
        sizes = ends - starts
        group = np.repeat(np.arange(len(starts)), sizes)
        a, b = [], []
        small = np.repeat(sizes <= 24, sizes)
        at = np.flatnonzero(small)
        for d in range(1, int(sizes[sizes <= 24].max(initial=1))):
            i = at[at + d < len(x)]
            i = i[group[i] == group[i + d]]
            if not len(i):
                break
            hit = i[np.bitwise_count(x[i] ^ x[i + d]) <= radius]
            a.append(hit)
            b.append(hit + d)
        for s, e in zip(starts[sizes > 24], ends[sizes > 24], strict=True):
            rest = np.arange(s, e)
            while len(rest):  # breadth first over what is left: each member is absorbed once
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):
                    one, front = front[0], front[1:]
                    near = np.bitwise_count(x[rest] ^ x[one]) <= radius
                    got = rest[near]
                    a.append(np.full(len(got), one))
                    b.append(got)
                    front, rest = np.concatenate([front, got]), rest[~near]
        if not a:
            return np.zeros(0, int), np.zeros(0, int)
        lab = min_labels(len(x), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(lab != np.arange(len(x)))
        return moved, lab[moved]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(it, ["mask", "val", "c1", "c2"]):
            x = t.column("fp").to_numpy()
            i, j = links_of(x.view(np.uint64), starts)
            pairs = np.unique(np.stack([x[i], x[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def fingerprint_links(uniq: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints of ``uniq(fp)`` within ``radius`` bits."""
    keys = uniq.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("mask", "val"))
    sizes = keys.groupBy("mask", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = keys.join(sizes, ["mask", "val"]).withColumn("m", F.ceil(F.col("n") / block).cast("int"))
    held = held.withColumn("c", F.pmod(F.hash("fp"), F.col("m"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    held = held.select("mask", "val", F.least("c", "j").alias("c1"), F.greatest("c", "j").alias("c2"), "fp")
    keyed = held.repartition("mask", "val", "c1", "c2").sortWithinPartitions("mask", "val", "c1", "c2")
    return keyed.mapInArrow(block_forest(radius), "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, th, fp, component_id, head) of every row; ``head`` is the (doc_id, th) that stands for the group."""
    spark = docs.sparkSession
    fps = materialize(with_fingerprint(docs), "simhash-fp")
    uniq = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(place()).alias("head")), "simhash-uniq")
    comp = components(fingerprint_links(uniq, radius))
    named = uniq.join(comp, uniq.fp == comp.node, "left").select("fp", "low", "head", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"), F.min("head").alias("head"))
    of = materialize(named.select("fp", "root").join(low, "root").select("fp", "component_id", "head"), "simhash-of")
    discard(spark, uniq, comp)
    return fps.join(of, "fp")


def place():
    """Order of rows in a group: by id, null ids last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint (16 hex digits), component_id`` and the signed ``fp``.

    Defined results: null text is the empty text; a null ``doc_id`` keeps its row and never names a component
    (null if nothing else is in it); repeated rows stay repeated; an empty table gives an empty table. Extra
    columns are not read.
    """
    return grouped(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def drop_others(docs: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """``docs`` without the rows that ``found(doc_id, th, head)`` does not name as the head of their group.

    Rows go by id and text, not by id alone, so another text under the same id stays. Rows that share both are one
    document, and stay or go together.
    """
    drop = found.where(place() != F.col("head")).select(F.col("doc_id").alias("__drop_id"), F.col("th").alias("__drop_th")).distinct()
    drop = materialize(drop, tag)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__drop_id")) & (F.xxhash64(docs["text"]) == F.col("__drop_th"))
    return docs.join(drop.hint("merge"), same, "left_anti").select(*[docs[c] for c in docs.columns])


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the one with the smallest id (null ids last; then by the text's hash).

    Columns are those of ``docs``; see :func:`drop_others` for repeated ids and rows.
    """
    return drop_others(docs, grouped(docs, radius), "simhash-drop")
