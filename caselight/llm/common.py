"""What the training-data operators share: durable intermediate tables, labelled samples, streamed groups, components."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path, spread

#: Words are maximal runs of anything but these six ASCII characters; ``bytes.split()`` splits on the same set.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot if it holds more than this share (one in so many) of all rows; so there are fewer hot keys than this.
HOT_SHARE = 1024

_written: dict[str, list[str]] = {}
_buckets: dict[str, str] = {}  # path of a bucketed table: its name


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike executor-local caching the table survives lost executors, and its size is known to the
    planner, so that Spark broadcasts it only when it is below the session's threshold.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._caselight_path = path
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows a batch than usual for what is written meanwhile, as each row holds the arrays of a whole text."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    old = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, str(rows))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bucketed(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """As :func:`materialize`, but in hash buckets of ``keys``: joins by them later on leave this table where it is."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = "caselight_" + path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._caselight_path = path
    _buckets[path] = name
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    known = _written.get(spark.sparkContext.applicationId, [])
    for df in written:
        name = df if isinstance(df, str) else df._caselight_path
        if name in _buckets:
            spark.sql(f"DROP TABLE IF EXISTS {_buckets.pop(name)}")
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in known:
            known.remove(name)


def tables_written(spark: SparkSession) -> list[str]:
    """Paths of the tables that are there now, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Delete what was written since ``before`` but for ``keep``: the intermediate tables of a step that is done."""
    discard(spark, *(p for p in tables_written(spark) if p not in before and p != keep._caselight_path))


def release(spark: SparkSession, *written: DataFrame) -> None:
    """Drop what earlier steps left behind: tables of :func:`materialize` that nothing reads any more, and shuffle files.

    Spark deletes shuffle files when the driver collects the plans that wrote them, which may be half an hour
    later; the steps here are done once their table is written, so it is asked to do so now.
    """
    jvm = spark.sparkContext._jvm
    discard(spark, *written)
    for _ in range(2):  # what the first round frees can hold what the second finds
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)  # files go in another thread


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` (written or cheap) with the one row that ``keyed`` (written) has for their key; ``n`` of it counts them.

    Hot keys, fewer than ``HOT_SHARE`` by definition, go by broadcast, so their rows stay where they are; no other key
    holds more than that share of all rows, and these are merged. At every size the same.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * F.lit(HOT_SHARE) > F.lit(total)
    hot, rest = F.broadcast(keyed.where(often)), keyed.where(~often).hint("merge")
    cold = rows.join(F.broadcast(keyed.where(often).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(rest, keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; ``documents`` in too few row groups for the cores is dealt out anew, see :func:`caselight.tables.spread`."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" else df


def raw(text: str = "text") -> Column:
    """The UTF-8 bytes of a text (null: none), so that Python never has to decode or to trust them."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id belongs to no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class outside the held-out fold, and the class totals.

    Ids are taken in the order of their hash, so reruns agree. Rows with a null id or label teach nothing;
    of contradicting rows for one id the larger label holds. The result is bounded by ``2 * per_class`` ids.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .where(fold_of(F.col("doc_id"), modulus) != held)
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for y in (0, 1):
        h = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
        part = min(1 << 32, int((1 << 32) * (per_class + 6 * per_class**0.5 + 20) / max(1, totals.get(y, 0))))
        # the hash threshold leaves about as many rows as are wanted, so that tasks send few, however many there are
        rows += known.where((F.col("y") == y) & (h < part)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    spark = labels.sparkSession
    return spark.createDataFrame([(r["doc_id"], r["y"]) for r in rows], "doc_id long, y int"), totals


def sampled_docs(docs: DataFrame, ids: DataFrame, parts: int = 12) -> DataFrame:
    """(doc_id, y, t) of the sampled documents, one row an id (of several texts the smallest), in ``parts`` partitions.

    ``ids`` is bounded by its sampler, hence broadcast: one scan of the texts, and only the sample's are shuffled.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("t")).join(F.broadcast(ids), "doc_id")
    return materialize(found.groupBy("doc_id", "y").agg(F.min("t").alias("t")).repartition(parts, "doc_id"), "sample")


def batches_of(rows: pa.RecordBatch, column: str = "t", limit: int = 4_000_000) -> Iterator[tuple[slice, list[bytes]]]:
    """Slices of a record batch that hold about ``limit`` bytes of text at most (one row at least)."""
    texts = [t or b"" for t in rows.column(column).cast(pa.binary()).to_pylist()]
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield slice(start, i), texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts)), texts[start:]


def whole_groups(it: Iterator[pa.RecordBatch], keys: list[str], most: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup key-sorted batches into tables that hold whole groups only, with the start of each group.

    Memory is bounded by a batch and the largest group, which callers bound by blocking.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in it:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            t = pa.Table.from_batches(held)
            s = starts(t)
            if len(s) > 1:
                yield t.slice(0, int(s[-1])), s[:-1]
                held = t.slice(int(s[-1])).combine_chunks().to_batches()
                rows = len(t) - int(s[-1])
    if rows:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the links ``a``–``b``."""
    lab = np.arange(n)
    while True:
        old = lab.copy()
        np.minimum.at(lab, b, lab[a])
        np.minimum.at(lab, a, lab[b])
        lab = lab[lab]
        if np.array_equal(old, lab):
            return lab


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``links(a long, b long)`` → ``(node, root)``, root the smallest reachable node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): a logarithmic number of rounds in
    practice, each a partial-aggregated minimum and a join that AQE can split when a node is hot. Every round
    is written to the shared folder; only a checksum reaches the driver.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc"
    )
    seen = edges.limit(1).count() and None
    for _ in range(rounds if seen is None else 0):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, materialize(small.where("u <> v").distinct(), "cc")
        discard(links.sparkSession, old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        if seen != 0:
            raise RuntimeError("components did not converge")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._caselight_path = edges._caselight_path
    return out


def column_map(fn: Callable[[list[bytes]], dict[str, list]], schema: pa.Schema, keep: list[str], limit: int = 4_000_000):
    """An Arrow map: ``fn`` turns the texts of a slice into new columns; ``keep`` passes through."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in batches_of(batch, limit=limit):
                new = fn(texts)
                old = {k: batch.column(k).slice(part.start, part.stop - part.start) for k in keep}
                yield pa.RecordBatch.from_arrays([old[f.name] if f.name in old else pa.array(new[f.name], f.type) for f in schema], schema=schema)

    return run


def keep_rows(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray], limit: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` for whose text ``keep`` says true, all columns as they are; one pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in batches_of(batch, "text", limit):
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(np.asarray(keep(texts), bool)))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
