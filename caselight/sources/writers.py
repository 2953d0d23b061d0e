"""Sinks: JSON and CSV tables, one file per document, appending checkpoints."""

from __future__ import annotations

import json
import textwrap
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import ArrowException, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, overwritten; non-ASCII characters as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, order: str | None = None) -> None:
    """One file that holds one array of objects, indented by two, non-ASCII characters as they are, overwritten.

    Executors render the rows into part files beside it, and one task puts these together in order, as one file has one
    writer; the driver sees no row. On a file system that Arrow does not know the driver has to pass the rows on, a partition
    at a time. For tables that outgrow one file there is :func:`write_json`.
    """

    def render(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"row": [textwrap.indent(json.dumps(json.loads(r), ensure_ascii=False, indent=2), "  ") for r in p["row"]]})

    spark = df.sparkSession
    rows = df if order is None else df.orderBy(order)
    rows = rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")).mapInPandas(render, "row string")
    try:
        _arrow_files(path)
    except (ArrowException, OSError):
        _pass_on(rows, path)
        return
    parts = f"{path}.{uuid.uuid4().hex}.parts"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, (files, folder) = 0, _arrow_files(parts)
        files.create_dir(folder, recursive=True)
        part = f"{folder}/_{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as out:
            for p in batches:
                for r in p["row"]:
                    out.write(((",\n" if n else "") + r).encode())
                    n += 1
        files.move(part, f"{folder}/{TaskContext.get().partitionId():09d}")
        yield pd.DataFrame({"n": [n]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            files, folder = _arrow_files(parts)
            _, name = _arrow_files(path)
            found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            whole = [f.path for f in sorted(found, key=lambda f: f.base_name) if f.size and f.base_name.isdigit()]
            with files.open_output_stream(f"{folder}.part") as out:
                for i, p in enumerate(whole):
                    out.write(b",\n" if i else b"[\n")
                    with files.open_input_stream(p) as part:
                        while block := part.read(1 << 20):
                            out.write(block)
                out.write(b"\n]" if whole else b"[]")
            files.move(f"{folder}.part", name)
            top, _, base = name.rpartition("/")
            if files.get_file_info(f"{top}/.{base}.crc").type == fs.FileType.File:  # Hadoop's, of the file that was here before
                files.delete_file(f"{top}/.{base}.crc")
            yield pd.DataFrame({"n": [len(whole)]})

    try:
        rows.mapInPandas(write, "n long").write.mode("overwrite").format("noop").save()
        spark.range(0, 1, 1, 1).mapInPandas(join, "n long").write.mode("overwrite").format("noop").save()
    finally:
        files, folder = _arrow_files(parts)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


def _arrow_files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _pass_on(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, True)
    try:
        first = True
        for r in rows.toLocalIterator():
            out.write(bytearray((("[\n" if first else ",\n") + r["row"]).encode()))
            first = False
        out.write(bytearray(b"[]" if first else b"\n]"))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """The same rows as ``path/csv`` and ``path/json``."""
    write_csv(df, f"{path}/csv")
    write_json(df, f"{path}/json")


def write_texts(df: DataFrame, path: str, key: str = "id", text: str = "text") -> None:
    """Texts as a Parquet table, the form later steps read."""
    df.select(key, text).write.mode("overwrite").parquet(path)


def export_text_files(df: DataFrame, path: str, key: str = "id", text: str = "text", suffix: str = ".txt") -> None:
    """One file per document under its own name (``key`` and ``suffix``), overwritten.

    Tasks write through Arrow's file systems, so the folder may be local, HDFS or an object store; each file is written
    under another name first and then moved, so that a task that is run again replaces whole files by the same.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = _arrow_files(path)
        files.create_dir(folder, recursive=True)
        for p in parts:
            for k, t in zip(p["k"], p["t"], strict=True):
                part = f"{folder}/_{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as out:
                    out.write(t.encode())
                files.move(part, f"{folder}/{k}{suffix}")
            yield pd.DataFrame({"n": [len(p)]})

    rows = df.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows.mapInPandas(write, "n long").write.mode("overwrite").format("noop").save()


def append_batch(path: str):
    """A ``foreachBatch`` sink that appends each micro-batch: what is done survives a failure later on.

    The batch id is part of the folder, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write
