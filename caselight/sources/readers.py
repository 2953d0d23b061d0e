"""Readers: text folders (lenient and strict), CSV and JSON arrays with stated schemas, PDF folders, HTML pages."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chars import strip, unix_lines

METADATA = "id string, case_name string, pdf_url string, saved_file string, original_filename string"
STRUCTURED = "id string, source_file string, confidence string, sections_found array<string>, facts_inferred boolean, facts string, arguments string, `order` string"
CLASSIFICATION = "id string, case_type string, word_count int, doc_type string, facts_found boolean"
REFERENCES = "id string, case_type string, reference_summary_bn string, reference_type string"
SUMMARIES = "id string, source_file string, model string, summary_bn string"
DECISIONS = "id string, source_file string, text_source string, tail_sentences_examined int, final_reasoning_evidence array<string>, final_decision_evidence array<string>, decision_found boolean"
EVIDENCE = (
    "id string, source_file string, facts_inferred boolean, legal_issue_evidence array<string>, relevant_fact_evidence array<string>, "
    "legal_basis_evidence array<string>, court_reasoning_evidence array<string>, decision_evidence array<string>, "
    "components_found struct<issue:boolean,facts:boolean,legal_basis:boolean,reasoning:boolean,decision:boolean>"
)
PACKS = (
    "id string, source_file string, facts_inferred boolean, legal_issue_evidence array<string>, fact_evidence array<string>, "
    "legal_basis_evidence array<string>, court_reasoning_evidence array<string>, court_decision_evidence array<string>"
)
LEAST_STRICT = 200
#: Files of one batch, in bytes; a larger file is a batch of its own.
BATCH_BYTES = 4_000_000


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name[0] == "." or (name[0] == "_" and "=" not in name)


def _local_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """The rows of :func:`_files` for a plain local folder: executors list it and read its files in large batches.

    Spark would list every file in the driver and count each as 4 MB, which makes a task of a few files.
    """
    top = folder.removeprefix("file://").removeprefix("file:")
    n = spark.sparkContext.defaultParallelism * 4

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def names() -> Iterator[str]:
            with os.scandir(top) as found:
                yield from (e.name for e in found if not _hidden(e.name) and e.name.lower().endswith(suffix) and e.is_file())

        for _ in batches:
            every = names()
            while some := list(islice(every, 10_000)):
                yield pd.DataFrame({"source_file": some})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            names, contents, size = [], [], 0
            for name in p["source_file"]:
                names.append(name)
                contents.append(Path(top, name).read_bytes())
                size += len(contents[-1])
                if size > BATCH_BYTES:
                    yield pd.DataFrame({"source_file": names, "content": contents})
                    names, contents, size = [], [], 0
            yield pd.DataFrame({"source_file": names, "content": contents})

    names = spark.range(0, 1, 1, 1).mapInPandas(listed, "source_file string").repartition(n, "source_file")
    df = names.mapInPandas(read, "source_file string, content binary")
    return df.select("source_file", F.concat(F.lit(f"file:{top}/"), "source_file").alias("path"), "content").withColumn("id", F.regexp_replace("source_file", r"\.[^.]*$", ""))


def _files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    if folder.startswith(("file:/", "/")) and os.path.isdir(top := folder.removeprefix("file://").removeprefix("file:")):
        with os.scandir(top) as found:
            plain = not any("=" in e.name and e.is_dir() for e in found)  # else Spark finds the partitions
        if plain:
            return _local_files(spark, folder.rstrip("/"), suffix)
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    df = df.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source_file"), "path", "content")
    return df.where(F.lower("source_file").endswith(suffix)).withColumn("id", F.regexp_replace("source_file", r"\.[^.]*$", ""))


def text_folder(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(id, source_file, text): one row per file; bad bytes dropped, CRLF and CR as LF."""
    t = _files(spark, folder, suffix)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(text)
    return t.select("id", "source_file", unix_lines(text).alias("text"))


def strict_text_folder(spark: SparkSession, folder: str, least: int = LEAST_STRICT) -> DataFrame:
    """Files that are valid UTF-8 with at least ``least`` characters after stripping; line ends as they are."""
    return strict_texts(_files(spark, folder, ".txt"), least)


def strict_texts(files: DataFrame, least: int = LEAST_STRICT) -> DataFrame:
    """The readable rows of ``files(id, source_file, content)``; for those that are skipped see :func:`unreadable`."""
    t = files.withColumn("text", F.col("content").cast("string"))
    return t.where(F.is_valid_utf8("text") & (F.length(strip(F.col("text"))) >= least)).select("id", "source_file", "text")


def unreadable(files: DataFrame, least: int = LEAST_STRICT) -> DataFrame:
    return files.select("id").join(strict_texts(files, least).select("id"), "id", "left_anti")


def nullable_texts(ids: DataFrame, files: DataFrame, key: str = "id", least: int = LEAST_STRICT) -> DataFrame:
    """Every id with its text, null where the file is missing, unreadable or short."""
    return ids.join(strict_texts(files, least).select(key, "text"), key, "left")


def defaulted_texts(ids: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Every id with its text, empty where it is missing."""
    return ids.join(texts.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (a byte-order mark is fine); id and case name stripped; the last of several rows per id wins."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.select(*[F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("id", "case_name", "pdf_url", "saved_file", "original_filename")])
    t = raw.withColumn("_n", F.monotonically_increasing_id()).withColumns({c: strip(F.col(c)) for c in ("id", "case_name")})
    last = W.partitionBy("id").orderBy(F.desc("_n"))
    return t.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_n", "_r")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects, or JSON lines written by this engine."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def pdf_folder(spark: SparkSession, folder: str, fn=None) -> DataFrame:
    """(id, source_file, text) by a pluggable extractor; the ``.pdf`` suffix is case-sensitive."""
    from ..models import extract_pdf

    return extract_pdf(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder), fn)
