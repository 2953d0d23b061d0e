"""Readers, writers, model seam, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from caselight import models
from caselight.sources import readers, writers
from caselight.streaming import stream


def test_text_folders(spark, tmp_path):
    (tmp_path / "b.TXT").write_bytes(b"line\r\nnext\rlast")
    (tmp_path / "a b.txt").write_bytes(b"ok \xff bad")
    (tmp_path / "long.txt").write_bytes(b"x" * 200 + b"\r\n")
    (tmp_path / "c.md").write_bytes(b"no")
    got = {r.id: r.text for r in readers.text_folder(spark, str(tmp_path)).collect()}
    assert got["b"] == "line\nnext\nlast" and got["a b"] == "ok  bad" and "c" not in got
    strict = {r.id: r.text for r in readers.strict_text_folder(spark, str(tmp_path)).collect()}
    assert list(strict) == ["long"] and strict["long"].endswith("\r\n")
    files = readers._files(spark, str(tmp_path), ".txt")
    assert sorted(r.id for r in readers.unreadable(files).collect()) == ["a b", "b"]
    ids = spark.createDataFrame([("long",), ("zz",)], "id string")
    assert {r.id: r.text is None for r in readers.nullable_texts(ids, files).collect()} == {"long": False, "zz": True}
    assert {r.id: r.text[:1] for r in readers.defaulted_texts(ids, readers.text_folder(spark, str(tmp_path))).collect()} == {"long": "x", "zz": ""}


def test_metadata_csv(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("﻿id,case_name,original_filename,pdf_url,saved_file\n J1 , Appeal 5 ,o,u,s\nJ1,Appeal 6,o,u,s\n", encoding="utf-8")
    rows = readers.metadata_csv(spark, str(f)).collect()
    assert [(r.id, r.case_name, r.pdf_url) for r in rows] == [("J1", "Appeal 6", "u")]


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "case_type": "আপিল", "word_count": 3, "doc_type": "x", "facts_found": true}]', encoding="utf-8")
    df = readers.json_array(spark, str(tmp_path / "a.json"), readers.CLASSIFICATION)
    writers.write_metrics(df, str(tmp_path / "out"))
    assert spark.read.schema(readers.CLASSIFICATION).json(str(tmp_path / "out/json")).first() == df.first()
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).first().case_type == "আপিল"
    writers.write_texts(df.select("id", F.col("case_type").alias("text")), str(tmp_path / "t"))
    writers.export_text_files(df, str(tmp_path / "files"), text="case_type")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and (tmp_path / "files/1.txt").read_text(encoding="utf-8") == "আপিল"


def test_model_seam(spark, tmp_path):
    def upper(parts):
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "summary_bn": p["text"].str.upper()})

    df = spark.createDataFrame([("1", "abc"), ("2", "  ")], "id string, text string")
    assert [tuple(r) for r in models.summarize(df, fn=upper, model="u").collect()] == [("1", "u", "ABC")]
    assert models.generate(df.select("id", F.col("text").alias("prompt"))).count() == 2
    (tmp_path / "x.pdf").write_bytes(b"page text")
    assert readers.pdf_folder(spark, str(tmp_path)).first().text == "page text"


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Page 3\nhello there\n\n\n\nend", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream.start(stream.cleaned(stream.text_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    r = spark.read.json(str(tmp_path / "out")).first()
    assert (r.text, r.word_count, r.doc_type) == ("hello there\n\nend", 3, "short_order")


def test_stream_links_once(spark, tmp_path):
    html = '<a href="/resources/documents/a.pdf">A</a>' * 3
    spark.createDataFrame([(1, html), (2, html)], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema("page_id long, html string").parquet(str(tmp_path / "in"))
    stream.start(stream.new_links(pages), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 1
