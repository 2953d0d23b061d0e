"""Work and memory that grow no faster than the input."""

from __future__ import annotations

import json
import random
import re
import time

from pyspark.sql import functions as F

from caselight.functions import chars
from caselight.functions import lexicon as lex
from caselight.operators import metrics
from caselight.plans import queries
from caselight.sources import readers, writers

DATA = "/root/testdata/sf0.001"


def test_first_prompts_work_on_no_other_text(spark):
    df = queries.queries()["prompt_first"](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = plan[next(i for i, x in enumerate(plan) if "LeftSemi" in x):]
    assert any("GlobalLimit" in x for x in below) and not any("regexp_replace" in x for x in below)
    every = queries.queries()["prompt_render"](spark, DATA).orderBy("doc_id").limit(3)
    assert df.orderBy("doc_id").collect() == every.collect()


def test_legal_patterns_take_linear_time_and_find_the_same(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["act, 1999", "act,", "a", " ", "-", "é", "7", ".", "x", "’", "code of", "rule 9", "order x rule"]) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in lex.LEGAL_BASIS:
        found = [bool(re.search(p, t, re.I)) for t in texts]
        assert [r.m for r in df.select(F.col("t").rlike(chars.java([p])).alias("m")).collect()] == found, p
    long = spark.createDataFrame([("word " * 40_000,)], "t string").select(F.col("t").rlike(chars.java(lex.LEGAL_BASIS)).alias("m"))
    began = time.perf_counter()
    assert not long.first().m and time.perf_counter() - began < 8


def test_json_array_is_written_without_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: 1 / 0)
    df = spark.range(0, 50, 1, 7).select(F.format_string("%02d", 49 - F.col("id")).alias("id"), F.lit('আ"\n').alias("t"), F.lit(None).cast("string").alias("none"))
    for some, n in ((df, 50), (df.where("false"), 0)):
        writers.write_json_array(some, f"file://{tmp_path}/a.json", "id")
        want = [{"id": f"{i:02d}", "t": 'আ"\n', "none": None} for i in range(n)]
        assert (tmp_path / "a.json").read_text(encoding="utf-8") == json.dumps(want, ensure_ascii=False, indent=2)
        assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["a.json"]


def test_text_folders_are_not_listed_by_the_driver(spark, tmp_path):
    (tmp_path / "sub.txt").mkdir()
    for i in range(300):
        (tmp_path / f"{i} +%.TXT").write_bytes(b"a\r\nb\xff%d" % i)
    for name in ("_hidden.txt", ".dot.txt", "no.md"):
        (tmp_path / name).write_bytes(b"no")
    df = readers.text_folder(spark, f"file://{tmp_path}/")
    assert not df.inputFiles()
    assert sorted((r.id, r.source_file, r.text) for r in df.collect()) == sorted((f"{i} +%", f"{i} +%.TXT", f"a\nb{i}") for i in range(300))


def test_grams_become_no_rows(spark):
    df = spark.createDataFrame([("k", "a b a b", "a b c"), ("l", None, "x")], "id string, hyp string, ref string")
    scores = metrics.bleu_scores(df)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Repartition" not in plan
    got = {r.id: r.bleu for r in scores.collect()}
    assert abs(got["k"] - metrics.sentence_bleu("a b a b", "a b c")) < 1e-9 and got["l"] == 0.0
