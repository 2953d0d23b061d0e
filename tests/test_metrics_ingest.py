"""Scores and ingest."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caselight import models
from caselight.operators import ingest, metrics


def pairs(spark, hyp, ref):
    return spark.createDataFrame([("1", "t", "m", hyp, ref)], "id string, case_type string, model string, hyp string, ref string")


def test_rouge(spark):
    r = metrics.rouge_n(pairs(spark, "a a b", "a b b"), 1).first()
    assert r.rouge1_p == r.rouge1_r == pytest.approx(2 / 3) and r.rouge1_f == pytest.approx(2 / 3)
    assert metrics.rouge_n(pairs(spark, "a a b", "a b b"), 2).first().rouge2_f == pytest.approx(0.5)
    assert metrics.rouge_n(pairs(spark, "a", "b"), 2).first().rouge2_f == 0.0


def test_lcs_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert metrics.lcs_length(a, b) == t[-1][-1]


def test_rouge_l_and_bleu(spark):
    r = pairs(spark, "the cat sat", "the cat is on the mat").select(metrics.rouge_l("hyp", "ref").alias("l"), metrics.bleu("hyp", "ref").alias("b")).first()
    assert r.l == pytest.approx(2 * (2 / 3) * (2 / 6) / (2 / 3 + 2 / 6))
    assert 0 < r.b < 100
    assert metrics.sentence_bleu("a b c d e", "a b c d e") == pytest.approx(100.0)
    assert metrics.sentence_bleu("x y", "a b") == 0.0 and metrics.sentence_bleu("", "a") == 0.0
    assert metrics.bleu_tokens("Hello, 1,000.5 world.") == ["Hello", ",", "1,000.5", "world", "."]


def test_content_and_factual(spark):
    df = spark.createDataFrame([("(৫) ab abc, 1.5 abc",)], "t string")
    assert df.select(metrics.content_tokens(F.col("t")).alias("x")).first().x == ["৫", "abc", "1.5"]
    p = spark.createDataFrame([("1", "alpha beta", "alpha gamma", "alpha beta"), ("2", "a", "alpha", "alpha"), ("3", "alpha", "a", "alpha"), ("4", "alpha", "alpha", None)], "id string, hyp string, ref string, source string")
    got = {r.id: (r.factual_precision, r.factual_recall, r.factual_f1) for r in metrics.factual_scores(p).collect()}
    assert got == {"1": (1.0, 0.5, pytest.approx(2 / 3)), "2": (0.0, 0.0, 0.0), "3": (1.0, 0.0, 0.0)}


def test_greedy_match(spark):
    t = spark.createDataFrame([(1, "hyp", 1, [1.0, 0.0]), (1, "ref", 2, [2.0, 0.0]), (1, "ref", 3, [0.0, 1.0])], "pair_id long, side string, tok long, vec array<float>")
    r = metrics.greedy_match(t).first()
    assert (r.p, r.r) == (pytest.approx(1.0), pytest.approx(0.5))


def test_scoring_join(spark):
    refs = spark.createDataFrame([("1", "c", "ref"), ("2", "c", " "), ("3", "c", "ref")], "id string, case_type string, reference_summary_bn string")
    hyps = models.summarize(spark.createDataFrame([("1", "text here"), ("2", "x"), ("3", " ")], "id string, text string"))
    p = metrics.scoring_pairs(refs, hyps)
    assert [r.id for r in p.collect()] == ["1"]
    assert sorted(r.id for r in metrics.skipped(refs, p).collect()) == ["2", "3"]
    scores = metrics.evaluate(p)
    assert scores.first().hyp_len_words == 2 and metrics.averages(scores, ["bleu"]).first().bleu == 0.0


def test_links(spark):
    html = '<a href="/resources/documents/a.pdf"> One <b>x</b> </a><A HREF=\'b.html\'>no</A><a class="c" href="../resources/documents/B.PDF">Two</a><a href="">e</a>'
    pages = spark.createDataFrame([(1, html), (2, html), (3, None)], "page_id long, html string")
    assert ingest.anchors(pages).count() == 8
    got = [tuple(r) for r in ingest.harvest(pages).orderBy("id").collect()]
    assert got == [
        ("J00001", "One x", "https://supremecourt.gov.bd/resources/documents/a.pdf", "J00001.pdf", "a.pdf"),
        ("J00002", "Two", "https://supremecourt.gov.bd/resources/documents/B.PDF", "J00002.pdf", "B.PDF"),
    ]
    failed = spark.createDataFrame([("https://supremecourt.gov.bd/resources/documents/a.pdf",)], "pdf_url string")
    assert [r.id for r in ingest.harvest(pages, failed=failed).collect()] == ["J00001"]


@pytest.mark.parametrize("href", ["a.pdf", "/x/y", "../q/./r.pdf", "../../../up", "//cdn.test/z", "http://h/p", "mailto:x", "x/../y"])
def test_resolve_agrees_with_the_standard_library(one, href):
    from urllib.parse import urljoin

    assert one(ingest.resolve, href) == urljoin(ingest.BASE, href)


def test_chunks(spark, one):
    assert one(lambda c: ingest.chunks(c, 3), "abcdefg") == ["abc", "def", "g"]
    assert one(lambda c: ingest.chunks(c, 3), "") == []
    d = spark.createDataFrame([("1", "abcdefg"), ("2", "")], "id string, text string")
    got = {r.id: r.translated for r in ingest.translate_chunks(d, models.identity, size=3).collect()}
    assert got == {"1": "abc\ndef\ng", "2": ""}


def test_dense_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = ingest.dense_ids(df, ["k"]).orderBy("k").collect()
    assert [r.id for r in got] == [f"J{i + 1:05d}" for i in range(1000)]


def test_dense_ids_at_size(spark):
    df = spark.range(400_000).select(((F.col("id") * 7919) % 400_009).alias("page"), F.col("id").alias("pos"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = ingest.dense_ids(df, ["page", "pos"], 6).agg(F.count_distinct("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    assert (got.n, got.a, got.b) == (400_000, "J000001", "J400000")


def test_bleu_columns_equal_the_plain_form(spark):
    rows = [(1, "the cat sat", "the cat is on the mat"), (2, "a b c d e", "a b c d e"), (3, "x y", "a b"), (4, "Hello, 1,000.5 world", "Hello 1,000.5 world."), (6, "", "a"), (7, "a a a a", "a b a")]
    got = {r.id: r.bleu for r in metrics.bleu_scores(spark.createDataFrame(rows, "id long, hyp string, ref string")).collect()}
    assert got == {i: pytest.approx(metrics.sentence_bleu(h, r)) for i, h, r in rows}
