"""Sentences, decisions, evidence, packs, replies, references."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caselight.operators import decisions, evidence, packs, refs, sentences


@pytest.mark.parametrize("raw,want", [("a ,b", "a,b"), ("x\n\n...y", "x...y"), ("a\r\nb", "a b"), ("a\n \nb", "a\n\nb"), ("a<PARA>b", "a\n\nb"), (None, ""), ("  \t ", "")])
def test_normalize(one, raw, want):
    assert one(sentences.normalize, raw) == want


def test_decision_sentences(one):
    assert one(sentences.decision_sentences, "The rule is discharged today. Short. আবেদন খারিজ করা হইল আজকের দিনে। এই মামলার নথি ফেরত পাঠানো হউক") == [
        "The rule is discharged today.", "আবেদন খারিজ করা হইল আজকের দিনে।", "এই মামলার নথি ফেরত পাঠানো হউক"]


def test_evidence_sentences_keep_abbreviations(one):
    got = one(sentences.evidence_sentences, "The order was passed by Mr. Rahman on petition No. 5 of 2019. The second sentence is long enough too! No")
    assert got == ["The order was passed by Mr. Rahman on petition No. 5 of 2019.", "The second sentence is long enough too!"]
    assert one(sentences.evidence_sentences, "এই বাক্যটি যথেষ্ট দীর্ঘ একটি বাক্য বটে। এবং এখানে ভাঙে না কখনোই কিন্তু") is not None


@pytest.mark.parametrize("n,size", [(0, 0), (10, 20), (100, 25), (1000, 120)])
def test_tail_size(spark, n, size):
    assert spark.range(1).select(decisions.tail_size(F.lit(n)).alias("x")).first().x == size


def test_decisions_keep_last_ten(spark):
    text = " ".join(f"Appeal number {i:02d} is hereby allowed. " for i in range(12))
    r = decisions.final_decisions(spark.createDataFrame([(text,), ("",)], "text string")).collect()
    assert [s[14:16] for s in r[0].final_decision_evidence] == [f"{i:02d}" for i in range(2, 12)]
    assert (r[1].tail_sentences_examined, r[1].final_decision_evidence, r[1].decision_found) == (0, [], False)


def test_word_edges(spark):
    df = spark.createDataFrame([("the appeal was éallowed by the court",), ("this enthusiasm of the court is noted",)], "text string")
    r = decisions.final_decisions(df).collect()
    assert r[0].final_decision_evidence == [] and len(r[1].final_reasoning_evidence) == 1


def test_text_fallback(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    en = spark.createDataFrame([("a", "")], "id string, text string")
    bn = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    got = {r.id: (r.text, r.text_source) for r in decisions.text_with_fallback(ids, en, bn).collect()}
    assert got == {"a": ("", "en_clean"), "b": ("y", "bn_clean"), "c": ("", "missing")}


def ev(spark, fn, items):
    return spark.createDataFrame([(items,)], "s array<string>").select(fn(F.col("s")).alias("x")).first().x


def test_facts(spark):
    marker = "Brief facts of this are heard on Monday"
    assert ev(spark, evidence.facts, [marker] + ["heard on x"] * 5 + ["the relevant facts follow", "a", "b"]) == ["the relevant facts follow", "a", "b"]
    assert ev(spark, evidence.facts, ["z", "he was arrested there", "he was arrested there"]) == ["he was arrested there"]
    assert ev(spark, evidence.facts, []) == []
    many = ["facts of the case"] + [f"s{i}" for i in range(9)]
    assert ev(spark, evidence.facts, many) == many[:6]


def test_issues(spark):
    assert ev(spark, evidence.issues, ["whether a", "whether a", "whether a", "whether b"]) == ["whether a"]
    got = ev(spark, evidence.issues, ["x", "The question is whether it holds", "firstly a", "other", "secondly b", "n", "whether late", "Issue No. 7 z"])
    assert got == ["The question is whether it holds", "firstly a", "secondly b", "Issue No. 7 z"]
    assert ev(spark, evidence.issues, ["he submits whether x"]) == [] and ev(spark, evidence.issues, []) == []


def test_legal_basis_and_reasoning(spark):
    got = ev(spark, evidence.legal_basis, ["Under Section 51 it lies", "the Evidence Act, 1872 says", "rule is discharged under section 5", "nothing", "Under Section 51 it lies"])
    assert got == ["Under Section 51 it lies", "the Evidence Act, 1872 says"]
    s = ["we find early"] + ["pad"] * 3 + ["he submits we find", "we hold so", "Thus it is", "we hold so", "end", "end"]
    assert ev(spark, evidence.court_reasoning, s) == ["we hold so", "Thus it is"]
    assert ev(spark, evidence.court_reasoning, []) == []


def test_packs_and_prompt(spark):
    s = spark.createDataFrame([("a", True), ("b", False)], "id string, facts_inferred boolean")
    e = spark.createDataFrame([("a", ["i"], ["f"], ["l"])], "id string, legal_issue_evidence array<string>, relevant_fact_evidence array<string>, legal_basis_evidence array<string>")
    d = spark.createDataFrame([("a", ["r"], ["d"])], "id string, final_reasoning_evidence array<string>, final_decision_evidence array<string>")
    p = packs.reasoning_packs(s, e, d)
    got = {r.id: r for r in p.collect()}
    assert got["a"].court_reasoning_evidence == ["r"] and got["b"].fact_evidence == []
    t = {r.id: r.prompt for r in packs.prompts(p).collect()}
    assert "CASE ID:\na\n\nFACT EVIDENCE:\n- f\n" in t["a"] and "Evidence unavailable." in t["b"]
    assert packs.prompts(p, 1).count() == 1


@pytest.mark.parametrize("reply,want", [('so ```json\n{"a": {"b": 1}}\n``` bye', '{"a": {"b": 1}}'), ("no braces", "no braces"), ("}{", ""), ("```\n{1}\n```", "{1}"), ('x {"a": 1} y', '{"a": 1}'), ("", "")])
def test_salvage(one, reply, want):
    assert one(packs.salvage_json, reply) == want


def test_replies(spark):
    df = spark.createDataFrame([("1", '{"facts": "f", "decision": "d"}'), ("2", "[1]"), ("3", '{"facts": "cut'), ("4", None)], "id string, reply string")
    got = {r.id: r for r in packs.parse_replies(df).collect()}
    assert (got["1"].facts, got["1"].decision, got["1"].parse_error) == ("f", "d", None)
    assert got["2"].parse_error and got["3"].parse_error and got["3"].raw_output == '{"facts": "cut' and got["4"].facts == ""


def test_order_tail(one):
    assert one(refs.order_tail, " short text ") == "short text"
    body = "\n".join(["w " * 100] * 3)
    tail = "আদেশ " + "x " * 45
    assert one(refs.order_tail, body + "\n" + tail).split() == tail.split()
    long = one(refs.order_tail, "a " * 400)
    assert len(long.split()) == 250
    assert len(one(refs.order_tail, body + "\nআদেশ").split()) == 250  # the marker comes before the least number of words
