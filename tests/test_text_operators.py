"""Cleaning, sections, classification: the specification rows, one by one."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselight.functions import chars
from caselight.functions import lexicon as lex
from caselight.operators import classify, clean, sections


def test_unicode_white_space(one):
    assert one(chars.word_count, "a\x1cb c d\x85e") == 5
    assert one(chars.word_count, "") == 0
    assert one(chars.strip, " \x1c a　b  ") == "a　b"
    assert one(chars.word_count, None) == 0


def test_last_n(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r.x for r in df.select(chars.last_n(F.col("a"), 8).alias("x")).collect()] == [[1, 2, 3], []]
    assert [r.x for r in df.select(chars.last_n(F.col("a"), 2).alias("x")).collect()] == [[2, 3], []]


@pytest.mark.parametrize("raw,want", [("respon-\ndent", "respondent"), ("pre- \nfix", "pre- \nfix"), ("ক-\nদ", "কদ"), ("া-\nদ", "া-\nদ"), ("a-\nb-\nc", "ab-\nc")])
def test_join_wraps(one, raw, want):
    assert one(clean.join_wraps, raw) == want


@pytest.mark.parametrize("line,junk", [("Page 3 of 12", True), ("page ৩", True), ("- 7 -", True), ("১২", True), ("12a", False), ("  ", False), ("www.x.y", True), ("High  Court Division", True)])
def test_junk(one, line, junk):
    assert one(clean.is_junk, line) is junk


def test_junk_bangla(one):
    assert one(lambda c: clean.is_junk(c, lex.JUNK_BN), "সুপ্রিম কোর্ট, ঢাকা") is True
    assert one(lambda c: clean.is_junk(c, lex.JUNK_BN), "পৃষ্ঠা ১২") is True
    assert one(lambda c: clean.is_junk(c, lex.JUNK_BN), "ঢাকা সুপ্রিম কোর্ট") is False


def _drop(c):
    return F.array_join(clean.drop_repeated(chars.lines(c)), "\n")


def test_repeated_lines(one):
    assert one(_drop, "H\na\n H\nb\nH \nH") == "a\nb"
    assert one(_drop, "H\na\nH\nH") == "H\na\nH\nH"
    assert one(_drop, "\n\n\n\n\nx") == "\n\n\n\n\nx"


def test_collapse(one):
    assert one(clean.collapse_whitespace, "a  \n\n\n\nb\n") == "a\n\nb"
    assert one(clean.collapse_whitespace, " \n ") == ""


def test_bangla_stop(one):
    assert one(clean.bangla_stops, "শেষ. আবার") == "শেষ। আবার"
    assert one(clean.bangla_stops, "C.R. No. ৫") == "C.R. No। ৫"
    assert one(clean.bangla_stops, "No. 5") == "No. 5"


def test_stray(one):
    assert one(clean.stray_english_lines, "abc ক") == 1
    assert one(clean.stray_english_lines, "abcdefg কখগ") == 0
    assert one(clean.stray_english_lines, "\n12\n") == 0


def test_nfc(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string").select(clean.nfc("t").alias("x"))
    assert [r.x for r in df.collect()] == ["é", None]


def test_reduction(one):
    assert one(lambda a, b: clean.reduction(a, b), "abcd", "abc") == 25.0
    assert one(lambda a, b: clean.reduction(a, b), "", "") == 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n-.1\x1cপ", max_size=40), min_size=8, max_size=8))
def test_cleaning_never_lengthens(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.b >= r.a for r in df.select(F.length("t").alias("b"), F.length(clean.clean_en(F.col("t"))).alias("a")).collect())


def split(spark, text):
    return sections.split_sections(spark.createDataFrame([(text,)], "text string")).first()


def test_sections(spark):
    r = split(spark, "Judgment on: x\nFacts of the case\nA\nHeard the learned Advocate\nB")
    assert (r.sections_found, r.order, r.facts, r.arguments) == (["order", "facts", "arguments"], "Judgment on: x", "Facts of the case\nA", "Heard the learned Advocate\nB")
    assert (r.confidence, r.facts_inferred) == ("high", False)


def test_facts_by_position(spark):
    r = split(spark, "Intro\nIn the result, allowed")
    assert (r.facts, r.facts_inferred, r.sections_found, r.confidence) == ("Intro", True, ["order"], "partial")
    r = split(spark, "Order\nx")
    assert (r.facts, r.facts_inferred, r.sections_found) == ("", False, ["order"])
    r = split(spark, "nothing here")
    assert (r.facts, r.sections_found, r.confidence) == ("", [], "low")
    assert split(spark, "").confidence == "low"


def test_heading_anchors_at_line_start(spark):
    assert split(spark, "The learned advocate for the petitioner spoke").sections_found == []
    assert split(spark, "learned advocate for the petitioner spoke").sections_found == ["arguments"]


def test_section_report(spark):
    df = sections.split_sections(spark.createDataFrame([(1, "Order\nx"), (2, "y"), (3, "Facts\nz")], "doc_id long, text string"))
    got = {r.confidence: r for r in sections.section_report(df).collect()}
    assert got["partial"].n_docs == 2 and got["low"].no_facts == 1
    miss = {r.section: r for r in sections.missing_samples(df).collect()}
    assert miss["arguments"].first_ids == [1, 2, 3] and miss["facts"].n_missing == 2


@pytest.mark.parametrize("name,want", [("Company Matter (TN) 709/2026", "Company Matter (TN)"), ("Appeal", "Appeal"), ("", "Unknown"), (None, "Unknown"), ("Writ  Petition 55", "Writ  Petition"), ("Misc-Case 5", "Misc-Case 5")])
def test_case_type(one, name, want):
    assert one(classify.case_type, name) == want


def test_classify_defaults(spark):
    docs = spark.createDataFrame([("a", "w " * 300), ("b", "w " * 299)], "id string, text string")
    meta = spark.createDataFrame([("a", "Appeal 5")], "id string, case_name string")
    struct = spark.createDataFrame([("a", ["facts"])], "id string, sections_found array<string>")
    got = {r.id: r for r in classify.classify(docs, meta, struct).collect()}
    assert (got["a"].doc_type, got["a"].case_type, got["a"].facts_found) == ("full_judgment", "Appeal", True)
    assert (got["b"].doc_type, got["b"].case_type, got["b"].facts_found) == ("short_order", "Unknown", False)
