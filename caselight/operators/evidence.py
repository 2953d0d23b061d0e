"""Reasoning evidence: facts, issues, legal basis and court reasoning as array expressions over one sentence array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.chars import has_any, java, last_n, let
from .sentences import evidence_sentences


def _none() -> Column:
    return F.array().cast("array<string>")


def lowered(s: Column) -> Column:
    """(x, low) of each sentence: lower case costs more than any search in it, so all tests share it."""
    return F.transform(s, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))


def _texts(found: Column) -> Column:
    return F.transform(found, lambda e: e["x"])


def facts(s: Column) -> Column:
    return let(lowered(s), facts_of)


def facts_of(s: Column) -> Column:
    """The first marker whose window of six sentences says something, else (under three) every fact signal; six at most.

    Each sentence is looked at once; windows only read the flags, and none is built but the first that counts.
    """
    def flag(e: Column) -> Column:
        return F.struct(e["x"].alias("x"), *[has_any(e["low"], terms).alias(k) for k, terms in (("m", lex.FACT_MARKERS), ("out", lex.FACT_EXCLUDE), ("sig", lex.FACT_SIGNALS))])

    def chosen(f: Column) -> Column:
        marked = F.filter(F.transform(f, lambda e, i: F.when(e["m"], i + 1)), lambda i: i.isNotNull())
        first = F.get(F.filter(marked, lambda i: F.exists(F.slice(f, i, 6), lambda e: ~e["out"])), F.lit(0))
        a = F.coalesce(F.transform(F.filter(F.slice(f, first, 6), lambda e: ~e["out"]), lambda e: e["x"]), _none())
        b = F.transform(F.filter(f, lambda e: ~e["out"] & e["sig"]), lambda e: e["x"])
        return let(a, lambda v: F.slice(F.array_distinct(F.concat(v, F.when(F.size(v) < 3, b).otherwise(_none()))), 1, 6))

    return let(F.transform(s, flag), chosen)


def issues(s: Column) -> Column:
    return let(lowered(s), issues_of)


def issues_of(s: Column) -> Column:
    """The first marker and its followers, all numbered issues, else three ``whether`` sentences of the court; four at most."""
    at = F.array_position(F.transform(s, lambda e: has_any(e["low"], lex.ISSUE_MARKERS)), True).cast("int")
    follow = F.filter(F.slice(s, F.greatest(at, F.lit(0)) + 1, 4), lambda e: has_any(e["low"], lex.ISSUE_FOLLOWERS))
    a = F.when(at > 0, _texts(F.concat(F.slice(s, F.greatest(at, F.lit(1)), 1), follow))).otherwise(_none())
    b = _texts(F.filter(s, lambda e: has_any(e["low"], lex.ISSUE_HEADINGS)))
    ab = F.concat(a, b)
    c = _texts(F.slice(F.filter(s, lambda e: has_any(e["low"], ["whether"]) & (F.length(e["x"]) < 700) & ~has_any(e["low"], lex.ISSUE_COUNSEL)), 1, 3))
    return F.slice(F.array_distinct(F.when(F.size(ab) > 0, ab).otherwise(c)), 1, 4)


def legal_basis(s: Column) -> Column:
    return let(lowered(s), legal_basis_of)


def legal_basis_of(s: Column) -> Column:
    return F.slice(F.array_distinct(_texts(F.filter(s, lambda e: ~has_any(e["low"], lex.LEGAL_EXCLUDE) & e["low"].rlike(java(lex.LEGAL_BASIS))))), 1, 8)


def court_reasoning(s: Column) -> Column:
    return let(lowered(s), court_reasoning_of)


def court_reasoning_of(s: Column) -> Column:
    """From 35 % of the sentences on: what the court says, not counsel; the last eight."""
    n = F.size(s)
    late = F.when(n > 0, F.slice(s, F.floor(n * 0.35).cast("int") + 1, n)).otherwise(s)
    return last_n(F.array_distinct(_texts(F.filter(late, lambda e: ~has_any(e["low"], lex.COUNSEL_SIGNALS) & has_any(e["low"], lex.COURT_SIGNALS)))), 8)


COMPONENTS = {"issue": "legal_issue_evidence", "facts": "relevant_fact_evidence", "legal_basis": "legal_basis_evidence", "reasoning": "court_reasoning_evidence", "decision": "decision_evidence"}


def with_evidence(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the four evidence arrays that follow from the text: one projection over one array of sentences."""
    df = df.withColumn("_s", lowered(evidence_sentences(F.col(text))))
    return df.withColumns({
        "legal_issue_evidence": issues_of(F.col("_s")), "relevant_fact_evidence": facts_of(F.col("_s")),
        "legal_basis_evidence": legal_basis_of(F.col("_s")), "court_reasoning_evidence": court_reasoning_of(F.col("_s")),
    }).drop("_s")


def with_components(df: DataFrame) -> DataFrame:
    """Adds ``components_found`` and empties a missing ``decision_evidence``."""
    df = df.withColumn("decision_evidence", F.coalesce("decision_evidence", _none()))
    return df.withColumn("components_found", F.struct(*[(F.size(v) > 0).alias(k) for k, v in COMPONENTS.items()]))


def reasoning_evidence(df: DataFrame, decisions: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Adds the five evidence arrays and ``components_found``; documents without a decision row get no decision evidence."""
    d = decisions.select(key, F.col("final_decision_evidence").alias("decision_evidence"))
    return with_components(with_evidence(df, text).join(d, key, "left"))


def component_coverage(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(f"components_found.{k}")).alias(f"n_{k}") for k in COMPONENTS])
