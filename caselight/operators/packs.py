"""Evidence packs, prompts and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.chars import strip

FALLBACK_ERROR = "reply is not a JSON object"


def reasoning_packs(structured: DataFrame, evidence: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """One pack per structured row. Reasoning in a pack is the decision step's, not the evidence step's."""
    e = evidence.select(key, "legal_issue_evidence", F.col("relevant_fact_evidence").alias("fact_evidence"), "legal_basis_evidence")
    d = decisions.select(key, F.col("final_reasoning_evidence").alias("court_reasoning_evidence"), F.col("final_decision_evidence").alias("court_decision_evidence"))
    none = F.array().cast("array<string>")
    arrays = ["legal_issue_evidence", "fact_evidence", "legal_basis_evidence", "court_reasoning_evidence", "court_decision_evidence"]
    keep = [c for c in (key, "source_file") if c in structured.columns]
    out = structured.select(*keep, F.coalesce("facts_inferred", F.lit(False)).alias("facts_inferred")).join(e, key, "left").join(d, key, "left")
    return out.select(*keep, "facts_inferred", *[F.coalesce(a, none).alias(a) for a in arrays])


def packed(rows: DataFrame, has_evidence: Column, has_decisions: Column, key: str = "id") -> DataFrame:
    """The same packs where one row holds what the three relations say; the flags tell which of them have a row."""
    none = F.array().cast("array<string>")
    take = lambda flag, c: F.coalesce(F.when(flag, F.col(c)), none)
    keep = [c for c in (key, "source_file") if c in rows.columns]
    return rows.select(
        *keep, F.coalesce("facts_inferred", F.lit(False)).alias("facts_inferred"), take(has_evidence, "legal_issue_evidence").alias("legal_issue_evidence"),
        take(has_evidence, "relevant_fact_evidence").alias("fact_evidence"), take(has_evidence, "legal_basis_evidence").alias("legal_basis_evidence"),
        take(has_decisions, "final_reasoning_evidence").alias("court_reasoning_evidence"), take(has_decisions, "final_decision_evidence").alias("court_decision_evidence"),
    )


def bullets(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "Evidence unavailable.").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def prompt(key: str = "id") -> Column:
    parts = [F.lit(lex.PROMPT_HEAD), F.col(key).cast("string")]
    for head, name in lex.PROMPT_BLOCKS:
        parts += [F.lit(head), bullets(F.col(name))]
    return F.concat(*parts, F.lit(lex.PROMPT_TAIL))


def prompts(packs: DataFrame, limit: int | None = 3, key: str = "id") -> DataFrame:
    """Prompts of the first ``limit`` packs by key (None: all)."""
    p = packs if limit is None else packs.orderBy(key).limit(limit)
    return p.select(key, prompt(key).alias("prompt"))


def salvage_json(reply: Column) -> Column:
    """The fenced part of a reply, from its first ``{`` to its last ``}``."""
    s = strip(reply)

    def fenced(mark: str) -> Column:
        rest = F.substring(s, F.instr(s, mark) + len(mark), F.length(s))
        return F.substring_index(rest, "```", 1)

    t = strip(F.when(F.instr(s, "```json") > 0, fenced("```json")).when(F.instr(s, "```") > 0, fenced("```")).otherwise(s))
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1
    return F.when((start > 0) & (F.instr(t, "}") > 0), F.substring(t, start, F.greatest(end - start + 1, F.lit(0)))).otherwise(t)


def parse_replies(replies: DataFrame, reply: str = "reply", key: str = "id") -> DataFrame:
    """Six fields per reply; empty ones with ``raw_output`` and ``parse_error`` where it is no JSON object."""
    schema = ", ".join(f"{f} string" for f in lex.EXPLANATION_FIELDS) + ", _bad string"
    t = replies.withColumn("_j", salvage_json(F.col(reply)))
    t = t.withColumn("_p", F.from_json("_j", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.coalesce(F.col("_j").startswith("{") & F.col("_p").isNotNull() & F.col("_p._bad").isNull(), F.lit(False))
    fields = [F.when(ok, F.col(f"_p.{f}")).otherwise(F.lit("")).alias(f) for f in lex.EXPLANATION_FIELDS]
    return t.select(key, *fields, F.when(~ok, F.col(reply)).alias("raw_output"), F.when(~ok, F.lit(FALLBACK_ERROR)).alias("parse_error"))
