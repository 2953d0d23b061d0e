"""DuckDB forms of the reader, sink, lookup and model-seam queries."""

from __future__ import annotations

from .enrich import CTE, CTE_LISTINGS, FILE_BN, HAS_DECISION, HAS_EVIDENCE, SUMMARY_INPUT


def more_sql(o) -> dict[str, str]:
    """``o`` is the module of the other forms, whose helpers these use."""
    e = f"WITH {CTE} "
    packs = ", ".join(
        f"CASE WHEN {has} THEN coalesce({c}, '-') ELSE '' END AS {name}"
        for has, c, name in (
            (HAS_EVIDENCE, "source", "legal_issue_evidence"), (HAS_EVIDENCE, "lang", "fact_evidence"), (HAS_EVIDENCE, "case_name", "legal_basis_evidence"),
            (HAS_DECISION, "case_name", "court_reasoning_evidence"), (HAS_DECISION, "source", "court_decision_evidence"),
        )
    )
    return {
        "listing_walk": f"WITH {CTE_LISTINGS}, w AS (SELECT a.*, coalesce(contains(a.html, 'Next') AND b.html <> a.html, false) AS go FROM ls a LEFT JOIN ls b ON a.listing = b.listing AND b.page_no = a.page_no + 1), "
        "e AS (SELECT listing, min(page_no) AS f, min(page_no) FILTER (NOT go) AS stop FROM w GROUP BY listing) SELECT page_id, listing, page_no FROM ls JOIN e USING (listing) WHERE page_no <= least(stop, f + 4)",
        "fetch_pages": "SELECT DISTINCT url, CASE WHEN length(url) % 7 <> 0 THEN '<p>' || url || '</p>' END AS body, CASE WHEN length(url) % 7 = 0 THEN 'TimeoutError' END AS error FROM pages WHERE url IS NOT NULL",
        "strict_lookup": f"SELECT doc_id, CASE WHEN lang <> 'en' AND length({o.strip('text')}) >= 200 THEN md5(text) END AS text_md5 FROM documents",
        "default_lookup": e + f"SELECT doc_id, {o.digest('t', 'text')} FROM (SELECT doc_id, coalesce({FILE_BN}, '') AS t FROM enr)",
        "fallback_lookup": f"WITH {CTE}, {o.DECIDED} SELECT doc_id, text_source, CASE WHEN text_source = 'missing' THEN '' ELSE md5(t) END AS text_md5 FROM dec_a",
        "metrics_table": "SELECT doc_id, lang, round(length(text) / 7.0::DOUBLE, 6) AS csv_score, round(length(text) / 7.0::DOUBLE, 6) AS json_score FROM documents",
        "checkpoint_rows": "SELECT doc_id, source FROM documents",
        "pack_join": e + f"SELECT doc_id, lang IS NULL AS facts_inferred, {packs} FROM enr",
        "evidence_join": f"SELECT doc_id, CASE WHEN {HAS_DECISION} THEN coalesce(source, '') ELSE '' END AS decision_evidence, {HAS_DECISION} AS found FROM documents",
        "summarize_texts": e + f"SELECT doc_id, 'five' AS model, array_to_string(w[1:5], ' ') AS summary_bn FROM (SELECT doc_id, {o.words(SUMMARY_INPUT)} AS w FROM enr) WHERE len(w) > 0",
        "generate_replies": e + "SELECT doc_id, CASE WHEN n % 4 = 0 THEN '' ELSE n || ' characters' END AS facts, CASE WHEN n % 4 = 0 THEN '' ELSE repeat('x', n % 3) END AS decision, n % 4 = 0 AS failed FROM (SELECT doc_id, length('Explain ' || case_name) AS n FROM enr)",
        "pdf_texts": f"SELECT doc_id, doc_id || '.pdf' AS source_file, {o.digest('t', 'text')} FROM (SELECT doc_id, substr(text, 1, 200) AS t FROM documents WHERE text IS NOT NULL)",
    }
