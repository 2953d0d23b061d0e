"""DuckDB forms of the registered queries, built from the same lexicons and the same enriched view.

RE2 has no lookaround and DuckDB's list functions differ from Spark's, so each form is written for it, not translated.
"""

from __future__ import annotations

import sys

from ..functions import lexicon as lex
from ..functions.chars import WORD, WS_RE2, re2
from ..operators.packs import FALLBACK_ERROR
from .enrich import CTE, CTE_PAGES
from .oracles_io import more_sql

SEP = " ¦ "


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(f'^{WS_RE2}+')}, ''), {q(f'{WS_RE2}+$')}, '')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'{WS_RE2}+$')}, '')"


def gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to if to.startswith('chr(') else q(to)}, 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'{WS_RE2}+')}), lambda zw: zw <> '')"


def n_words(x: str) -> str:
    return f"len({words(f'coalesce({x}, {q("")})')})"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def join(x: str, sep: str = "chr(10)") -> str:
    return f"array_to_string({x}, {sep})"


def digest(x: str, name: str) -> str:
    return f"md5({x}) AS {name}_md5, length({x}) AS {name}_len"


def matches(x: str, patterns) -> str:
    return f"regexp_matches({x}, {q(re2(patterns))})"


def contains_any(x: str, terms: list[str]) -> str:
    return f"regexp_matches(lower({x}), {q('|'.join(t.replace('.', chr(92) + '.') for t in terms))})"


def last_n(x: str, n: str) -> str:
    return f"list_slice({x}, greatest(len({x}) - ({n}) + 1, 1), len({x}))"


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda zd, zi: list_position({x}, zd) = zi)"


def drop_junk(x: str, patterns) -> str:
    s = strip("zj")
    return f"list_filter({x}, lambda zj: NOT ({s} <> '' AND {matches(s, patterns)}))"


def drop_repeated(x: str, stripped: str) -> str:
    return f"list_filter({x}, lambda zl: {strip('zl')} = '' OR len(list_filter({stripped}, lambda zy: zy = {strip('zl')})) < 4)"


def n_repeated(stripped: str) -> str:
    return f"len(list_distinct(list_filter({stripped}, lambda zx: zx <> '' AND len(list_filter({stripped}, lambda zy: zy = zx)) >= 4)))"


def strip_all(x: str) -> str:
    return f"list_transform({x}, lambda zs: {strip('zs')})"


def join_wraps(x: str) -> str:
    return gsub(x, f"({WORD})-\n({WORD})", r"\1\2")


def collapse(x: str) -> str:
    return strip(gsub(join(f"list_transform({lines(x)}, lambda zr: {rstrip('zr')})"), "\n{3,}", "\n\n"))


def bangla_stops(x: str) -> str:
    return gsub(x, rf"\.({WS_RE2}+)([\x{{0980}}-\x{{09FF}}])", r"।\1\2")


def stray(x: str) -> str:
    both = "length(regexp_replace(zt, '[^A-Za-z\\x{0980}-\\x{09ff}]', '', 'g'))"
    latin = "length(regexp_replace(zt, '[^A-Za-z]', '', 'g'))"
    return f"len(list_filter({lines(x)}, lambda zt: {both} > 0 AND {latin} / greatest({both}, 1) > 0.7))"


def doc_type(n: str) -> str:
    return f"CASE WHEN {n} < 300 THEN 'short_order' ELSE 'full_judgment' END"


def case_type(x: str) -> str:
    s = strip(x)
    rx = q(f"^([A-Za-z.(){WS_RE2[1:-1]}]+?){WS_RE2}*\\p{{Nd}}")
    return f"CASE WHEN {s} = '' THEN 'Unknown' WHEN regexp_matches({s}, {rx}) THEN {strip(f'regexp_extract({s}, {rx}, 1)')} ELSE {s} END"


def cleaned(source: str, column: str, junk, name: str) -> str:
    """CTEs ``name``(doc_id, raw, kept, ss, c): the steps of a clean-up."""
    return (
        f"{name}_a AS (SELECT doc_id, {column} AS raw, {drop_junk(lines(join_wraps(source)), junk)} AS kept FROM enr), "
        f"{name}_b AS (SELECT *, {strip_all('kept')} AS ss FROM {name}_a), "
        f"{name} AS (SELECT doc_id, raw, ss, {collapse(join(drop_repeated('kept', 'ss')))} AS c FROM {name}_b)"
    )


def reduction(raw: str, c: str) -> str:
    return f"round(CASE WHEN length({raw}) > 0 THEN 100.0::DOUBLE * (1.0::DOUBLE - length({c})::DOUBLE / length({raw})::DOUBLE) ELSE 0.0 END, 6)"


# Sections -----------------------------------------------------------------------------------------------------------
_names = list(lex.SECTIONS)


def _at(k: str) -> str:
    rx = q(re2(["^(?:" + "|".join(p for p in lex.SECTIONS[k]) + ")"]))
    return f"nullif(coalesce(list_position(list_transform(ss, lambda zx: zx <> '' AND regexp_matches(zx, {rx})), true), 0), 0) - 1"


def _piece(i: int, k: str) -> str:
    later = f"list_filter(found, lambda zf: zf.a > at_{k} OR (zf.a = at_{k} AND zf.r > {i}))"
    end = f"coalesce({later}[1].a, len(ls))"
    return f"CASE WHEN at_{k} IS NULL THEN '' ELSE {strip(join(f'ls[at_{k} + 1:{end}]'))} END"


_structs = ", ".join(f"{{'a': at_{k}, 'r': {i}, 'n': '{k}'}}" for i, k in enumerate(_names))
SPLIT = (
    f"sec_a AS (SELECT doc_id, {lines('text_en')} AS ls, {strip_all(lines('text_en'))} AS ss FROM enr), "
    f"sec_b AS (SELECT *, {', '.join(f'{_at(k)} AS at_{k}' for k in _names)} FROM sec_a), "
    f"sec_c AS (SELECT *, list_sort(list_filter([{_structs}], lambda zf: zf.a IS NOT NULL)) AS found FROM sec_b), "
    f"sec_d AS (SELECT *, CASE WHEN at_facts IS NULL AND len(found) > 0 THEN {strip(join('ls[1:found[1].a]'))} ELSE '' END AS before FROM sec_c), "
    "sec AS (SELECT doc_id, at_facts, at_arguments, at_order, before <> '' AS facts_inferred, list_transform(found, lambda zf: zf.n) AS sections_found, "
    f"CASE WHEN len(found) = 3 THEN 'high' WHEN len(found) > 0 THEN 'partial' ELSE 'low' END AS confidence, "
    f"CASE WHEN at_facts IS NULL THEN before ELSE {_piece(0, 'facts')} END AS facts, {_piece(1, 'arguments')} AS arguments, {_piece(2, 'order')} AS \"order\" FROM sec_d)"
)

# Sentences ----------------------------------------------------------------------------------------------------------


def normalize(x: str) -> str:
    t = gsub(f"coalesce({x}, '')", "\r\n?", "chr(10)")
    t = gsub(t, f"\n{WS_RE2}*\n+", "<PARA>")
    t = gsub(gsub(t, "\n+", " "), "[ \t]+", " ")
    t = gsub(t, "<PARA>", "\n\n")
    return strip(gsub(t, f"{WS_RE2}+([,.;:!?])", r"\1"))


def sentences_d(x: str) -> str:
    t = gsub(gsub(normalize(x), f"([.!?।]){WS_RE2}+", "\\1\x01"), "\n+", "\x01")
    return f"list_filter({strip_all(f'string_split({t}, chr(1))')}, lambda zk: length(zk) >= 25)"


def sentences_e(x: str) -> str:
    t = normalize(x)
    for a in lex.ABBREVIATIONS:
        t = f"replace({t}, '{a}', '{a[:-1]}<prd>')"
    t = gsub(gsub(t, f"([.!?]){WS_RE2}+", "\\1\x01"), "\n\n+", "\x01")
    s = strip("replace(zs, '<prd>', '.')")
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda zs: {s}), lambda zk: length(zk) >= 35)"


DECIDED = (
    "dec_a AS (SELECT doc_id, CASE WHEN doc_id % 6 <> 5 THEN text_en WHEN doc_id % 12 <> 11 THEN text_bn ELSE '' END AS t, "
    "CASE WHEN doc_id % 6 <> 5 THEN 'en_clean' WHEN doc_id % 12 <> 11 THEN 'bn_clean' ELSE 'missing' END AS text_source FROM enr), "
    f"dec_b AS (SELECT doc_id, text_source, {sentences_d('t')} AS s FROM dec_a), "
    "dec_c AS (SELECT *, CASE WHEN len(s) = 0 THEN 0 ELSE least(greatest(20, floor(len(s) * 0.25)), 120) END::BIGINT AS size FROM dec_b), "
    f"dec_d AS (SELECT *, {last_n('s', 'greatest(size, 1)')} AS tail FROM dec_c), "
    f"dec_e AS (SELECT *, list_filter(tail, lambda zs: {matches('zs', lex.REASONING)}) AS re, list_filter(tail, lambda zs: {matches('zs', lex.DECISION)}) AS de FROM dec_d), "
    f"dec AS (SELECT doc_id, text_source, size, {last_n('re', '8')} AS re, {last_n('de', '10')} AS de FROM dec_e)"
)

_not_out = f"NOT {contains_any('zx', lex.FACT_EXCLUDE)}"
_none = "[]::VARCHAR[]"
FACTS_A = (
    f"coalesce(list_filter(list_transform(list_filter(range(1, len(s) + 1), lambda zi: {contains_any('s[zi]', lex.FACT_MARKERS)}), "
    f"lambda zm: list_filter(s[zm:zm + 5], lambda zx: {_not_out})), lambda zw: len(zw) > 0)[1], {_none})"
)
EVIDENT = (
    f"ev_a AS (SELECT doc_id, {sentences_e('text_en')} AS s FROM enr), "
    f"ev_b AS (SELECT *, {FACTS_A} AS fa, list_filter(s, lambda zx: {_not_out} AND {contains_any('zx', lex.FACT_SIGNALS)}) AS fb, "
    f"coalesce(list_position(list_transform(s, lambda zx: {contains_any('zx', lex.ISSUE_MARKERS)}), true), 0) AS ip, "
    f"list_filter(s, lambda zx: {contains_any('zx', lex.ISSUE_HEADINGS)}) AS ib, "
    f"list_filter(s, lambda zx: {contains_any('zx', ['whether'])} AND length(zx) < 700 AND NOT {contains_any('zx', lex.ISSUE_COUNSEL)})[1:3] AS ic, "
    f"list_filter(s, lambda zx: NOT {contains_any('zx', lex.LEGAL_EXCLUDE)} AND {matches('lower(zx)', lex.LEGAL_BASIS)}) AS la, "
    f"list_filter(s[floor(len(s) * 0.35)::BIGINT + 1:len(s)], lambda zx: NOT {contains_any('zx', lex.COUNSEL_SIGNALS)} AND {contains_any('zx', lex.COURT_SIGNALS)}) AS ra FROM ev_a), "
    f"ev_c AS (SELECT *, list_concat(fa, CASE WHEN len(fa) < 3 THEN fb ELSE {_none} END) AS f, "
    f"list_concat(CASE WHEN ip > 0 THEN list_concat(s[ip:ip], list_filter(s[ip + 1:ip + 4], lambda zx: {contains_any('zx', lex.ISSUE_FOLLOWERS)})) ELSE {_none} END, ib) AS iab FROM ev_b), "
    "ev_d AS (SELECT *, CASE WHEN len(iab) > 0 THEN iab ELSE ic END AS iss FROM ev_c), "
    f"ev_e AS (SELECT doc_id, {distinct('f')}[1:6] AS facts, {distinct('iss')}[1:4] AS issues, {distinct('la')}[1:8] AS legal, {distinct('ra')} AS rd FROM ev_d), "
    f"ev AS (SELECT doc_id, facts, issues, legal, {last_n('rd', '8')} AS reasoning FROM ev_e)"
)

PACKS = (
    "pk AS (SELECT s.doc_id, s.facts_inferred, "
    f"coalesce(e.issues, {_none}) AS legal_issue_evidence, coalesce(e.facts, {_none}) AS fact_evidence, coalesce(e.legal, {_none}) AS legal_basis_evidence, "
    f"coalesce(d.re, {_none}) AS court_reasoning_evidence, coalesce(d.de, {_none}) AS court_decision_evidence "
    "FROM sec s LEFT JOIN (SELECT * FROM ev WHERE doc_id % 17 <> 3) e USING (doc_id) LEFT JOIN dec d USING (doc_id))"
)


def bullets(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 'Evidence unavailable.' ELSE {join(f'list_transform({x}, lambda zb: {q("- ")} || zb)')} END"


def _prompt() -> str:
    parts = [q(lex.PROMPT_HEAD), "doc_id::VARCHAR"]
    for head, name in lex.PROMPT_BLOCKS:
        parts += [q(head), bullets(name)]
    return " || ".join(parts + [q(lex.PROMPT_TAIL)])


def salvage(x: str) -> str:
    s = strip(x)

    def fenced(mark: str) -> str:
        return f"string_split(substr({s}, instr({s}, '{mark}') + {len(mark)}), '```')[1]"

    return strip(f"CASE WHEN contains({s}, '```json') THEN {fenced('```json')} WHEN contains({s}, '```') THEN {fenced('```')} ELSE {s} END")


SALVAGED = (
    f"sv_a AS (SELECT doc_id, reply, {salvage('reply')} AS t FROM enr), "
    "sv AS (SELECT doc_id, reply, CASE WHEN contains(t, '{') AND contains(t, '}') THEN substr(t, instr(t, '{'), greatest(length(t) - instr(reverse(t), '}') + 1 - instr(t, '{') + 1, 0)) ELSE t END AS json FROM sv_a)"
)

# Proxy references and scores ----------------------------------------------------------------------------------------
_markers = "|".join(lex.ORDER_MARKERS)
REFS = (
    f"rf_a AS (SELECT doc_id, text_bn AS t, list_filter({lines('text_bn')}, lambda zp: {strip('zp')} <> '') AS ps FROM enr), "
    "rf_b AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM rf_a), "
    f"rf_c AS (SELECT *, sum({n_words('p')}) OVER (PARTITION BY doc_id ORDER BY i DESC) AS cum FROM rf_b), "
    f"rf_d AS (SELECT *, (cum >= 40 AND regexp_matches(p, '{_markers}')) OR cum >= 250 AS stop FROM rf_c), "
    "rf_e AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM rf_d), "
    f"rf_f AS (SELECT doc_id, {strip('string_agg(p, chr(10) ORDER BY i)')} AS proxy FROM rf_e WHERE NOT past GROUP BY doc_id), "
    f"rf AS (SELECT a.doc_id, CASE WHEN {n_words('t')} <= 250 THEN {strip('t')} WHEN {n_words('proxy')} > 250 THEN array_to_string({last_n(words('proxy'), '250')}, ' ') ELSE coalesce(proxy, '') END AS ref, "
    f"coalesce(c.case_type, 'Unknown') AS case_type FROM rf_a a LEFT JOIN rf_f USING (doc_id) LEFT JOIN (SELECT doc_id, {case_type('case_name')} AS case_type FROM enr WHERE doc_id % 10 <> 9) c USING (doc_id))"
)
PAIRS = (
    REFS + f", hy AS (SELECT doc_id, array_to_string({words('text_bn')}[1:30], ' ') AS hyp FROM enr WHERE doc_id % 9 <> 4 AND len({words('text_bn')}) > 0), "
    f"pr AS (SELECT doc_id, ref, hyp FROM rf JOIN hy USING (doc_id) WHERE {strip('ref')} <> '' AND {strip('hyp')} <> '')"
)


def _grams(n: int) -> str:
    def side(col: str) -> str:
        w = words(col)
        return f"SELECT doc_id, unnest(list_transform(range(1, len({w}) - {n - 1} + 1), lambda zi: array_to_string(({w})[zi:zi + {n - 1}], ' '))) AS g FROM pr"

    return (
        f"h{n} AS (SELECT doc_id, g, count(*) AS a FROM ({side('hyp')}) GROUP BY ALL), r{n} AS (SELECT doc_id, g, count(*) AS b FROM ({side('ref')}) GROUP BY ALL), "
        f"o{n} AS (SELECT doc_id, sum(least(coalesce(a, 0), coalesce(b, 0)))::DOUBLE AS o, sum(coalesce(a, 0))::DOUBLE AS nh, sum(coalesce(b, 0))::DOUBLE AS nr FROM h{n} FULL JOIN r{n} USING (doc_id, g) GROUP BY doc_id), "
        f"s{n} AS (SELECT doc_id, CASE WHEN nh > 0 THEN o / nh ELSE 0 END AS p, CASE WHEN nr > 0 THEN o / nr ELSE 0 END AS r FROM o{n}), "
        f"f{n} AS (SELECT pr.doc_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r, CASE WHEN coalesce(p + r, 0) > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr LEFT JOIN s{n} USING (doc_id))"
    )


_edge = "[" + "".join("\\" + c if c in "[]()-.{}" else c for c in lex.EDGE_PUNCTUATION) + "]+"


def content(x: str) -> str:
    t = f"list_transform({words(x)}, lambda zc: regexp_replace(regexp_replace(zc, {q('^' + _edge)}, ''), {q(_edge + '$')}, ''))"
    return f"list_distinct(list_filter({t}, lambda zn: length(zn) >= 3 OR regexp_full_match(zn, {q(lex.NUMERIC)})))"


# Links --------------------------------------------------------------------------------------------------------------
_anchor = q(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)["']?[^>]*>(.*?)</a>""")
ANCHORS = (
    f"an_a AS (SELECT page_id, regexp_extract_all(html, {_anchor}, 1) AS hs, regexp_extract_all(html, {_anchor}, 2) AS bs FROM pg), "
    + "an_b AS (SELECT page_id, unnest(range(0, len(hs))) AS pos, unnest(hs) AS href, unnest(bs) AS body FROM an_a), "
    + f"an AS (SELECT page_id, pos, href, {strip(gsub('body', '<[^>]*>', ''))} AS link_text FROM an_b)"
)
_is_doc = "(href <> '' AND contains(href, '/resources/documents/') AND ends_with(lower(href), '.pdf'))"


def _resolve() -> str:
    """Dot segments by repeated removal: links here climb at most twice."""
    p = "CASE WHEN starts_with(href, '/') THEN href ELSE '/web/' || href END"
    p = gsub(p, r"/\./", "/")
    for _ in range(4):
        p = f"regexp_replace({p}, '/[^/]+/\\.\\./', '/')"
    p = f"regexp_replace({p}, '^(/\\.\\.)+/', '/')"
    return f"CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href ELSE 'https://supremecourt.gov.bd' || {p} END"


def oracle_sql() -> dict[str, str]:
    e = f"WITH {CTE} "
    evidence = lambda c: f"WITH {CTE}, {EVIDENT} SELECT doc_id, len({c}) AS n, {join(c, q(SEP))} AS evidence FROM ev"
    j = lambda c, name: f"{join(c, q(SEP))} AS {name}"
    en = cleaned("text_en", "text_en", lex.JUNK_EN, "cl")
    raw = CTE.replace("enr AS", "enr AS", 1)
    bn = cleaned("nfc_normalize(text_bn)", "text_bn", lex.JUNK_BN, "cl")
    doc_en = f"WITH enr AS (SELECT doc_id, source, text AS text_en FROM documents), {en} "
    out = {
        "word_count_type": f"SELECT doc_id, n AS word_count, {doc_type('n')} AS doc_type FROM (SELECT doc_id, {n_words('text')} AS n FROM documents)",
        "class_summary": doc_en + f", d AS (SELECT cl.doc_id, source, {n_words('c')} AS n, coalesce(l.quality = 1, false) AS ff FROM cl JOIN enr USING (doc_id) LEFT JOIN labels l USING (doc_id)) "
        "SELECT source, count(*) AS n_docs, round(avg(n), 6) AS avg_words, count(*) FILTER (n >= 300) AS n_full, count(*) FILTER (ff) AS n_facts FROM d GROUP BY source",
        "class_totals": f"SELECT count(*) FILTER (n >= 300) AS n_full, count(*) FILTER (n < 300) AS n_short FROM (SELECT {n_words('text')} AS n FROM documents)",
        "case_type_extract": e + f"SELECT doc_id, {case_type('case_name')} AS case_type FROM enr",
        "classify_documents": f"WITH {CTE}, {SPLIT}, n AS (SELECT doc_id, {n_words('text_en')} AS n, {case_type('case_name')} AS ct FROM enr) "
        f"SELECT n.doc_id, n AS word_count, CASE WHEN n.doc_id % 10 = 9 THEN 'Unknown' ELSE ct END AS case_type, {doc_type('n')} AS doc_type, n.doc_id % 11 <> 5 AND at_facts IS NOT NULL AS facts_found FROM n JOIN sec USING (doc_id)",
        "join_line_wraps": e + f"SELECT doc_id, {digest(join_wraps('text_en'), 'text')} FROM enr",
        "drop_junk_lines": e + f"SELECT doc_id, {digest('a', 'en')}, {digest('b', 'bn')} FROM (SELECT doc_id, {join(drop_junk(lines('text_en'), lex.JUNK_EN))} AS a, {join(drop_junk(lines('text_bn'), lex.JUNK_BN))} AS b FROM enr)",
        "drop_repeated_lines": e + f", a AS (SELECT doc_id, {lines('text_en')} AS ls, {strip_all(lines('text_en'))} AS ss FROM enr), b AS (SELECT doc_id, {join(drop_repeated('ls', 'ss'))} AS t, {n_repeated('ss')} AS r FROM a) SELECT doc_id, {digest('t', 'text')}, r AS n_repeated FROM b",
        "collapse_whitespace": e + f"SELECT doc_id, {digest('c', 'text')} FROM (SELECT doc_id, {collapse('text_en')} AS c FROM enr)",
        "nfc_normalize": e + f"SELECT doc_id, {digest('nfc_normalize(text_bn)', 'text')} FROM enr",
        "bangla_stop_fix": e + f"SELECT doc_id, {digest(bangla_stops('text_bn'), 'text')} FROM enr",
        "stray_english": e + f"SELECT doc_id, {stray('text_bn')} AS n_stray FROM enr",
        "clean_en_report": f"WITH {raw}, {en} SELECT doc_id, {digest('c', 'text')}, length(raw) AS before_len, {reduction('raw', 'c')} AS reduction, {n_repeated('ss')} AS n_repeated FROM cl",
        "clean_bn_report": f"WITH {raw}, {bn}, f AS (SELECT doc_id, raw, {bangla_stops('c')} AS c FROM cl) SELECT doc_id, {digest('c', 'text')}, {reduction('raw', 'c')} AS reduction, {stray('c')} AS n_stray FROM f",
        "clean_totals": f"WITH {raw}, {en} SELECT count(*) AS n_docs, sum(length(raw))::BIGINT AS before_len, sum(length(c))::BIGINT AS after_len FROM cl",
        "section_starts": f"WITH {CTE}, {SPLIT} SELECT doc_id, coalesce(at_facts, -1) AS at_facts, coalesce(at_arguments, -1) AS at_arguments, coalesce(at_order, -1) AS at_order FROM sec",
        "section_split": f"WITH {CTE}, {SPLIT} SELECT doc_id, confidence, facts_inferred, {j('sections_found', 'sections_found')}, {digest('facts', 'facts')}, {digest('arguments', 'arguments')}, md5(\"order\") AS order_md5, length(\"order\") AS order_len FROM sec",
        "section_report": f"WITH {CTE}, {SPLIT} SELECT confidence, count(*) AS n_docs, count(*) FILTER (facts_inferred) AS n_inferred, count(*) FILTER (at_facts IS NULL) AS no_facts, count(*) FILTER (at_arguments IS NULL) AS no_arguments, count(*) FILTER (at_order IS NULL) AS no_order FROM sec GROUP BY confidence",
        "missing_sections": f"WITH {CTE}, {SPLIT}, m AS ({' UNION ALL '.join(f'SELECT {q(k)} AS section, doc_id FROM sec WHERE at_{k} IS NULL' for k in _names)}) "
        "SELECT section, count(*) AS n_missing, array_to_string(list_sort(list(doc_id))[1:3], ',') AS first_ids FROM m GROUP BY section",
        "normalize_text": e + f"SELECT doc_id, {digest('t', 'text')} FROM (SELECT doc_id, {normalize('text_en')} AS t FROM enr)",
        "sentences_d": e + f"SELECT doc_id, len(s) AS n, md5({join('s', q(SEP))}) AS md5 FROM (SELECT doc_id, {sentences_d('concat(text_en, text_bn)')} AS s FROM enr)",
        "sentences_e": e + f"SELECT doc_id, len(s) AS n, md5({join('s', q(SEP))}) AS md5 FROM (SELECT doc_id, {sentences_e('concat(text_en, text_bn)')} AS s FROM enr)",
        "final_decisions": f"WITH {CTE}, {DECIDED} SELECT doc_id, text_source, size AS tail_sentences_examined, {j('re', 'final_reasoning_evidence')}, {j('de', 'final_decision_evidence')}, len(de) > 0 AS decision_found FROM dec",
        "decision_coverage": f"WITH {CTE}, {DECIDED} SELECT count(*) AS n_docs, count(*) FILTER (len(de) > 0) AS n_found FROM dec",
        "fact_evidence": evidence("facts"),
        "issue_evidence": evidence("issues"),
        "legal_basis_evidence": evidence("legal"),
        "reasoning_evidence": evidence("reasoning"),
        "component_coverage": f"WITH {CTE}, {DECIDED}, {EVIDENT} SELECT count(*) AS n_docs, count(*) FILTER (len(issues) > 0) AS n_issue, count(*) FILTER (len(facts) > 0) AS n_facts, count(*) FILTER (len(legal) > 0) AS n_legal_basis, "
        "count(*) FILTER (len(reasoning) > 0) AS n_reasoning, count(*) FILTER (ev.doc_id % 13 <> 1 AND len(de) > 0) AS n_decision FROM ev JOIN dec USING (doc_id)",
        "reasoning_packs": f"WITH {CTE}, {SPLIT}, {DECIDED}, {EVIDENT}, {PACKS} SELECT doc_id, facts_inferred, {', '.join(j(c, c) for c in ('legal_issue_evidence', 'fact_evidence', 'legal_basis_evidence', 'court_reasoning_evidence', 'court_decision_evidence'))} FROM pk",
        "prompt_render": f"WITH {CTE}, {SPLIT}, {DECIDED}, {EVIDENT}, {PACKS} SELECT doc_id, {digest('p', 'prompt')} FROM (SELECT doc_id, {_prompt()} AS p FROM pk)",
        "prompt_first": f"WITH {CTE}, {SPLIT}, {DECIDED}, {EVIDENT}, {PACKS} SELECT doc_id, {digest('p', 'prompt')} FROM (SELECT doc_id, {_prompt()} AS p FROM pk ORDER BY doc_id LIMIT 3)",
        "json_salvage": f"WITH {CTE}, {SALVAGED} SELECT doc_id, json FROM sv",
        "parse_replies": f"WITH {CTE}, {SALVAGED}, p AS (SELECT *, coalesce(starts_with(json, '{{') AND json_valid(json), false) AS ok FROM sv) "
        f"SELECT doc_id, CASE WHEN ok THEN json_extract_string(json, '$.facts') ELSE '' END AS facts, CASE WHEN ok THEN json_extract_string(json, '$.decision') ELSE '' END AS decision, CASE WHEN NOT ok THEN reply END AS raw_output, CASE WHEN NOT ok THEN '{FALLBACK_ERROR}' END AS parse_error FROM p",
        "proxy_reference": f"WITH {CTE}, {REFS} SELECT doc_id, case_type, 'proxy_order_extraction' AS reference_type, {n_words('ref')} AS ref_len_words, {digest('ref', 'ref')} FROM rf",
        "reference_template": f"WITH {CTE}, {REFS} SELECT doc_id, case_type, '' AS reference_summary_bn FROM rf",
        "skipped_pairs": f"WITH {CTE}, {PAIRS} SELECT doc_id FROM rf WHERE doc_id NOT IN (SELECT doc_id FROM pr)",
        "rouge_n": f"WITH {CTE}, {PAIRS}, {_grams(1)}, {_grams(2)} SELECT pr.doc_id, {n_words('hyp')} AS hyp_len_words, {n_words('ref')} AS ref_len_words, round(f1.p, 6) AS rouge1_p, round(f1.r, 6) AS rouge1_r, round(f1.f, 6) AS rouge1_f, round(f2.f, 6) AS rouge2_f FROM pr JOIN f1 USING (doc_id) JOIN f2 USING (doc_id)",
        "rouge_avg": f"WITH {CTE}, {PAIRS}, {_grams(1)} SELECT round(avg(p), 4) AS rouge1_p, round(avg(r), 4) AS rouge1_r, round(avg(f), 4) AS rouge1_f FROM f1",
        "factual_scores": f"WITH {CTE}, {PAIRS}, c AS (SELECT doc_id, {content('hyp')} AS s, {content('text_en')} AS src, {content('ref')} AS ref FROM pr JOIN (SELECT doc_id, text_en FROM enr WHERE doc_id % 8 <> 5) USING (doc_id)), "
        "d AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN 0 ELSE len(list_intersect(s, src)) / len(s) END AS p, CASE WHEN len(s) = 0 OR len(ref) = 0 THEN 0 ELSE len(list_intersect(s, ref)) / len(ref) END AS r FROM c) "
        "SELECT doc_id, round(p, 6) AS factual_precision, round(r, 6) AS factual_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS factual_f1 FROM d",
        "bertscore_greedy": "WITH t AS (SELECT vec_id // 10 AS pair_id, vec_id % 10 < 4 AS h, vec_id, embedding::DOUBLE[] AS v FROM embeddings), "
        "j AS (SELECT a.pair_id, a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.v, b.v) AS c FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.h AND NOT b.h), "
        "p AS (SELECT pair_id, avg(c) AS p FROM (SELECT pair_id, x, max(c) AS c FROM j GROUP BY ALL) GROUP BY 1), r AS (SELECT pair_id, avg(c) AS r FROM (SELECT pair_id, y, max(c) AS c FROM j GROUP BY ALL) GROUP BY 1) "
        "SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p JOIN r USING (pair_id)",
        "anchor_scan": f"WITH {CTE_PAGES}, {ANCHORS} SELECT page_id, pos, href, link_text FROM an",
        "url_resolve": f"WITH {CTE_PAGES}, {ANCHORS} SELECT page_id, pos, {_is_doc} AS is_doc, {_resolve()} AS url FROM an",
        "link_harvest": f"WITH {CTE_PAGES}, {ANCHORS}, l AS (SELECT page_id, pos, link_text, {_resolve()} AS pdf_url FROM an WHERE {_is_doc}), "
        "f AS (SELECT *, row_number() OVER (PARTITION BY pdf_url ORDER BY page_id, pos) AS r FROM l), "
        "g AS (SELECT *, row_number() OVER (ORDER BY page_id, pos) AS n FROM f WHERE r = 1 AND pdf_url <> 'https://supremecourt.gov.bd/resources/documents/7_WP.pdf') "
        "SELECT printf('J%05d', n) AS id, link_text AS case_name, pdf_url, printf('J%05d.pdf', n) AS saved_file, string_split(pdf_url, '/')[-1] AS original_filename FROM g",
        "chunk_roundtrip": f"WITH t AS (SELECT doc_id, text, ceil(length(text) / 1000)::BIGINT AS n FROM documents WHERE length({strip('text')}) >= 100), "
        f"c AS (SELECT doc_id, n, array_to_string(list_transform(range(0, n), lambda zi: substr(text, zi * 1000 + 1, 1000)), chr(10)) AS t FROM t) SELECT doc_id, n AS n_chunks, {digest('t', 'text')} FROM c",
        "utf8_gate": f"SELECT doc_id, {digest('text', 'text')} FROM documents WHERE doc_id % 5 <> 0 AND length({strip('text')}) >= 200",
    }
    return out | more_sql(sys.modules[__name__])
