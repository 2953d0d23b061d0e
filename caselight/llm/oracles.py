"""DuckDB SQL for the queries that SQL can express: exact forms by brute force, over the same whole tables.

op1, op7, op8 (trained), op6 and op9 (XXH64, which DuckDB lacks) and op10 (edit distance to a passage inside a
text) have none; tests compare them with brute force or held-out labels.
"""

from __future__ import annotations

from . import embdedup, linededup, substring, urlfilter

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op2() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {embdedup.COSINE}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def _op3() -> str:
    run = linededup.GRAM + linededup.WINDOW - 1
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, line, p, trim(line, {blank}) AS t FROM l),
k AS (SELECT doc_id, p, row_number() OVER w AS s, count(*) OVER (PARTITION BY doc_id) AS n, list(t) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {run - 1} FOLLOWING) AS g FROM f WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM k WHERE len(g) = {run}),
m AS (SELECT k.doc_id, k.p, coalesce(max(CASE WHEN nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY k.s ROWS BETWEEN {run - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM k LEFT JOIN r USING (doc_id, s)),
j AS (SELECT f.doc_id, count(*) AS n_lines, sum(coalesce(gone, 0))::BIGINT AS n_removed, string_agg(CASE WHEN coalesce(gone, 0) = 0 THEN line END, chr(10) ORDER BY f.p) AS kept FROM f LEFT JOIN m USING (doc_id, p) GROUP BY f.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN j USING (doc_id)"""


def _rule(what: str) -> str:
    out = "NULL"
    for h, p, v in sorted(urlfilter.RULES, key=lambda r: len(r[0] + r[1])):
        out = f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}' ELSE {out} END"
    return out


#: The SQL form grows this many levels; the operator has no such bound.
_LEVELS = 12


def _op4() -> str:
    u = urlfilter
    levels = []
    for i in range(_LEVELS):
        levels.append(
            f"k{i} AS (SELECT host, tpl, segs[{i + 1}] AS seg, count(*) AS n FROM t{i} WHERE len(segs) > {i} GROUP BY ALL), "
            f"w{i} AS (SELECT host, tpl FROM k{i} GROUP BY ALL HAVING count(*) >= {u.CHILDREN} AND 2 * count(*) FILTER (n < {u.RARE}) > count(*)), "
            f"t{i + 1} AS (SELECT t.host, t.path, t.n, t.b, t.a, t.segs, t.tpl || CASE WHEN len(t.segs) <= {i} THEN '' WHEN w.host IS NOT NULL THEN '/*' ELSE '/' || t.segs[{i + 1}] END AS tpl FROM t{i} t LEFT JOIN w{i} w USING (host, tpl))"
        )
    return f"""
WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
q AS (SELECT host, path, count(*) AS n, {_rule('verdict')} AS v, string_split(regexp_replace(path, '^/', ''), '/') AS raw FROM p GROUP BY host, path),
t0 AS (SELECT host, path, n, CASE WHEN v = 'block' THEN n ELSE 0 END AS b, CASE WHEN v = 'allow' THEN n ELSE 0 END AS a,
  CASE WHEN len(raw) > {_LEVELS} THEN list_append(raw[1:{_LEVELS - 1}], array_to_string(raw[{_LEVELS}:], '/')) ELSE raw END AS segs, '' AS tpl FROM q),
{', '.join(levels)},
leaf AS (SELECT host, tpl, sum(b) AS b, sum(a) AS a, regexp_replace(tpl, '^(.*)/[^/*]+((?:/\\*)*)$', '\\1/*\\2') AS wide FROM t{_LEVELS} GROUP BY host, tpl),
pri AS (SELECT (coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(b), 0) + coalesce(sum(a), 0) + 2.0::DOUBLE) AS prior FROM leaf),
h AS (SELECT host, sum(b)::DOUBLE AS hb, sum(a)::DOUBLE AS ha FROM leaf GROUP BY host),
wd AS (SELECT host, wide, sum(b)::DOUBLE AS wb, sum(a)::DOUBLE AS wa FROM leaf GROUP BY ALL),
k AS (SELECT leaf.host, tpl, wide, b::DOUBLE AS b, a::DOUBLE AS a, (b + a)::DOUBLE AS m, wb / greatest(wb + wa, 1) AS pp FROM leaf JOIN wd USING (host, wide)),
kt AS (SELECT *, CASE WHEN m = 0 OR (b - m * pp) * (b - m * pp) <= {u.ALIKE!r}::DOUBLE * {u.ALIKE!r}::DOUBLE * m * pp * (1.0::DOUBLE - pp) THEN wide ELSE tpl END AS template FROM k),
g AS (SELECT host, template, sum(b) AS b, sum(a) AS a FROM kt GROUP BY ALL),
pu AS (SELECT host, template, (b + {u.HOST_WEIGHT}::DOUBLE * ((hb + {u.CORPUS_WEIGHT}::DOUBLE * prior) / (hb + ha + {u.CORPUS_WEIGHT}::DOUBLE))) / (b + a + {u.HOST_WEIGHT}::DOUBLE) AS purity FROM g JOIN h USING (host) CROSS JOIN pri)
SELECT page_id, p.host, p.path, {_rule('rule').replace('host', 'p.host').replace('path', 'p.path')} AS rule,
  coalesce({_rule('verdict').replace('host', 'p.host').replace('path', 'p.path')}, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN t{_LEVELS} t ON t.host = p.host AND t.path = p.path JOIN kt ON kt.host = t.host AND kt.tpl = t.tpl JOIN pu ON pu.host = kt.host AND pu.template = kt.template"""


def _op5() -> str:
    w = substring.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT rid, unnest(range(1, len(ws) - {w} + 2)) AS i, ws FROM d WHERE len(ws) >= {w}),
h AS (SELECT rid, i, md5(array_to_string(ws[i:i + {w - 1}], ' ')) AS h FROM s),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY h) > 1 AS many FROM h),
x AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
c AS (SELECT x.rid, x.word, x.i, max(CASE WHEN r.many THEN 1 ELSE 0 END) OVER (PARTITION BY x.rid ORDER BY x.i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN r ON r.rid = x.rid AND r.i = x.i),
k AS (SELECT rid, count(*) AS n, sum(gone)::BIGINT AS gone, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM c GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""


ORACLES: dict[str, str] = {"op2_embedding_dedup": _op2(), "op3_line_dedup": _op3(), "op4_url_filters": _op4(), "op5_substring_dedup": _op5()}
