"""URL filters, decontamination and mixing against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from caselight.llm import decontam, mixing, oracles, queries, urlfilter

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("url,host,path", [
    ("http://A.Example.COM/En/7?x", "a.example.com", "/En/7"), ("x://h", "h", ""), ("no scheme", "", ""), (None, "", ""),
    ("a://b://c/d", "b:", "//c/d"), ("http://h?q/x", "h", ""), ("://H#f", "h", ""), ("http:///p", "", "/p"), ("http://h/a\nb", "h", "/a\nb"),
])
def test_host_and_path(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = urlfilter.host_and_path(F.col("url"))
    assert tuple(df.select(h, p).first()) == (host, path)


def test_rules(spark):
    rows = [("a.example.com", "/en/7x", "example.com/en/7"), ("other.com", "/en/7", "com/en/"), ("xcom", "/en/1", None), ("com", "/en/", "com/en/"), ("example.net", "/de/81", "example.net/de/8"), ("q.net", "/de/81", "net/de/"), ("o.org", "/es/", "org/es/"), ("o.org", "/ES/", None)]
    df = spark.createDataFrame(rows, "host string, path string, want string")
    rule, _ = urlfilter.rule_columns(F.col("host"), F.col("path"))
    assert all(r.got == r.want for r in df.withColumn("got", rule).collect())


def test_templates(spark):
    paths = [("h", f"/en/{i}", 1) for i in range(9)] + [("h", "/en/about", 1), ("h", "/de/x", 5), ("k", "", 2), ("k", "/a/b/c/d/e", 1)]
    df = spark.createDataFrame(paths, "host string, path string, n long")
    got = {(r.host, r.path): r.tpl for r in urlfilter.templates(df).collect()}
    assert got["h", "/en/3"] == "/en/*" and got["h", "/de/x"] == "/de/x" and got["k", "/a/b/c/d/e"] == "/a/b/c/d/e"
    deep = [("h", f"/a/b/c/d/e/f/{i}/g", 100) for i in range(9)] + [("h", "/a/b/c/d/e/f/hot/" + str(i), 1) for i in range(60)] + [("h", "/a/" * 40, 1)]
    got = {r.path: r.tpl for r in urlfilter.templates(spark.createDataFrame([(h, p, n, "c") for h, p, n in deep], "host string, path string, n long, seg string")).collect()}
    assert len(got) == len(deep) and got["/a/b/c/d/e/f/7/g"] == got["/a/b/c/d/e/f/hot/3"] == "/a/b/c/d/e/f/*/*" and "*" not in got["/a/" * 40]
    k = spark.createDataFrame([("/en/*",), ("/a/b",), ("/*",), ("",)], "t string").select(urlfilter.merge_key(F.col("t")).alias("x"))
    assert [r.x for r in k.collect()] == ["/*/*", "/a/*", "/*", ""]


def test_url_verdicts_learn_from_rules(spark):
    urls = [f"http://bad.com/en/{i}" for i in range(40)] + [f"http://bad.com/zz/{i}" for i in range(12)] + [f"http://good.net/de/{i}" for i in range(40)] + [f"http://good.net/zz/{i}" for i in range(12)] + [None, "http://new.test/"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {urls[r.page_id]: r for r in urlfilter.judge(df).collect()}
    assert len(got) == len(urls)
    assert got["http://bad.com/zz/3"].verdict == "block" and got["http://good.net/zz/3"].verdict == "allow"
    assert got[None].host == "" and got[None].verdict in ("allow", "block")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql_forms(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(oracles.ORACLES[name]).df()
    rows = lambda d: sorted(tuple(str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def semi_global(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(9)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(a, b))) for a, b in ((1, 80), (0, 90)))
        d = semi_global(p, t)
        got = decontam.myers(p, t, d)
        assert (got and got[0]) == d if t else got is None
        assert d == 0 or decontam.myers(p, t, d - 1) is None


def edited(rng, s, n):
    c = list(s)
    for _ in range(n):
        i = rng.randrange(len(c))
        kind = rng.randrange(3)
        c[i : i + 1] = [] if kind == 0 else [rng.choice("xyz")] if kind == 1 else [c[i], rng.choice("xyz")]
    return "".join(c)


def test_decontamination_against_brute_force(spark, corpus, empty):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, text(rng.randint(8, 40))) for i in range(25)] + [(90, "too short"), (91, None), (92, items0 := text(20)), (92, items0)]
    docs = []
    for i in range(150):
        body = [text(60)]
        if i % 3:
            _, item = items[i % 25]
            body.append(edited(rng, item, rng.randint(0, 25)).upper().replace(" ", rng.choice([" ", "\n", " - "])))
        docs.append((i, " ".join([*body, text(30)])))
    docs += [(None, docs[1][1]), (500, None), (501, ""), docs[1], (502, "it is TOO, short."), (503, "it is too shorter"), (504, "too short")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, item_id long, t string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t in docs:
        for i, item in {x for x in items if x[1]}:
            p = decontam.normal(item)
            if len(p.split()) < decontam.LEAST_WORDS:
                want[d, i, 0] += f" {p} " in f" {decontam.normal(t)} "
            elif (semi_global(p, decontam.normal(t)) if t else 10**6) <= decontam.edit_budget(len(p)):
                want[d, i, semi_global(p, decontam.normal(t))] += 1
    want = +want
    got = decontam.matches(df, bench)
    assert Counter((r.doc_id, r.item_id, r.distance) for r in got.collect()) == want and len(want) > 30
    kept = decontam.decontaminate(df, bench)
    hit = {k[0] for k in want}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in docs if d not in hit) and kept.columns == df.columns
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).count() == len(docs)


def water_fill(sizes, weights):
    target, open_ = {}, set(sizes)
    left = float(sum(sizes.values()))
    while open_:
        lift = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * lift > 3 * sizes[s]}
        if not full:
            return target | {s: weights[s] * lift for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, corpus, empty):
    df, _ = corpus
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(dict(sizes), {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    per = defaultdict(list)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.copies * r.size
        per[r.source].append(r)
    for s, rs in per.items():
        largest = max(sum(x.size for x in rs if x.doc_id == r.doc_id) for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= largest / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    assert mixing.mix(empty).count() == 0
    kept = mixing.take_mix(df)
    assert kept.columns == [c for c in df.columns if c != "copies"] + ["copies", "target"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.copies)
    assert mixing.take_mix(empty).count() == 0


def test_mixing_comes_near_every_target(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert len(got) > 10 and all(abs(r.n / r.t - 1) <= mixing.NEAR for r in got)


def test_mixing_goes_on_behind_long_documents(spark):
    rows = [(i, "w " * (700 + i), "a") for i in range(60)] + [(1000 + i, "w " * (3 + i % 5), "a") for i in range(200)] + [(i, "w " * 50, "b") for i in range(2000, 2040)]
    rows += [(5000, "w " * 9000, "c"), (5001, "w " * 9000, "c"), (None, "w " * 9, "b"), (None, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(3, 20, 7)).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    off = {r.source: r.n / r.t - 1 for r in got}
    assert abs(off["a"]) <= mixing.NEAR and abs(off["b"]) <= mixing.NEAR


def test_mixing_caps_and_nesting(spark):
    rows = [(i, "w " * 10, "small" if i < 10 else "zlarge") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(3, 1)).collect()
    assert {r.target for r in got if r.source == "small"} == {300.0} and all(r.taken == 30 for r in got if r.source == "small")
    big = sum(r.taken for r in got if r.source == "zlarge")
    assert abs(big - 19700) <= 10
    less = {r.doc_id for r in mixing.mix(df, weights=(1, 1)).collect() if r.copies > 0}
    assert less <= {r.doc_id for r in got if r.copies > 0} | less
