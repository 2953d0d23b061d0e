"""URL filters by a path-template tree; DataFrame functions only.

Stated rules (host, path prefix) judge what they fit and label it. For the rest, each host grows a tree of path
segments, level by level, until no node is open: below a node with many children, most of them rare among the distinct
paths, segments become the wildcard ``*``. How often a path occurs does not count, nor how deep it is.
Sibling branches that differ in their last literal segment and whose labelled shares do not differ significantly are
merged. A template is rejected when its labelled purity, smoothed towards its host's and the corpus' share of
blocked pages, is over one half.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join

#: The stated rules: host, path prefix, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: A node is variable from so many children on, if over half of them are rare, that is in fewer distinct paths than this.
CHILDREN, RARE = 4, 3
#: Siblings are alike within so many standard deviations; weights of the two priors.
ALIKE = 1.96
HOST_WEIGHT, CORPUS_WEIGHT = 2.0, 4.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def templates(paths: DataFrame) -> DataFrame:
    """``paths(host, path, ...)``, distinct by host and path, with the template ``tpl``, grown level by level.

    Every level is one partial aggregation by (host, node, segment) and one join with the open nodes. A node is open if
    enough distinct paths lead on below it to make it or a node below it variable; the others' paths are finished at
    once, so the levels end with the last branching, not with the longest path.
    """
    spark = paths.sparkSession
    segs = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    done: list[DataFrame] = []
    t = materialize(paths.withColumn("__url_segs", segs).withColumn("tpl", F.lit("")), "url-0")
    columns, level = [*paths.columns, "tpl"], 0
    while True:
        rest = F.concat(F.lit("/"), F.array_join(F.slice("__url_segs", level + 1, F.greatest(F.size("__url_segs") - level, F.lit(0))), "/"))
        ended = F.size("__url_segs") <= level
        seg = F.get("__url_segs", F.lit(level)).alias("__url_seg")
        kids = t.where(~ended).groupBy("host", "tpl", seg).agg(F.count(F.lit(1)).alias("__url_n"))
        wild = (F.count(F.lit(1)) >= CHILDREN) & (2 * F.count_if(F.col("__url_n") < RARE) > F.count(F.lit(1)))
        nodes = materialize(kids.groupBy("host", "tpl").agg(F.sum("__url_n").alias("__url_n"), wild.alias("__url_wild")), "url-nodes")
        narrow = t.where(ended).select(*columns)
        open_ = spread_join(t.where(~ended), nodes, ["host", "tpl"], "__url_n")
        shut = open_.where(F.col("__url_n") < CHILDREN).select(*paths.columns, F.concat("tpl", rest).alias("tpl"))
        done.append(materialize(narrow.union(shut), "url-done"))
        step = F.when(F.col("__url_wild"), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.get("__url_segs", F.lit(level))))
        old, t = t, materialize(open_.where(F.col("__url_n") >= CHILDREN).select(*paths.columns, "__url_segs", F.concat("tpl", step).alias("tpl")), f"url-{level + 1}")
        discard(spark, old, nodes)
        level += 1
        if not t.limit(1).count():
            break
    out = materialize(reduce(DataFrame.union, done), "url-templates")
    discard(spark, t, *done)
    return out


def merge_key(tpl: Column) -> Column:
    """The template with its last literal segment generalised too."""
    return F.regexp_replace(tpl, r"^(.*)/[^/*]+((?:/\*)*)$", r"$1/*$2")


def template_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, path, n, template, purity) of every distinct host and path of ``pages(host, path)``; ``n`` pages have it."""
    spark = pages.sparkSession
    _, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    paths = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("v", verdict)
    paths = paths.withColumn("b", F.when(F.col("v") == "block", F.col("n")).otherwise(0)).withColumn("a", F.when(F.col("v") == "allow", F.col("n")).otherwise(0)).drop("v")
    t = templates(paths)
    leaf = t.groupBy("host", "tpl").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("n_paths"))
    leaf = materialize(leaf.withColumn("wide", merge_key(F.col("tpl"))), "url-leaves")
    total = leaf.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    prior = (total["b"] + 1.0) / (total["b"] + total["a"] + 2.0)
    wide = materialize(leaf.groupBy("host", "wide").agg(F.sum("b").alias("wb"), F.sum("a").alias("wa"), F.count(F.lit(1)).alias("n")), "url-wide")
    k = spread_join(leaf, wide, ["host", "wide"]).drop("n")
    m, w = F.col("b") + F.col("a"), F.col("wb") + F.col("wa")
    p = F.col("wb") / F.greatest(w, F.lit(1))
    off = F.col("b") - m * p
    alike = (m == 0) | (off * off <= ALIKE * ALIKE * m * p * (1.0 - p))
    k = materialize(k.withColumn("template", F.when(alike, F.col("wide")).otherwise(F.col("tpl"))), "url-merged")
    merged = materialize(k.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("n")), "url-verdicts")
    hosts = materialize(merged.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("a").alias("ha"), F.count(F.lit(1)).alias("n")), "url-hosts")
    host_rate = (F.col("hb") + CORPUS_WEIGHT * prior) / (F.col("hb") + F.col("ha") + CORPUS_WEIGHT)
    purity = (F.col("b") + HOST_WEIGHT * host_rate) / (F.col("b") + F.col("a") + HOST_WEIGHT)
    verdicts = spread_join(merged.withColumnRenamed("n", "n_leaves"), hosts, ["host"]).select("host", "template", purity.alias("purity"), F.col("n_leaves").alias("n"))
    verdicts = materialize(verdicts, "url-purity")
    named = spread_join(k, verdicts, ["host", "template"]).select("host", "tpl", "template", "purity", F.col("n_paths").alias("n"))
    named = materialize(named, "url-named")
    out = spread_join(t.withColumnRenamed("n", "n_pages"), named, ["host", "tpl"]).select("host", "path", F.col("n_pages").alias("n"), "template", "purity")
    out = materialize(out, "url-judged")
    discard(spark, t, leaf, wide, k, merged, hosts, verdicts, named)
    return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages(page_id, url)``.

    Defined results: a null url or one without ``://`` has empty host and path and is judged like any other host;
    purity of exactly one half allows; repeated rows stay and count; an empty table gives an empty one. Extra
    columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    p = materialize(pages.select("page_id", host.alias("host"), path.alias("path")), "url-pages")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    out = spread_join(p, template_verdicts(p, rules), ["host", "path"]).withColumn("rule", rule)
    method = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "template", "purity")
