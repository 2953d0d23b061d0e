"""Ingest: links of listing pages, URL resolution, first-wins dedupe, dense ids, chunks."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import strip
from ..tables import written

# Fixed value: the site whose listing pages the links are resolved against by default.
BASE = "https://supremecourt.gov.bd/web/"
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)[\"']?[^>]*>(.*?)</a>"
CHUNK = 4000
READABLE = 100


def anchors(pages: DataFrame, html: str = "html", page: str = "page_id") -> DataFrame:
    """(page, pos, href, link_text): every anchor in document order; text without tags, stripped."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(2)).alias("body"))
    t = pages.select(page, F.posexplode(pairs).alias("pos", "x"))
    return t.select(page, "pos", F.col("x.href").alias("href"), strip(F.regexp_replace("x.body", "<[^>]*>", "")).alias("link_text"))


def is_document_link(href: Column, folder: str = "/resources/documents/") -> Column:
    return (href != "") & href.contains(folder) & F.lower(href).endswith(".pdf")


def resolve(href: Column, base: str = BASE) -> Column:
    """Absolute URL of a link on a page at ``base``: absolute, protocol- or root-relative, or relative with dot segments."""
    scheme, rest = base.split("://", 1)
    host, _, path = rest.partition("/")
    folder = "/" + path.rsplit("/", 1)[0] + "/" if "/" in path else "/"
    joined = F.when(href.startswith("/"), href).otherwise(F.concat(F.lit(folder), href))
    parts = F.split(joined, "/", -1)

    def step(acc: Column, seg: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(seg == ".", acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    flat = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    path_url = F.concat(F.lit(f"{scheme}://{host}"), F.array_join(flat, "/"))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href)).otherwise(path_url)


def harvest(pages: DataFrame, base: str = BASE, max_page: int | None = None, failed: DataFrame | None = None, page: str = "page_id") -> DataFrame:
    """id, case_name, pdf_url, saved_file, original_filename of each distinct document link, first occurrence first.

    ``failed(pdf_url)`` lists fetches that failed: such a URL is not retried and takes no id. Ids are dense in (page,
    position) order: ranks within range partitions plus partition offsets, so no task sees all rows.
    """
    p = pages if max_page is None else pages.where(F.col(page) <= max_page)
    t = anchors(p, page=page).where(is_document_link(F.col("href"))).withColumn("pdf_url", resolve(F.col("href"), base))
    first = t.groupBy("pdf_url").agg(F.min(F.struct(page, "pos", "link_text")).alias("x"))
    if failed is not None:
        first = first.join(failed.select("pdf_url"), "pdf_url", "left_anti")
    return dense_ids(first.select("pdf_url", f"x.{page}", "x.pos", "x.link_text"), [page, "pos", "pdf_url"]).select(
        "id", F.col("link_text").alias("case_name"), "pdf_url", F.concat("id", F.lit(".pdf")).alias("saved_file"), F.element_at(F.split("pdf_url", "/"), -1).alias("original_filename")
    )


def dense_ids(df: DataFrame, order: list[str], width: int = 5, prefix: str = "J") -> DataFrame:
    """Adds ``id``: a dense number in ``order``, which has to be unique.

    The rows are range-partitioned and written once, since bounds come from a sample that another run of the plan would
    draw anew; then a row's number is its place in its part plus the sizes of the parts before, one number a part.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_p", F.shiftright("_m", 33))
    sizes = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    before = list(itertools.accumulate((n for _, n in sizes), initial=0))
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_p long, _b long")
    number = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(offsets), "_p").withColumn("id", F.format_string(f"{prefix}%0{width}d", number)).drop("_p", "_m", "_b")


def walk_pages(pages: DataFrame, most: int | None = 5, listing: str = "listing", page: str = "page_no", html: str = "html") -> DataFrame:
    """The pages of each listing that a walk by its ``Next`` links reads, from the first page on.

    The walk ends at a page without a link whose text has ``Next``, at one behind which there is no page or the same
    page again, and after ``most`` pages (None: no such end).
    """
    here = pages.select(listing, page, F.md5(F.col(html).cast("binary")).alias("_h"), F.exists(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(2)), lambda t: F.regexp_replace(t, "<[^>]*>", "").contains("Next")).alias("_next"))
    behind = here.select(listing, (F.col(page) - 1).alias(page), F.col("_h").alias("_behind"))
    on = F.coalesce(F.col("_next") & (F.col("_behind") != F.col("_h")), F.lit(False))
    ends = here.join(behind, [listing, page], "left").groupBy(listing).agg(F.min(page).alias("_first"), F.min(F.when(~on, F.col(page))).alias("_end"))
    last = F.col("_end") if most is None else F.least(F.col("_end"), F.col("_first") + (most - 1))
    return pages.join(ends, listing).where(F.col(page) <= last).select(*pages.columns)


def readable(df: DataFrame, text: str = "text", least: int = READABLE) -> DataFrame:
    return df.where(F.length(strip(F.coalesce(F.col(text), F.lit("")))) >= least)


def chunks(c: Column, size: int = CHUNK) -> Column:
    """Slices of ``size`` characters; none of an empty text."""
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def translate_chunks(df: DataFrame, translate, key: str = "id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """Chunks of each text translated in parallel and joined by newlines in order.

    ``translate`` maps a string column (a pandas UDF around a model); a failed chunk is to come back as ``""``.
    """
    t = df.select(key, F.posexplode_outer(chunks(F.col(text), size)).alias("pos", "chunk"))
    t = t.withColumn("chunk", F.coalesce(translate(F.col("chunk")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "chunk")))
    return t.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "\n").alias("translated"))
