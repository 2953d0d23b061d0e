"""The registered queries of the document operators: whole tables, one projection or aggregation each.

Texts are compared by digest, arrays as joined strings, numbers rounded, so that engines agree on values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models
from ..functions import lexicon as lex
from ..functions.chars import lines, strip, word_count, words
from ..operators import classify, clean, decisions, evidence, ingest, metrics, packs, refs, sections, sentences
from ..sources import readers, writers
from ..tables import new_path
from .enrich import documents, enriched, enriched_pages, listings

SEP = " ¦ "
_all: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _all[f.__name__] = f
    return f


def _long(c: Column) -> Column:
    return c.cast("long")


def _joined(name: str) -> Column:
    return F.array_join(name, SEP).alias(name)


def _digest(c: Column, name: str) -> list[Column]:
    return [F.md5(c.cast("binary")).alias(f"{name}_md5"), _long(F.length(c)).alias(f"{name}_len")]


_documents = documents


@_query
def word_count_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = word_count(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", _long(n).alias("word_count"), classify.doc_type(n).alias("doc_type"))


@_query
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = clean.clean_en(F.col("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("q"))
    d = _documents(spark, sf_dir).select("doc_id", "source", word_count(text).alias("word_count")).join(labels, "doc_id", "left")
    d = d.withColumn("doc_type", classify.doc_type(F.col("word_count"))).withColumn("facts_found", F.coalesce(F.col("q") == 1, F.lit(False)))
    s = classify.type_summary(d, "source")
    return s.select("source", *[_long(F.col(c)).alias(c) for c in ("n_docs", "n_full", "n_facts")], F.round("avg_words", 6).alias("avg_words"))


@_query
def class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select(classify.doc_type(word_count(F.col("text"))).alias("doc_type"))
    return classify.type_totals(d)


@_query
def case_type_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", classify.case_type(F.col("case_name")).alias("case_type"))


@_query
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir)
    meta = e.where("meta_name is not null").select("doc_id", F.col("meta_name").alias("case_name"))
    structured = sections.split_sections(e.where("has_sections").select("doc_id", F.col("text_en").alias("text"))).select("doc_id", "sections_found")
    out = classify.classify(e.select("doc_id", F.col("text_en").alias("text")), meta, structured, "doc_id")
    return out.withColumn("word_count", _long(F.col("word_count")))


@_query
def join_line_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", *_digest(clean.join_wraps(F.col("text_en")), "text"))


@_query
def drop_junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir)
    en, bn = F.array_join(clean.drop_junk(lines(F.col("text_en"))), "\n"), F.array_join(clean.drop_junk(lines(F.col("text_bn")), lex.JUNK_BN), "\n")
    return e.select("doc_id", *_digest(en, "en"), *_digest(bn, "bn"))


@_query
def drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(F.col("text_en"))
    return enriched(spark, sf_dir).select("doc_id", *_digest(F.array_join(clean.drop_repeated(ls), "\n"), "text"), _long(F.size(clean.repeated(ls))).alias("n_repeated"))


@_query
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", *_digest(clean.collapse_whitespace(F.col("text_en")), "text"))


@_query
def nfc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", *_digest(clean.nfc(F.col("text_bn")), "text"))


@_query
def bangla_stop_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", *_digest(clean.bangla_stops(F.col("text_bn")), "text"))


@_query
def stray_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", _long(clean.stray_english_lines(F.col("text_bn"))).alias("n_stray"))


@_query
def clean_en_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir).select("doc_id", "text_en", clean.kept_lines(F.col("text_en"), lex.JUNK_EN).alias("k"))
    e = e.select("doc_id", "text_en", "k", clean.repeated(F.col("k")).alias("r"))
    e = e.select("doc_id", "text_en", "r", clean.collapse_whitespace(F.array_join(clean.drop_lines(F.col("k"), F.col("r")), "\n")).alias("c"))
    return e.select("doc_id", *_digest(F.col("c"), "text"), _long(F.length("text_en")).alias("before_len"), F.round(clean.reduction(F.col("text_en"), F.col("c")), 6).alias("reduction"), _long(F.size("r")).alias("n_repeated"))


@_query
def clean_bn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir).select("doc_id", "text_bn", clean.nfc("text_bn").alias("n")).select("doc_id", "text_bn", clean.clean_bn(F.col("n")).alias("c"))
    return e.select("doc_id", *_digest(F.col("c"), "text"), F.round(clean.reduction(F.col("text_bn"), F.col("c")), 6).alias("reduction"), _long(clean.stray_english_lines(F.col("c"))).alias("n_stray"))


@_query
def clean_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir).select(F.length("text_en").alias("b"), F.length(clean.clean_en(F.col("text_en"))).alias("a"))
    return e.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("b").alias("before_len"), F.sum("a").alias("after_len"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.split_sections(enriched(spark, sf_dir).select("doc_id", F.col("text_en").alias("text")))


@_query
def section_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir).select("doc_id", F.transform(lines(F.col("text_en")), strip).alias("s"))
    return e.select("doc_id", *[_long(F.coalesce(sections.first_heading(F.col("s"), p), F.lit(-1))).alias(f"at_{k}") for k, p in lex.SECTIONS.items()])


@_query
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "confidence", "facts_inferred", _joined("sections_found"), *[c for k in lex.SECTIONS for c in _digest(F.col(k), k)])


@_query
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_report(_split(spark, sf_dir))


@_query
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.missing_samples(_split(spark, sf_dir)).select("section", "n_missing", F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ",").alias("first_ids"))


@_query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", *_digest(sentences.normalize(F.col("text_en")), "text"))


@_query
def sentences_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir).select("doc_id", sentences.decision_sentences(F.concat("text_en", "text_bn")).alias("s"))
    return e.select("doc_id", _long(F.size("s")).alias("n"), F.md5(F.array_join("s", SEP).cast("binary")).alias("md5"))


@_query
def sentences_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir).select("doc_id", sentences.evidence_sentences(F.concat("text_en", "text_bn")).alias("s"))
    return e.select("doc_id", _long(F.size("s")).alias("n"), F.md5(F.array_join("s", SEP).cast("binary")).alias("md5"))


def _decided(spark: SparkSession, sf_dir: str, *keep: str, first: int | None = None) -> DataFrame:
    """Both texts are columns of one row, so the fallback is a choice of columns: one scan, no shuffle."""
    text, source = decisions.choose_text(F.col("file_en"), F.col("file_bn"))
    return decisions.final_decisions(enriched(spark, sf_dir, first).select("doc_id", *keep, text.alias("text"), source.alias("text_source")))


@_query
def final_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select(
        "doc_id", "text_source", _long(F.col("tail_sentences_examined")).alias("tail_sentences_examined"), _joined("final_reasoning_evidence"), _joined("final_decision_evidence"), "decision_found"
    )


@_query
def decision_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_coverage(_decided(spark, sf_dir))


def _evident(spark: SparkSession, sf_dir: str, *keep: str, first: int | None = None) -> DataFrame:
    """Evidence and decisions of a document from one row; decisions are null where their row is missing."""
    d = _decided(spark, sf_dir, "text_en", "has_decision", *keep, first=first)
    d = d.withColumn("decision_evidence", F.when(F.col("has_decision"), F.col("final_decision_evidence")))
    return evidence.with_components(evidence.with_evidence(d, "text_en"))


def _one_evidence(spark: SparkSession, sf_dir: str, fn: Callable[[Column], Column]) -> DataFrame:
    e = enriched(spark, sf_dir).select("doc_id", sentences.evidence_sentences(F.col("text_en")).alias("s"))
    return e.select("doc_id", fn(F.col("s")).alias("e")).select("doc_id", _long(F.size("e")).alias("n"), F.array_join("e", SEP).alias("evidence"))


@_query
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_evidence(spark, sf_dir, evidence.facts)


@_query
def issue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_evidence(spark, sf_dir, evidence.issues)


@_query
def legal_basis_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_evidence(spark, sf_dir, evidence.legal_basis)


@_query
def reasoning_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_evidence(spark, sf_dir, evidence.court_reasoning)


@_query
def component_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.component_coverage(_evident(spark, sf_dir))


def _packs(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """Sections, decisions and evidence of each document from one row, packed without a join."""
    e = sections.split_sections(_evident(spark, sf_dir, "has_evidence", first=first).withColumnRenamed("text", "_chosen"), "text_en")
    return packs.packed(e, F.col("has_evidence"), F.lit(True), "doc_id")


@_query
def reasoning_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _packs(spark, sf_dir)
    return p.select("doc_id", "facts_inferred", *[_joined(c) for c in p.columns if c.endswith("_evidence")])


@_query
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.prompts(_packs(spark, sf_dir), None, "doc_id").select("doc_id", *_digest(F.col("prompt"), "prompt"))


@_query
def prompt_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document has one pack, so the first packs are those of the first documents: no other text is worked on."""
    return packs.prompts(_packs(spark, sf_dir, 3), 3, "doc_id").select("doc_id", *_digest(F.col("prompt"), "prompt"))


@_query
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("doc_id", packs.salvage_json(F.col("reply")).alias("json"))


@_query
def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.parse_replies(enriched(spark, sf_dir).select("doc_id", "reply"), "reply", "doc_id").select("doc_id", "facts", "decision", "raw_output", "parse_error")


def _references(spark: SparkSession, sf_dir: str, *keep: str, where: Column | None = None) -> DataFrame:
    e = enriched(spark, sf_dir)
    e = e if where is None else e.where(where)
    kind = F.when(F.col("meta_name").isNull(), "Unknown").otherwise(classify.case_type(F.col("meta_name")))
    return e.select("doc_id", *keep, kind.alias("case_type"), refs.order_tail(F.col("text_bn")).alias("reference_summary_bn"), F.lit("proxy_order_extraction").alias("reference_type"))


@_query
def proxy_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _references(spark, sf_dir)
    return r.select("doc_id", "case_type", "reference_type", _long(word_count(F.col("reference_summary_bn"))).alias("ref_len_words"), *_digest(F.col("reference_summary_bn"), "ref"))


@_query
def reference_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.reference_template(_references(spark, sf_dir), "doc_id")


def _pairs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """References and summaries of one row; a blank side leaves the pair out.

    A reference is blank where its text is, and so is a summary: the filter looks at the texts, before either is made.
    """
    both = (strip(F.col("text_bn")) != "") & (strip(F.col("summary_input")) != "")
    r = _references(spark, sf_dir, "summary_input", *keep, where=both)
    return r.select("doc_id", "case_type", F.col("reference_summary_bn").alias("ref"), models.lead_words(F.col("summary_input")).alias("hyp"), *keep)


@_query
def skipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _references(spark, sf_dir, "summary_input")
    h = models.summarize(r.select("doc_id", F.col("summary_input").alias("text")), "doc_id")
    return metrics.skipped(r, metrics.scoring_pairs(r, h, "doc_id"), "doc_id")


@_query
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    lens = [_long(word_count(F.col(c))).alias(f"{c}_len_words") for c in ("hyp", "ref")]
    t = p.select("doc_id", *lens, words(F.col("hyp")).alias("h"), words(F.col("ref")).alias("r"))
    t = metrics.rouge_of_tokens(t, (1, 2), "doc_id", ("hyp_len_words", "ref_len_words"))
    return t.select("doc_id", "hyp_len_words", "ref_len_words", *[F.round(c, 6).alias(c) for c in ("rouge1_p", "rouge1_r", "rouge1_f", "rouge2_f")])


@_query
def rouge_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.averages(metrics.rouge_n(_pairs(spark, sf_dir), 1, "doc_id"), ["rouge1_p", "rouge1_r", "rouge1_f"])


@_query
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rouge_l_scores(_pairs(spark, sf_dir), "doc_id").select("doc_id", F.round("rougeL_f", 6).alias("rougeL_f"))


@_query
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bleu_scores(_pairs(spark, sf_dir), "doc_id").select("doc_id", F.round("bleu", 6).alias("bleu"))


@_query
def factual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = metrics.factual_scores(_pairs(spark, sf_dir, "file_source").withColumnRenamed("file_source", "source"), "doc_id")
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in ("factual_precision", "factual_recall", "factual_f1")])


@_query
def bertscore_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    t = v.select(F.floor(F.col("vec_id") / 10).alias("pair_id"), F.when(F.col("vec_id") % 10 < 4, "hyp").otherwise("ref").alias("side"), F.col("vec_id").alias("tok"), F.col("embedding").alias("vec"))
    return metrics.greedy_match(t).select("pair_id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@_query
def anchor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.anchors(enriched_pages(spark, sf_dir)).select("page_id", _long(F.col("pos")).alias("pos"), "href", "link_text")


@_query
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = spark.createDataFrame([("https://supremecourt.gov.bd/resources/documents/7_WP.pdf",)], "pdf_url string")
    return ingest.harvest(enriched_pages(spark, sf_dir), failed=failed)


@_query
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ingest.anchors(enriched_pages(spark, sf_dir))
    return a.select("page_id", _long(F.col("pos")).alias("pos"), ingest.is_document_link(F.col("href")).alias("is_doc"), ingest.resolve(F.col("href")).alias("url"))


@_query
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ingest.readable(_documents(spark, sf_dir).select("doc_id", "text"))
    t = ingest.translate_chunks(d, models.identity, "doc_id", size=1000)
    n = d.select("doc_id", _long(F.size(ingest.chunks(F.col("text"), 1000))).alias("n_chunks"))
    return t.join(n, "doc_id").select("doc_id", "n_chunks", *_digest(F.col("translated"), "text"))


@_query
def utf8_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    f = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("x.txt").alias("source_file"), F.concat(F.col("text").cast("binary"), broken).alias("content"))
    return readers.strict_texts(f).select(F.col("id").alias("doc_id"), *_digest(F.col("text"), "text"))


@_query
def listing_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.walk_pages(listings(spark, sf_dir)).select("page_id", "listing", "page_no")


@_query
def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(url: str) -> bytes:
        if len(url) % 7 == 0:
            raise TimeoutError(url)
        return f"<p>{url}</p>".encode()

    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select("url").distinct()
    return models.fetch(urls, fn=body).select("url", F.col("content").cast("string").alias("body"), "error")


# Readers, sinks and lookups: tables are written as the sinks write them and read back ------------------------------


def _files_of(df: DataFrame, content: Column) -> DataFrame:
    return df.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), content.alias("content"))


@_query
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document, and the lenient scan of the folder: bad bytes go, line ends are unified."""
    path = new_path(spark, "texts")
    writers.export_text_files(_documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("\r\n"), F.substring("text", 1, 300), F.lit("\rend")).alias("text")), path, "doc_id")
    t = readers.text_folder(spark, path)
    return t.select(F.col("id").cast("long").alias("doc_id"), "source_file", *_digest(F.col("text"), "text"))


@_query
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    bad = F.when(F.col("lang") == "en", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    files = _files_of(d.where("lang is not null"), F.concat(F.col("text").cast("binary"), bad))
    t = readers.nullable_texts(d.select(F.col("doc_id").cast("string").alias("id")), files)
    return t.select(F.col("id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query
def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir)
    t = readers.defaulted_texts(e.select("doc_id"), e.where("file_bn is not null").select("doc_id", F.col("file_bn").alias("text")), "doc_id")
    return t.select("doc_id", *_digest(F.col("text"), "text"))


@_query
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir)
    en, bn = (e.where(f"{c} is not null").select("doc_id", F.md5(F.col(c).cast("binary")).alias("text")) for c in ("file_en", "file_bn"))
    return decisions.text_with_fallback(e.select("doc_id"), en, bn, "doc_id").select("doc_id", "text_source", F.col("text").alias("text_md5"))


@_query
def metadata_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata CSV, written and read: text with quotes, commas and line ends; the last of several rows an id wins."""
    path = new_path(spark, "metadata")
    e = enriched(spark, sf_dir)
    name = F.concat(F.lit(' "'), "case_name", F.lit('", or\n'), "source")
    e = e.select(F.col("doc_id").cast("string").alias("id"), name.alias("case_name"), F.lit("u").alias("pdf_url"), F.concat("doc_id", F.lit(".pdf")).alias("saved_file"), F.lit("o").alias("original_filename"))
    writers.write_csv(e, path)
    m = readers.metadata_csv(spark, path)
    return m.select(F.col("id").cast("long").alias("doc_id"), "case_name", "pdf_url", "saved_file")


@_query
def json_array_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array in one file, written and read by its stated schema."""
    path = new_path(spark, "references") + ".json"
    e = enriched(spark, sf_dir)
    r = e.select(F.col("doc_id").cast("string").alias("id"), classify.case_type(F.col("case_name")).alias("case_type"), F.concat(F.substring("text_bn", 1, 90), F.lit('"\\\t')).alias("reference_summary_bn"), F.lit(None).cast("string").alias("reference_type"))
    writers.write_json_array(r, path, "id")
    t = readers.json_array(spark, path, readers.REFERENCES)
    return t.select(F.col("id").cast("long").alias("doc_id"), "case_type", *_digest(F.col("reference_summary_bn"), "ref"), F.col("reference_type").isNull().alias("untyped"))


@_query
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as CSV and JSON, both read back."""
    path = new_path(spark, "metrics")
    s = _documents(spark, sf_dir).select("doc_id", "lang", (F.length("text") / 7.0).alias("score"))
    writers.write_metrics(s, path)
    c = spark.read.option("header", True).option("escape", '"').schema(s.schema).csv(f"{path}/csv")
    j = spark.read.schema(s.schema).json(f"{path}/json").select("doc_id", F.col("score").alias("json_score"))
    return c.join(j, "doc_id").select("doc_id", "lang", F.round("score", 6).alias("csv_score"), F.round("json_score", 6).alias("json_score"))


@_query
def checkpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches appended one by one; a batch that is replayed replaces itself."""
    path = new_path(spark, "batches")
    sink, d = writers.append_batch(path), _documents(spark, sf_dir).select("doc_id", "source")
    for batch, part in ((0, d.where("lang = 'en'")), (1, d.where("lang <> 'en' or lang is null")), (1, d.where("lang <> 'en' or lang is null"))):
        sink(part, batch)
    return spark.read.schema("doc_id long, source string").option("basePath", path).json(f"{path}/batch=*").select("doc_id", "source")


@_query
def pack_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack join over relations of their own, which lack rows."""
    e = enriched(spark, sf_dir)
    one = lambda c: F.array(F.coalesce(F.col(c), F.lit("-")))
    s = e.select("doc_id", F.col("lang").isNull().alias("facts_inferred"))
    ev = e.where("has_evidence").select("doc_id", one("source").alias("legal_issue_evidence"), one("lang").alias("relevant_fact_evidence"), one("case_name").alias("legal_basis_evidence"))
    d = e.where("has_decision").select("doc_id", one("case_name").alias("final_reasoning_evidence"), one("source").alias("final_decision_evidence"))
    p = packs.reasoning_packs(s, ev, d, "doc_id")
    return p.select("doc_id", "facts_inferred", *[_joined(c) for c in p.columns if c.endswith("_evidence")])


@_query
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence joined with a decision relation that lacks rows."""
    e = enriched(spark, sf_dir)
    d = e.where("has_decision").select("doc_id", F.array("source").alias("final_decision_evidence"))
    t = evidence.reasoning_evidence(e.select("doc_id", F.col("case_name").alias("text")), d, "doc_id")
    return t.select("doc_id", _joined("decision_evidence"), F.col("components_found.decision").alias("found"))


# The seams of models, with deterministic models --------------------------------------------------------------------


@_query
def translate_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk whose translation fails comes back as an empty one."""
    model = lambda c: F.when(c.contains("e"), F.upper(F.translate(c, "e", "3")))
    e = enriched(spark, sf_dir).select("doc_id", F.substring("text", 1, 400).alias("text")).where("text is not null")
    return ingest.translate_chunks(e, model, "doc_id", size=16).select("doc_id", *_digest(F.col("translated"), "text"))


@_query
def summarize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank texts have no summary; the model here gives the first five words."""
    def first_words(parts):
        for p in parts:
            yield p[["doc_id"]].assign(summary_bn=[" ".join(metrics.tokens_of(t)[:5]) for t in p["text"]])

    s = models.summarize(enriched(spark, sf_dir).select("doc_id", F.col("summary_input").alias("text")), "doc_id", model="five", fn=first_words)
    return s.select("doc_id", "model", "summary_bn")


@_query
def generate_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts through a model that answers in a fence, cuts one answer short, and the parser behind it."""
    def answer(parts):
        for p in parts:
            yield p[["doc_id"]].assign(reply=[f'Sure: ```json\n{{"facts": "{len(t)} characters", "decision": "{"x" * (len(t) % 3)}"' + ("}\n```" if len(t) % 4 else "") for t in p["prompt"]])

    prompts = enriched(spark, sf_dir).select("doc_id", F.concat(F.lit("Explain "), "case_name").alias("prompt"))
    r = packs.parse_replies(models.generate(prompts, "doc_id", answer), "reply", "doc_id")
    return r.select("doc_id", "facts", "decision", F.col("parse_error").isNotNull().alias("failed"))


@_query
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary files through the extractor; the stub drops bytes that are no UTF-8."""
    d = _documents(spark, sf_dir)
    files = d.select(F.concat(F.lit("dir/"), "doc_id", F.lit(".pdf")).alias("path"), F.concat(F.unhex(F.lit("FF")), F.substring("text", 1, 200).cast("binary")).alias("content"))
    return models.extract_pdf(files.where("content is not null")).select(F.col("id").cast("long").alias("doc_id"), "source_file", *_digest(F.col("text"), "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all)
