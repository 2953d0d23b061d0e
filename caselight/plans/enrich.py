"""The enriched view: ``documents`` with the lines that trigger the operators, chosen by ``doc_id``.

Each column is one SQL expression that Spark and DuckDB read alike (``concat``, ``CASE``, ``%``, ``chr``, ``repeat``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread


def _lines(cond: str, *ls: str) -> str:
    body = ", ".join((f"'{s}'" if not s.startswith("@") else s[1:]) + ", chr(10)" for s in ls)
    return f"CASE WHEN {cond} THEN concat({body}) ELSE '' END"


TEXT_EN = "concat(" + ", ".join([
    _lines("doc_id % 4 = 0", "Supreme Court of Bangladesh", "  HIGH COURT DIVISION  "),
    _lines("doc_id % 8 = 2", "Judgment on: 24.08.2026"),
    _lines("doc_id % 3 = 0", "Page 3 of 9", "- 12 -", "১২", "12a"),
    _lines("doc_id % 5 = 0", " www.example.test ", "CERTIFIED COPY"),
    _lines("doc_id % 6 = 1", "The preamble of the matter stands before any heading."),
    _lines("doc_id % 3 = 1", "Facts of the case", "The petitioner joined the service on 3 May 2001 and the petitioner retired in due course.", "It is admitted that the respondent company failed to pay the pension benefits in time."),
    "text", "chr(10)",
    _lines("doc_id % 5 IN (0, 1)", "CERTIFIED COPY", "  CERTIFIED COPY", "CERTIFIED COPY"),
    _lines("doc_id % 5 = 1", "CERTIFIED COPY", "SAME FOOTER", "SAME FOOTER", "SAME FOOTER"),
    _lines("doc_id % 2 = 0", "The respon-", "dent and pre- ", "fix and ক-", "দ and া-", "দ stand here.   ", "", "", "", "A new part begins here."),
    _lines("doc_id % 9 = 4", "@concat('first', chr(28), 'second', chr(13))", "@concat('third', chr(160), 'fourth')"),
    _lines("doc_id % 4 = 1", "Heard the learned Advocate for the parties at length.", "He submits that the order of the tribunal was passed without notice to the petitioner.", "The learned advocate submits that whether notice was served is beyond doubt in this matter."),
    _lines("doc_id % 10 = 3", "The following issues arise for determination by this court in the present rule.", "Whether the order was passed by Mr. Rahman in accordance with law and procedure?", "Secondly, the limitation of the appeal has to be considered by this court too.", "Issue No. 2 concerns the maintainability of the petition before this court."),
    _lines("doc_id % 10 = 7", "It has to be seen whether the notice was duly served upon the petitioner company.", "It has to be seen whether the notice was duly served upon the petitioner company.", "It has to be seen whether the notice was duly served upon the petitioner company.", "It must be asked whether the second respondent was heard before the order."),
    _lines("doc_id % 6 = 2", "Under section 51 of the Specific Relief Act, 1877 and Article 102 of the Constitution the petition lies.", "Order XXI rule 90 of the Code of Civil Procedure governs the sale in question here."),
    _lines("doc_id % 7 IN (1, 2, 3)", "It appears that the respondents refrained from payment without any lawful authority.", "We find that the authority acted beyond the powers conferred on it by the statute. Therefore the order cannot be relied upon."),
    _lines("doc_id % 7 = 3", "In view of the above discussion we find merit in the rule.", "Accordingly, the Rule is made absolute without any order as to costs."),
    _lines("doc_id % 7 = 4", "In the result, the appeal is dismissed and the order is set-aside , with no order as to costs ."),
    _lines("doc_id % 7 = 5", "এই আবেদন খারিজ করা হইল। মামলার নথি ফেরত পাঠানো হউক এবং নির্দেশ পালন করা হউক।"),
    _lines("doc_id % 20 = 9", "@repeat('The appeal is allowed in this matter of record. ', 13)"),
]) + ")"

TEXT_BN = "concat(" + ", ".join([
    _lines("doc_id % 4 = 0", "সুপ্রিম কোর্ট বাংলাদেশ", "পৃষ্ঠা ৩", "Page 4"),
    _lines("doc_id % 3 <> 2", "@repeat('মামলার বিবরণ এইরূপ যে বাদী আদালতে আসেন ', 22)"),
    _lines("doc_id % 5 = 0", "cafe\u0301 re\u0301sume\u0301"),
    _lines("doc_id % 2 = 0", "শুনানি শেষ. আবার শুনানি হয়. C.R. No. ৫ বিবেচিত হয়", "This line is left in English only", "abc ক", "abcdefg কখগ"),
    _lines("doc_id % 5 = 3", "@repeat('পরবর্তী অনুচ্ছেদ ', 9)", "@repeat('অতএব আবেদন নামঞ্জুর করা হইল ', 9)"),
    _lines("doc_id % 6 = 1", "@repeat('সুতরাং বিধি অনুযায়ী সিদ্ধান্ত দেওয়া হইল ', 45)"),
    _lines("doc_id % 6 = 4", "@repeat('সাধারণ কথা লেখা আছে ', 30)", "আদেশ জারি হউক"),
    "source", "chr(10)",
]) + ")"

CASE_NAME = (
    "CASE WHEN doc_id % 5 = 0 THEN concat('Writ Petition ', CAST(doc_id AS STRING), '/2019(Dhaka)') WHEN doc_id % 5 = 1 THEN 'Company Matter (TN) 709/2026' "
    "WHEN doc_id % 5 = 2 THEN 'Appeal' WHEN doc_id % 5 = 3 THEN '  ' ELSE concat(' Criminal Misc. Case No. ', CAST(doc_id AS STRING), ' ') END"
)

REPLY = (
    "CASE WHEN doc_id % 6 = 0 THEN concat('Here it is: ', repeat('`', 3), 'json', chr(10), '{\"facts\": \"f', CAST(doc_id AS STRING), '\", \"decision\": \"allowed\"}', chr(10), repeat('`', 3), ' done') "
    "WHEN doc_id % 6 = 1 THEN concat('{\"facts\": \"bare\", \"decision\": \"', source, '\"}') WHEN doc_id % 6 = 2 THEN '{\"facts\": \"cut' WHEN doc_id % 6 = 3 THEN '[1]' "
    "WHEN doc_id % 6 = 4 THEN concat('no braces in ', source) ELSE concat(repeat('`', 3), '{\"facts\": \"x\", \"decision\": \"y\"}', repeat('`', 3)) END"
)

HTML = (
    "concat(html, '<a class=\"x\" href=\"/resources/documents/', CAST(page_id % 40 AS STRING), '_WP.pdf\"> Writ <b>', CAST(page_id % 40 AS STRING), '</b> </a>', "
    "CASE WHEN page_id % 3 = 0 THEN concat('<A HREF=''../resources/documents/a/../', CAST(page_id AS STRING), '.PDF''>Rel</A>') ELSE '' END, "
    "CASE WHEN page_id % 5 = 0 THEN '<a href=\"https://example.test/resources/documents/same.pdf\">Same</a>' ELSE '' END, '<a href=\"\">none</a>')"
)

#: Rows that a side input lacks, as data: null for a missing file or row, blank for an empty one.
FILE_EN = f"CASE WHEN doc_id % 6 <> 5 THEN {TEXT_EN} END"
FILE_BN = f"CASE WHEN doc_id % 12 <> 11 THEN {TEXT_BN} END"
FILE_SOURCE = f"CASE WHEN doc_id % 8 <> 5 THEN {TEXT_EN} END"
META_NAME = f"CASE WHEN doc_id % 10 <> 9 THEN {CASE_NAME} END"
SUMMARY_INPUT = f"CASE WHEN doc_id % 9 <> 4 THEN {TEXT_BN} ELSE '' END"
HAS_SECTIONS, HAS_DECISION, HAS_EVIDENCE = "doc_id % 11 <> 5", "doc_id % 13 <> 1", "doc_id % 17 <> 3"

COLUMNS = {"text_en": TEXT_EN, "text_bn": TEXT_BN, "case_name": CASE_NAME, "reply": REPLY}
GAPS = {
    "file_en": FILE_EN, "file_bn": FILE_BN, "file_source": FILE_SOURCE, "meta_name": META_NAME, "summary_input": SUMMARY_INPUT,
    "has_sections": HAS_SECTIONS, "has_decision": HAS_DECISION, "has_evidence": HAS_EVIDENCE,
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def enriched(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """``first``: only the rows of so many first keys, chosen before anything is computed from their texts.

    The keys are joined, as Spark moves projections below a mere limit.
    """
    d = documents(spark, sf_dir)
    if first is not None:
        keys = d.select(F.col("doc_id").alias("_k")).orderBy("_k").limit(first)
        d = d.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("_k")), "left_semi")
    return d.selectExpr("doc_id", "text", "lang", "source", *[f"{e} AS {n}" for n, e in (COLUMNS | GAPS).items()])


#: Listings of seven pages each, most of which link to the next; a page at times repeats the one before.
LISTING = {
    "listing": "page_id - page_id % 7", "page_no": "page_id % 7",
    "html": "concat('<a href=\"/l\">first</a>', CASE WHEN page_id % 5 = 4 THEN '' ELSE '<a class=\"n\" href=\"#\"><b>Next</b> page</a>' END, CASE WHEN page_id % 11 IN (6, 7) THEN 'same' ELSE url END)",
}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", *[f"{e} AS {n}" for n, e in LISTING.items()])


def enriched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", f"{HTML} AS html")


CTE = "enr AS (SELECT doc_id, text, lang, source, " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM documents)"
CTE_LISTINGS = "ls AS (SELECT page_id, " + ", ".join(f"{e} AS {n}" for n, e in LISTING.items()) + " FROM pages)"
CTE_PAGES = f"pg AS (SELECT page_id, url, {HTML} AS html FROM pages)"
