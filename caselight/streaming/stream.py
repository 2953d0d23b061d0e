"""Streams: the per-row operators over a file stream, and first-wins dedupe of links.

Cleaning, sectioning, sentence and evidence columns hold no state, so they run on streams as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import word_count
from ..operators.classify import doc_type
from ..operators.clean import clean_en
from ..operators.ingest import BASE, anchors, is_document_link, resolve
from ..sources.writers import append_batch


def text_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def cleaned(stream: DataFrame) -> DataFrame:
    t = stream.withColumn("text", clean_en(F.col("text"))).withColumn("word_count", word_count(F.col("text")))
    return t.withColumn("doc_type", doc_type(F.col("word_count")))


def new_links(pages: DataFrame, base: str = BASE) -> DataFrame:
    """Each document link once over the life of the stream."""
    t = anchors(pages).where(is_document_link(F.col("href")))
    return t.select("page_id", resolve(F.col("href"), base).alias("pdf_url"), "link_text").dropDuplicates(["pdf_url"])


def start(df: DataFrame, out: str, checkpoint: str):
    """Process what is there and stop; every batch is durable once written."""
    return df.writeStream.foreachBatch(append_batch(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
