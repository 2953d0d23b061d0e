"""The one seam for models: an iterator of pandas frames in, an iterator of pandas frames out.

No model ships with the engine. Each stub is deterministic, so that pipelines run and can be tested; pass a callable
that loads a model once per task to replace it.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import lexicon as lex
from .functions.chars import words

Frames = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def identity(c: Column) -> Column:
    """Translation stub."""
    return c


def lead_words(c: Column, k: int = 30) -> Column:
    """Summary stub: the first ``k`` words."""
    return F.array_join(F.slice(words(F.coalesce(c, F.lit(""))), 1, k), " ")


def summarize(df: DataFrame, key: str = "id", text: str = "text", model: str = "lead", fn: Frames | None = None) -> DataFrame:
    """(key, model, summary_bn) of non-blank texts; ``fn`` maps frames (key, text) to (key, summary_bn)."""
    t = df.where(F.size(words(F.coalesce(F.col(text), F.lit("")))) > 0).select(key, F.col(text).alias("text"))
    if fn is None:
        return t.select(key, F.lit(model).alias("model"), lead_words(F.col("text")).alias("summary_bn"))
    out = t.mapInPandas(fn, f"{key} {t.schema[key].dataType.simpleString()}, summary_bn string")
    return out.select(key, F.lit(model).alias("model"), "summary_bn")


def generate(prompts: DataFrame, key: str = "id", fn: Frames | None = None) -> DataFrame:
    """(key, reply) for each prompt; the stub answers with an empty object in a fence."""
    if fn is None:
        return prompts.select(key, F.lit("```json\n" + json.dumps(dict.fromkeys(lex.EXPLANATION_FIELDS, "")) + "\n```").alias("reply"))
    return prompts.mapInPandas(fn, f"{key} {prompts.schema[key].dataType.simpleString()}, reply string")


def get_url(url: str, timeout: float = 60) -> bytes:
    """The body of a page; an error status or a time-out raises."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def fetch(urls: DataFrame, url: str = "url", fn: Callable[[str], bytes] = get_url) -> DataFrame:
    """(url, content, error) of each url: the body, or null and what ``fn`` raised; a failure stops no other row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for u in p[url]:
                try:
                    rows.append((u, fn(u), None))
                except Exception as failure:  # noqa: BLE001
                    rows.append((u, None, type(failure).__name__))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    return urls.select(url).mapInPandas(run, "url string, content binary, error string")


def extract_pdf(files: DataFrame, fn: Frames | None = None) -> DataFrame:
    """``binaryFile`` rows to (id, source_file, text); the stub reads the content as UTF-8 and drops bad bytes."""

    def stub(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            name = p["path"].str.rsplit("/", n=1).str[-1]
            yield pd.DataFrame({"id": name.str.replace(r"\.[^.]*$", "", regex=True), "source_file": name, "text": p["content"].map(lambda b: bytes(b).decode("utf-8", "ignore"))})

    return files.select("path", "content").mapInPandas(fn or stub, "id string, source_file string, text string")
