"""Stored web pages: visible text, title and the document kept for a page."""

from __future__ import annotations

import html as _html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions.text import GAP, is_blank, md5_short, strip, with_name_prefix
from chunkloom.model import PAGE_SOURCE, PAGE_TIME, PAGE_TITLE

# Comments, scripts, styles, declarations and tags, whichever comes first; quoted
# attribute values may hold a closing bracket.
MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>"
    r"|</?[a-z!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-z!?][^>]*+>"
)
TITLE = r"(?is)<title\b[^>]*+>(.*?)</title\s*+>"
ENTITY = r"&#?[A-Za-z0-9]+;?"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decode(entities: pa.Array) -> pa.Array:
    return pa.array([None if e is None else [_html.unescape(x) for x in e] for e in entities.to_pylist()],
                    pa.list_(pa.string()))


# Called non-deterministic so that a later filter is not pushed below it, which would
# decode everything twice.
_decode = _decode.asNondeterministic()


def _decoded(df: DataFrame, source: Column, out: str) -> DataFrame:
    """Replace character references. Only the references themselves go through Python."""
    raw, parts, found = f"_{out}_raw", f"_{out}_parts", f"_{out}_found"
    df = df.withColumn(raw, source)
    df = df.withColumn(parts, F.split(raw, ENTITY)).withColumn(
        found, _decode(F.regexp_extract_all(raw, F.lit(ENTITY), F.lit(0)))
    )
    # The pieces between references outnumber them by one.
    woven = F.array_join(
        F.transform(F.col(parts), lambda p, i: F.concat(p, F.coalesce(F.get(found, i), F.lit("")))), ""
    )
    return df.withColumn(out, woven).drop(raw, parts, found)


def page_text(pages: DataFrame) -> DataFrame:
    """Add ``title`` (the url without one) and ``text``; pages without text are dropped."""
    df = _decoded(pages, F.regexp_extract("html", TITLE, 1), "title")
    df = df.withColumn("title", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")))
    df = _decoded(df, F.regexp_replace("html", MARKUP, ""), "text")
    df = df.withColumn("text", strip(F.regexp_replace("text", GAP, " ")))
    return df.filter(~is_blank("text"))


def page_documents(pages: DataFrame, crawled_at: str) -> DataFrame:
    """``(path, title, text)``: the file stored for a page, three header lines and the text."""
    name = md5_short("url")
    header = F.concat(
        F.lit(PAGE_TITLE), F.col("title"), F.lit(f"]\n{PAGE_SOURCE}"), F.col("url"),
        F.lit(f"]\n{PAGE_TIME}{crawled_at}]\n\n"),
    )
    return page_text(pages).select(
        F.concat(F.lit("/data/web/"), name, F.lit(".txt")).alias("path"),
        "title",
        F.concat(header, F.col("text")).alias("text"),
    )


def page_corpus(pages: DataFrame, crawled_at: str) -> DataFrame:
    """Page documents as a corpus: the text starts with its file name."""
    d = page_documents(pages, crawled_at)
    stem = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return d.select("path", "title", with_name_prefix(stem, "text").alias("text"))
