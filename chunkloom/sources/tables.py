"""Reading the given parquet tables and shaping them as a corpus."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.text import is_blank, stem, with_name_prefix
from chunkloom.session import spread, write_through


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A parquet table; ``spread_by`` names a unique key to use all cores on a small one."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, spread_by) if spread_by else df


def load_corpus(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, text)`` of all files with some text, prefixed with the file name."""
    return files.filter(~is_blank(text)).select(
        F.col(path).alias("path"),
        with_name_prefix(stem(path), text).alias("text"),
    )


def document_files(documents: DataFrame) -> DataFrame:
    """The ``documents`` table as stored files: ``/data/docs/<source>/<doc_id>.txt``."""
    return documents.withColumn(
        "path",
        F.concat(F.lit("/data/docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")),
    )


def union_corpora(*parts: DataFrame, paths: list[DataFrame] | None = None) -> DataFrame:
    """All corpora ``(path, text)`` with each path once; an earlier corpus wins, inside of one the smaller text.

    Repeated paths are found on paths alone and written, so their size is known to the planner: while they
    are few, all other texts stay where they are. ``paths`` can list the paths that each corpus could have, where that is
    cheaper to know than the corpus itself (a page's name without its text).
    """
    tagged = None
    for i, part in enumerate(parts):
        rows = part.select("path", "text", F.lit(i).alias("_order"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    named = functools.reduce(DataFrame.unionByName, [p.select("path") for p in paths]) if paths else tagged.select("path")
    repeated = named.groupBy("path").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("path")
    repeated = write_through(repeated, "repeated-paths")
    once = tagged.join(repeated, "path", "left_anti").select("path", "text")
    again = tagged.join(repeated, "path", "left_semi")
    return once.unionByName(again.groupBy("path").agg(F.min(F.struct("_order", "text"))["text"].alias("text")))
