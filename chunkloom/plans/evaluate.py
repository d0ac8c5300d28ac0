"""How well search finds the documents that hold a benchmark passage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.containment import containing


def passage_sources(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``query_id, source`` of the documents that contain a passage verbatim."""
    needles = passages.select("query_id", F.col("text").alias("needle"))
    texts = docs.select(F.col("path").alias("source"), "text")
    return containing(texts, "source", needles).select("query_id", "source")


def retrieval_scores(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """Over the queries with at least one true document: their number, the share with a
    true document among the hits, and the mean reciprocal rank of the first."""
    first = (
        hits.join(truth, ["query_id", "source"], "left_semi")
        .groupBy("query_id").agg(F.min("rank").alias("first"))
    )
    asked = truth.select("query_id").distinct().join(first, "query_id", "left")
    gain = F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))
    return asked.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(gain), 6).alias("mrr"),
    )
