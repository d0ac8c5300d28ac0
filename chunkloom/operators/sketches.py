"""Quantiles from mergeable KLL sketches.

A sketch holds a group's values in a few kilobytes, whatever their number. Sketches are made with map-side combine,
kept in a table, and merged upwards (days to weeks, folders to a corpus) without another look at the values. With ``SIZE`` the
rank of an answer is off by less than ``RANK_ERROR`` of the number of values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, RANK_ERROR = 800, 0.01


def sketch(df: DataFrame, value: str, by: list[str], size: int = SIZE) -> DataFrame:
    """``*by, n, sketch`` of the values of each group; nulls don't count, a group of nulls has n = 0 and no quantile."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merge(sketches: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """A row for each group and share in place of its sketch: ``p`` and ``quantile``."""
    kept = [c for c in sketches.columns if c != "sketch"]
    at = F.array(*[F.lit(float(p)) for p in shares])
    unknown = F.array_repeat(F.lit(None).cast("double"), len(shares))
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", at)).otherwise(unknown)
    return sketches.select(*kept, F.posexplode_outer(F.arrays_zip(at.alias("p"), found.alias("quantile")))).select(*kept, "col.p", "col.quantile")


def rank_check(df: DataFrame, value: str, answers: DataFrame, by: list[str], error: float = RANK_ERROR) -> DataFrame:
    """``answers`` (``*by, n, p, quantile``) with ``inside``: whether the true rank of the quantile is within ``error`` of ``p``.

    Values are counted against the answers of their group, with map-side combine; nothing is sorted.
    """
    asked = answers.groupBy(*by).agg(F.collect_list(F.struct("p", "quantile")).alias("_asked"))
    met = df.select(*by, F.col(value).cast("double").alias("_v")).join(asked, by).select(*by, "_v", F.inline("_asked"))
    counted = met.groupBy(*by, "p").agg(F.count_if(F.col("_v") < F.col("quantile")).alias("_below"), F.count_if(F.col("_v") <= F.col("quantile")).alias("_to"))
    inside = (F.col("_below") <= (F.col("p") + error) * F.col("n")) & (F.col("_to") >= (F.col("p") - error) * F.col("n"))
    return answers.join(counted, [*by, "p"], "left").withColumn("inside", F.coalesce(inside, F.col("n") == 0)).drop("_below", "_to")
