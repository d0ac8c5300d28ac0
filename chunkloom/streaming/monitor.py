"""Progress, windows, health and duplicate removal over message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.sketches import SIZE

# Health thresholds.
ERROR_SHARE_TENTHS = 3     # 3 of 10 messages failed
SLOW_P99 = 30.0            # seconds


def progress(messages: DataFrame) -> DataFrame:
    """Per operation the furthest step reached, from messages ``op, idx, total``."""
    return messages.groupBy("op").agg(
        F.count("*").alias("messages"), F.max("idx").alias("idx"), F.max("total").alias("total")
    )


def latest_progress(updates: DataFrame) -> DataFrame:
    """The last state of each operation with its percentage."""
    return updates.select("op", "messages", "idx", "total", (F.col("idx") * 100 / F.col("total")).alias("percent"))


def tumbling(events: DataFrame, delay: str = "1 hour", size: str = "1 day", once: str | None = None) -> DataFrame:
    """Messages per type and window; rows behind the watermark are dropped, and repeats of the id ``once`` if it is given."""
    rows = events.withWatermark("ts", delay)
    return (
        (rows.dropDuplicatesWithinWatermark([once]) if once else rows)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
    )


def health(events: DataFrame, delay: str = "1 hour", size: str = "1 day", slide: str = "12 hours") -> DataFrame:
    """Error share and P99 per sliding window, with the state they imply."""
    errors = F.count_if(F.col("event_type") == "error")
    p99 = F.percentile_approx("value", 0.99, 10_000)
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", size, slide))
        .agg(F.count("*").alias("n"), errors.alias("errors"), p99.alias("p99"))
        .select(
            F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "errors", "p99",
            F.when((F.col("errors") * 10 >= F.col("n") * ERROR_SHARE_TENTHS) | (F.col("p99") > SLOW_P99), "degraded")
            .otherwise("online").alias("state"),
        )
    )


def drop_repeats(events: DataFrame, delay: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Each message once, however often it was delivered within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def value_sketches(events: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """A sketch of the values per type and window, from which quantiles of any union of them follow."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count("value").alias("n"), F.kll_sketch_agg_double(F.col("value").cast("double"), SIZE).alias("sketch"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "sketch")
    )
