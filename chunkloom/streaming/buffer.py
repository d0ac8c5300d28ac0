"""A message buffer per channel: above 100 messages it shrinks to the newest 50.

How many are left after ``n`` messages follows from ``n`` alone, so the buffer needs the
message count and the newest 100. Channels are split into salts: a channel with a large
share of all messages is worked on by many tasks, and each salt hands over at most 100 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Buffer limits.
LIMIT = 100
SHRINK_TO = 50

SALTS = 16


def kept_count(n: Column) -> Column:
    """Messages in the buffer after ``n`` messages."""
    cycle = LIMIT - SHRINK_TO + 1
    return F.when(n <= LIMIT, n).otherwise(F.lit(SHRINK_TO) + (n - LIMIT - 1) % cycle)


def _newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_age", F.row_number().over(w)).filter(F.col("_age") <= LIMIT).drop("_age")


def last_messages(rows: DataFrame, channel: str, order: str, salts: int = SALTS) -> DataFrame:
    """The buffer contents per channel after all ``rows``, newest first (``age`` 1)."""
    counts = rows.groupBy(channel).agg(F.count("*").alias("_n"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    return _trim(_newest(salted, [channel, "_salt"], order).drop("_salt"), counts, channel, order)


def _trim(newest: DataFrame, counts: DataFrame, channel: str, order: str) -> DataFrame:
    w = Window.partitionBy(channel).orderBy(F.col(order).desc())
    return (
        newest.withColumn("age", F.row_number().over(w))
        .filter(F.col("age") <= LIMIT)
        .join(counts, channel)
        .filter(F.col("age") <= kept_count(F.col("_n")))
        .drop("_n")
    )


class _Newest(StatefulProcessor):
    """Keeps the newest order values and the count of one salted channel."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "n bigint, ids array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, ids = self.state.get() if self.state.exists() else (0, [])
        held = np.array(ids, np.int64)
        for part in rows:
            n += len(part)
            held = np.concatenate([held, part.iloc[:, -1].to_numpy(np.int64)])
            if len(held) > LIMIT:  # linear: only the newest are told apart from the rest
                held = np.partition(held, len(held) - LIMIT)[-LIMIT:]
        ids = held.tolist()
        self.state.update((int(n), ids))
        yield pd.DataFrame({"channel": [key[0]], "salt": [key[1]], "n": [n], "ids": [ids]})

    def close(self) -> None:
        pass


def buffer_updates(stream: DataFrame, channel: str, order: str, salts: int = SALTS) -> DataFrame:
    """A stream of the state of every salted channel that got messages."""
    salted = stream.select(
        F.col(channel).alias("channel"),
        F.pmod(F.xxhash64(order), F.lit(salts)).cast("int").alias("salt"),
        F.col(order).cast("bigint").alias("id"),
    )
    return salted.groupBy("channel", "salt").transformWithStateInPandas(
        statefulProcessor=_Newest(),
        outputStructType="channel string, salt int, n bigint, ids array<bigint>",
        outputMode="Update",
        timeMode="None",
    )


def buffer_contents(updates: DataFrame) -> DataFrame:
    """``channel, id, age`` of the buffered messages, from the last state of each salt."""
    counts = updates.groupBy("channel").agg(F.sum("n").alias("_n"))
    ids = updates.select("channel", F.explode_outer("ids").alias("id"))
    return _trim(ids, counts, "channel", "id")
