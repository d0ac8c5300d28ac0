"""Keyed state over message streams: health by count of outcomes, and messages that expire unanswered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# 3 failures among the last 10 messages degrade a module, 5 successes in a row bring it back.
RING, FAILURES, SUCCESSES = 10, 3, 5

#: Shares that a channel's requests are dealt to; answers go to each of them.
SALTS = 4

#: Parts that the shares of all channels are dealt to; each is one state, worked on by one task at a time.
PARTS = 1024


def health_states(failed: np.ndarray, before: np.ndarray, degraded: bool) -> tuple[np.ndarray, np.ndarray]:
    """(degraded, failures among the last ``RING``) after each outcome. ``before``: earlier outcomes, the last ``RING`` of them at most.

    A run of ``SUCCESSES`` successes wins over failures further back in the ring; otherwise ``FAILURES`` of them degrade; else the state stays.
    """
    n, m = len(failed), len(before)
    ends = np.concatenate([[0], np.cumsum(np.concatenate([before, failed]).astype(np.int64))])
    at = np.arange(m + 1, m + n + 1)

    def last(k: int) -> np.ndarray:
        return ends[at] - ends[np.maximum(at - k, 0)]

    well = (at >= SUCCESSES) & (last(SUCCESSES) == 0)
    ill = ~well & (last(RING) >= FAILURES)
    told = np.where(well | ill, np.arange(n), -1)
    newest = np.maximum.accumulate(told) if n else told
    return np.where(newest < 0, degraded, ill[np.maximum(newest, 0)]), last(RING)


def _texts(values: list[str]) -> pd.Series:
    return pd.Series(values, dtype=object)


class _Health(StatefulProcessor):
    """Keeps a module's last outcomes and its state; tells each change of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "ring array<boolean>, degraded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring, degraded = self.state.get() if self.state.exists() else ([], False)
        # outcomes of one module in one micro-batch: nine bytes each
        parts = [(p["seq"].to_numpy(), p["failed"].to_numpy(bool)) for p in rows]
        seq, failed = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(seq, kind="stable")
        seq, failed = seq[order], failed[order]
        before = np.array(ring, bool)
        now, count = health_states(failed, before, bool(degraded))
        changed = np.flatnonzero(now != np.concatenate([[degraded], now[:-1]]))
        held = np.concatenate([before, failed])[-RING:]
        self.state.update(([bool(x) for x in held], bool(now[-1])))
        states = ["degraded" if x else "online" for x in now[changed]]
        yield pd.DataFrame({"module": _texts([key[0]] * len(changed)), "seq": seq[changed], "state": _texts(states), "failures": count[changed].astype(np.int32)})

    def close(self) -> None:
        pass


def health_changes(messages: DataFrame, module: str, order: str, failed) -> DataFrame:
    """A stream of state changes ``module, seq, state, failures`` of ``messages``; every module starts online.

    The rule depends on the order of a module's messages, so they meet in one task; what it holds for them is one number and one
    flag each, for a micro-batch. ``order`` rises from batch to batch.
    """
    rows = messages.select(F.col(module).cast("string").alias("module"), F.col(order).cast("bigint").alias("seq"), F.coalesce(failed, F.lit(False)).alias("failed"))
    return rows.groupBy("module").transformWithStateInPandas(
        statefulProcessor=_Health(), outputStructType="module string, seq bigint, state string, failures int", outputMode="Append", timeMode="None",
    )


#: What state holds of a message; the channel comes with it, as many channels share a part.
_MESSAGE = pa.schema([("channel", pa.string()), ("id", pa.int64()), ("at", pa.int64()), ("due", pa.int64()), ("is_answer", pa.bool_())])


def open_messages(rows: pd.DataFrame, watermark: int) -> pd.DataFrame:
    """Of ``rows`` (channel, id, at, due, is_answer) the requests without an answer in time, and the answers not older than ``watermark``.

    Times are microseconds. Of requests of one channel with one id the first stands, of answers of one channel and time one.
    """
    channel = pd.factorize(rows["channel"], use_na_sentinel=False)[0].astype(np.int64)
    at, due, answer = rows["at"].to_numpy(np.int64), rows["due"].to_numpy(np.int64), rows["is_answer"].to_numpy(bool)
    # one number that orders by channel, then by time
    place = channel * len(rows) + np.unique(at, return_inverse=True)[1]
    answers, first = np.unique(place[answer], return_index=True)
    first = np.flatnonzero(answer)[first]
    asked = np.flatnonzero(~answer)
    asked = asked[~pd.DataFrame({"channel": channel[asked], "id": rows["id"].to_numpy()[asked]}).duplicated().to_numpy()]
    # the first answer from a request's time on, if its channel has one
    after = np.searchsorted(answers, place[asked])
    theirs, when = np.append(channel[first], -1)[after], np.append(at[first], 0)[after]
    answered = (theirs == channel[asked]) & (when <= due[asked])
    return rows.iloc[np.concatenate([asked[~answered], first[at[first] >= watermark]])]


class _Expiry(StatefulProcessor):
    """Open requests of one part and the answers that requests still to come can have; one timer, for the request that ends first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "messages binary, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        came = [p[_MESSAGE.names] for p in rows]
        # requests still to come are not older than the watermark, nor is an answer to them
        self._hold(pd.concat([held, *came], ignore_index=True), timer, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        # all that is over by now, not only what this timer stands for
        over = ~held["is_answer"] & (held["due"] // 1000 < max(watermark - 1, expiredTimerInfo.getExpiryTimeInMs()))
        self._hold(held[~over], timer, watermark)
        told = held[over]
        yield pd.DataFrame({"channel": _texts(told["channel"].tolist()), "id": told["id"].to_numpy(), "due": pd.to_datetime(told["due"].to_numpy(), unit="us", utc=True)})

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        if not self.state.exists():
            return _MESSAGE.empty_table().to_pandas(), None
        messages, timer = self.state.get()
        return pa.ipc.open_stream(bytes(messages)).read_all().to_pandas(), timer

    def _hold(self, rows: pd.DataFrame, timer: int | None, watermark: int) -> None:
        rows = open_messages(rows, watermark * 1000)
        if rows.empty:
            self.state.clear()
            return
        due = rows["due"][~rows["is_answer"].astype(bool)]
        if len(due):
            first = int(due.min()) // 1000 + 1
            # a timer behind the watermark fires in this batch; one that no request waits for any more does no harm
            if timer is None or first < timer or timer < watermark:
                if first != timer:
                    self.handle.registerTimer(first)
                timer = first
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _MESSAGE) as writer:
            writer.write_table(pa.Table.from_pandas(rows, _MESSAGE, preserve_index=False))
        self.state.update((out.getvalue().to_pybytes(), timer))

    def close(self) -> None:
        pass


def expired(messages: DataFrame, delay: str = "1 hour", salts: int = SALTS, parts: int = PARTS) -> DataFrame:
    """A stream of requests that nobody answered in time: ``channel, id, due``.

    ``messages``: channel, id, ts, ttl (seconds, of this very message; null for an answer) and is_answer. A request is answered by any answer on its
    channel from its time to its end (``ts + ttl``), both included, whichever of them arrives first. When the watermark has passed the end, a timer tells
    the unanswered ones. Messages that come later than ``delay`` behind are dropped, as are those without a time; repeats count once. Requests of one
    channel are dealt to ``salts`` shares and answers go to all, so a busy channel is worked on by several tasks. The shares of all channels are dealt to
    ``parts``, each with one state and one timer at work, so what a state costs is paid for a part and not for every channel or request. A part that
    gets messages is written anew: more parts are smaller ones.
    """
    micros = F.unix_micros("ts")
    rows = messages.withWatermark("ts", delay).filter(F.col("ts").isNotNull()).select(
        F.col("channel").cast("string").alias("channel"), "ts", F.col("id").cast("bigint").alias("id"), micros.alias("at"),
        (micros + F.coalesce(F.col("ttl"), F.lit(0)).cast("bigint") * 1_000_000).alias("due"), F.coalesce("is_answer", F.lit(False)).alias("is_answer"),
        F.when(F.col("is_answer"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))).alias("salts"),
    )
    # an answer goes to a part once, however many shares of its channel are there
    dealt = F.transform("salts", lambda salt: F.pmod(F.xxhash64("channel", salt), F.lit(parts)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.array_distinct(dealt))).drop("salts")
    return rows.groupBy("part").transformWithStateInPandas(
        statefulProcessor=_Expiry(), outputStructType="channel string, id bigint, due timestamp", outputMode="Append", timeMode="EventTime",
    )
