import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunkloom.streaming import monitor, runs, states

BASE = dt.datetime(2024, 1, 1)


def plain_health(failed):
    degraded, out = False, []
    for i in range(len(failed)):
        ring = failed[max(0, i - 9):i + 1]
        if len(ring) >= 5 and not any(ring[-5:]):
            degraded = False
        elif sum(ring) >= 3:
            degraded = True
        out.append(degraded)
    return out


@pytest.mark.parametrize("share", [0.1, 0.3, 0.6])
def test_health_rule_in_any_cut_of_the_messages(share):
    rng = random.Random(share)
    failed = [rng.random() < share for _ in range(400)]
    want = plain_health(failed)
    for cut in (0, 1, 3, 9, 10, 200, 400):
        first, _ = states.health_states(np.array(failed[:cut], bool), np.array([], bool), False)
        held = failed[max(0, cut - 10):cut]
        rest, _ = states.health_states(np.array(failed[cut:], bool), np.array(held, bool), bool(first[-1]) if cut else False)
        assert first.tolist() + rest.tolist() == want


def test_hysteresis_by_hand():
    ok, no = False, True
    run = lambda *x: states.health_states(np.array(x, bool), np.array([], bool), False)[0].tolist()
    assert run(no, ok, no, no) == [False, False, False, True]
    assert run(no, no, no, ok, ok, ok, ok, ok, no) == [False, False, True, True, True, True, True, False, True]
    assert run(no, no, *[ok] * 8, no) == [False] * 11


def test_health_over_restarts(spark):
    rng = random.Random(2)
    rows = [(f"m{i % 3}", i, rng.random() < 0.35 if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "module string, seq bigint, failed boolean")
    parts = [df.filter(F.col("seq").between(a, a + 99)).orderBy(F.rand(3)) for a in (0, 100, 200)]
    with runs.keyed_state(spark):
        out = runs.run_staged(parts, lambda s: states.health_changes(s, "module", "seq", F.col("failed")), "health")
    want = []
    for m in ("m0", "m1", "m2"):
        own = [(i, bool(f)) for k, i, f in rows if k == m]
        now = plain_health([f for _, f in own])
        want += [(m, i, "degraded" if x else "online") for (i, _), x, was in zip(own, now, [False, *now], strict=False) if x != was]
    assert sorted((r.module, r.seq, r.state) for r in out.collect()) == sorted(want) and want


def message(channel, i, hour, ttl=None):
    """A request that waits ``ttl`` hours, or an answer."""
    return channel, i, BASE + dt.timedelta(hours=hour), None if ttl is None else ttl * 3600, ttl is None


@pytest.mark.parametrize("salts", [1, 5])
def test_messages_expire_by_their_own_time(spark, salts):
    schema = "channel string, id bigint, ts timestamp, ttl int, is_answer boolean"
    part = lambda *rows: spark.createDataFrame(list(rows), schema)
    parts = [
        part(message("a", 1, 0, 2), message("a", 2, 0, 40), message("b", 3, 1, 5), message("a", 4, 1.5, 1), message("c", 5, 2, 1), message("c", 5, 2, 1),
             message("d", 11, 9.5)),
        # an answer for 2 on channel a; 1 and 4 are over by then; a request that comes after its answer; a repeat
        part(message("a", 6, 10), message("b", 7, 10, 3), message("d", 10, 9.4, 30), message("a", 2, 0, 40)),
        # late by days: neither the answer for 3 nor the request count
        part(message("b", 8, 2), message("b", 9, 3, 1), message("e", 12, 200)),
        part(message("e", 13, 400, 1)),
    ]
    with runs.keyed_state(spark):
        out = runs.run_staged(parts, lambda s: states.expired(s, "1 hour", salts), "expired")
    rows = sorted((r.channel, r.id, (r.due - BASE).total_seconds() / 3600) for r in out.collect())
    assert rows == [("a", 1, 2.0), ("a", 4, 2.5), ("b", 3, 6.0), ("b", 7, 13.0), ("c", 5, 3.0)]


def test_late_and_repeated_messages_in_windows(spark):
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    part = lambda *rows: spark.createDataFrame([(i, BASE + dt.timedelta(hours=h), "t", 1.0) for i, h in rows], schema)
    parts = [part((1, 1), (2, 30)), part((2, 30), (3, 29.5), (1, 1)), part((4, 2), (5, 29.2), (5, 29.2)), part((6, 200))]
    out = runs.run_staged(parts, lambda s: monitor.tumbling(s, once="event_id"), "late")
    assert sorted((r.start.day, r.n) for r in out.collect()) == [(1, 1), (2, 3)]


class Held:
    """A state of one value and the timers of a part, as the processor sees them."""

    def __init__(self):
        self.value, self.timers, self.writes = None, [], 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.watermark - 1


def test_one_timer_and_one_write_for_all_requests_that_end():
    held, step = Held(), states._Expiry()
    step.init(held)
    held.watermark = 0
    asked = [(f"c{i % 40}", i, i * 1000, i * 1000 + 5_000_000, False) for i in range(400)]
    # c0 is answered in time, c1 a moment late, an answer without a request stays for one to come
    answers = [("c0", 900, 5_000_000, 5_000_000, True), ("c1", 901, 9_000_000, 9_000_000, True), ("x", 902, 9_000_000, 9_000_000, True)]
    rows = pd.DataFrame(asked + asked[:50] + answers, columns=["channel", "id", "at", "due", "is_answer"])
    assert list(step.handleInputRows((0,), iter([rows[:100], rows[100:]]), held)) == []
    assert len(held.timers) == 1 and held.writes == 1
    held.watermark = 5_200
    told = pd.concat(step.handleExpiredTimer((0,), held, held))
    assert sorted(told["id"]) == [i for i in range(1, 199) if i % 40] and set(told["channel"]) == {f"c{i}" for i in range(1, 40)}
    assert len(held.timers) == 2 and held.writes == 2
    held.watermark = 10_000
    told = pd.concat(step.handleExpiredTimer((0,), held, held))
    assert sorted(told["id"]) == [i for i in range(199, 400) if i % 40]
    assert len(held.timers) == 2 and held.value is None


def test_channels_that_share_a_part_expire_as_alone(spark):
    schema = "channel string, id bigint, ts timestamp, ttl int, is_answer boolean"
    rng = random.Random(4)
    rows = []
    for i in range(600):
        answer = rng.random() < 0.3
        at = None if i % 97 == 5 else BASE + dt.timedelta(seconds=rng.randrange(200_000))
        rows.append((f"c{rng.randrange(12)}", i, at, None if answer else rng.randrange(0, 40_000), answer))
    first = [r for r in rows if r[2] is None or r[2] < BASE + dt.timedelta(seconds=100_000)]
    rest = [r for r in rows if r[2] and r[2] >= BASE + dt.timedelta(seconds=100_000)]
    end = [("end", 1000, BASE + dt.timedelta(seconds=400_000), None, True)]
    parts = [spark.createDataFrame(p, schema) for p in (first, rest + rest[:100], end)]
    want = sorted((c, i, ts + dt.timedelta(seconds=ttl)) for c, i, ts, ttl, answer in rows if ts and not answer
                  and not any(a and k == c and t and ts <= t <= ts + dt.timedelta(seconds=ttl) for k, _, t, _, a in rows))
    with runs.keyed_state(spark):
        out = runs.run_staged(parts, lambda s: states.expired(s, parts=3), "expired")
    assert sorted(tuple(r) for r in out.collect()) == want and want
