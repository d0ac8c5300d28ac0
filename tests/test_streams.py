import datetime as dt

import pytest
from pyspark.sql import functions as F

from chunkloom.plans.queries import REGISTRY
from chunkloom.session import scratch_path
from chunkloom.streaming import buffer, monitor, runs
from chunkloom.streaming.ingest import ingest, ingested

SCHEMA = "event_id bigint, ts timestamp, event_type string, value double"


def events(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(hours=h), t, float(v)) for i, h, t, v in rows]
    return spark.createDataFrame(data, SCHEMA)


def files_stream(spark, folder, *parts):
    """A stream that reads one file per micro-batch, in order."""
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    on_time = events(spark, [(1, 1, "a", 1), (2, 80, "a", 1)])
    next_ = events(spark, [(4, 81, "a", 1)])
    # A batch is filtered by the watermark of the batch before the last.
    late = events(spark, [(3, 2, "a", 100)])
    closing = events(spark, [(5, 200, "a", 1)])
    s = files_stream(spark, str(tmp_path / "in"), on_time, next_, late, closing)
    out = runs.run_to_files(monitor.tumbling(s), "late")
    assert sorted((r.start.day, r.n, r.total) for r in out.collect()) == [(1, 1, 1.0), (4, 2, 2.0)]


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    one = events(spark, [(1, 0, "a", 1), (2, 0, "a", 1), (1, 0, "a", 1)])
    two = events(spark, [(2, 0, "a", 1), (3, 1, "b", 1)])
    s = files_stream(spark, str(tmp_path / "in"), one, two)
    out = runs.run_to_files(monitor.drop_repeats(s), "repeats")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]


def test_progress_over_several_batches(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "op string, idx int, total int")
    s = files_stream(spark, str(tmp_path / "in"), rows(("add", 1, 4), ("add", 2, 4)), rows(("add", 3, 4), ("copy", 1, 1)))
    got = monitor.latest_progress(runs.run_updates(monitor.progress(s), "progress", ["op"]))
    assert {r.op: (r.messages, r.percent) for r in got.collect()} == {"add": (3, 75.0), "copy": (1, 100.0)}


def test_a_stream_without_input_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert runs.run_to_files(monitor.drop_repeats(s), "none").count() == 0
    assert runs.run_updates(s.groupBy("event_type").count(), "none", ["event_type"]).count() == 0


def test_health_states(spark, tmp_path):
    calm = [(i, 1, "view", 1) for i in range(8)]
    failing = [(100 + i, 49, "error" if i < 3 else "view", 1) for i in range(10)]
    slow = [(200, 97, "view", 31)]
    s = files_stream(spark, str(tmp_path / "in"), events(spark, calm + failing + slow + [(900, 500, "view", 1)]))
    out = runs.run_to_files(monitor.health(s, size="1 day", slide="1 day"), "health")
    assert {r.start.day: r.state for r in out.collect()} == {1: "online", 3: "degraded", 5: "degraded"}


@pytest.mark.parametrize("n, kept", [(1, 1), (100, 100), (101, 50), (102, 51), (151, 100), (152, 50)])
def test_buffer_rule(spark, n, kept):
    box = []
    for i in range(n):
        box.append(i)
        if len(box) > 100:
            box = box[-50:]
    assert len(box) == kept
    assert spark.range(1).select(buffer.kept_count(F.lit(n))).first()[0] == kept


def test_streamed_buffer_over_batches_equals_the_batch_form(spark, tmp_path):
    rows = spark.range(460).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("hot").alias("event_type"))
    parts = [rows.filter(F.col("event_id").between(a, a + 114)) for a in range(0, 460, 115)]
    with runs.keyed_state(spark):
        s = files_stream(spark, str(tmp_path / "in"), *parts)
        saved = runs.run_updates(buffer.buffer_updates(s, "event_type", "event_id", salts=3), "buffer", ["channel", "salt"])
    got = buffer.buffer_contents(saved)
    want = buffer.last_messages(rows, "event_type", "event_id")
    assert sorted(map(tuple, got.select("channel", "id", "age").collect())) == sorted(
        map(tuple, want.select("event_type", "event_id", "age").collect()))


def test_ingest_over_batches_keeps_the_last_text_of_a_path(spark, tmp_path, corpus):
    first = corpus({"/d/a": "old. " * 400, "/d/b": "b"})
    second = corpus({"/d/a": "new", "/d/c": "c"})
    s = files_stream(spark, str(tmp_path / "in"), first, second)
    ingest(s, str(tmp_path / "kb"), scratch_path(spark, "state"), created_at="t")
    assert {r.source: r.text for r in ingested(spark, str(tmp_path / "kb")).collect()} == {"/d/a": "new", "/d/b": "b", "/d/c": "c"}


def test_nothing_ingested(spark, tmp_path):
    assert ingested(spark, str(tmp_path / "none")).count() == 0


def test_windows_do_not_depend_on_the_session_zone(spark, sf_dir):
    want = sorted(map(tuple, REGISTRY["stream_tumbling"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = sorted(map(tuple, REGISTRY["stream_tumbling"](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want
