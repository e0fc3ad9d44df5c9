"""Streams over several batches give what the batch operators give."""

import weakref
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from abacist.operators import limits, safety, usage
from abacist.plans.views import view
from abacist.streaming import streams

D = "/root/testdata/sf0.001"


def files(spark, df, order, path, n=4):
    """The rows as ``n`` files in time order, read back as a stream of one file per batch."""
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)
    import os
    parts = sorted(p for p in os.listdir(path) if p.endswith(".parquet"))
    for i, p in enumerate(parts):  # the file source takes older files first
        os.utime(f"{path}/{p}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, tmp_path, reduce=None):
    streams.start(stream, streams.batch_folder(f"{tmp_path}/out", reduce), f"{tmp_path}/ck", once=True).awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_admission_across_batches(spark, tmp_path):
    actions = view(spark, D, "actions")
    out = run(spark, streams.admission(files(spark, actions, "ts", f"{tmp_path}/in")), tmp_path)
    got = {(r.id, r.allowed, r.violations, r.retry_after_seconds) for r in out.collect()}
    want = {(r.id, r.allowed, r.violations, r.retry_after_seconds) for r in limits.rate_limit_admission(actions).collect()}
    assert got == want and out.select("batch").distinct().count() > 1


def test_admission_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "PIECE", 7)
    test_admission_across_batches(spark, tmp_path)


def test_rows_of_a_user_wait_outside_pandas(monkeypatch):
    """In order and a piece at a time; when the first piece comes, no frame but the last that came in is held."""
    monkeypatch.setattr(streams, "PIECE", 100)
    rows = [(f"{i * 7919 % 1000}", "query" if i % 3 else "session_start", i * 31 % 50) for i in range(1000)]
    frames = []

    def batches():
        for a in range(0, 1000, 130):
            frame = pd.DataFrame(rows[a:a + 130], columns=["id", "action", "ts_us"])
            frames.append(weakref.ref(frame))
            yield frame
            del frame

    got = []
    for piece in streams.in_time_order(batches()):
        assert len(piece) <= 100 and sum(frame() is not None for frame in frames) <= 1
        got += zip(piece["id"], piece["action"], piece["ts_us"])
    assert got == sorted(rows, key=lambda r: (r[2], r[0])) and len(frames) == 8


def test_state_expires_after_a_day(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", f"{i}", "session_start", t0 + timedelta(minutes=i)) for i in range(6)]
    rows += [("v", "x", "query", t0 + timedelta(days=3)), ("u", "y", "session_start", t0 + timedelta(days=4))]
    df = spark.createDataFrame(rows, "user_id STRING, id STRING, action STRING, ts TIMESTAMP")
    out = run(spark, streams.admission(files(spark, df, "ts", f"{tmp_path}/in", 3)), tmp_path)
    got = {r.id: r.allowed for r in out.collect()}
    assert got == {**{f"{i}": i < 5 for i in range(6)}, "x": True, "y": True}


def test_daily_users_across_batches(spark, tmp_path):
    sessions = view(spark, D, "ai_sessions")
    stream = streams.daily_users(files(spark, sessions, F.hash("id"), f"{tmp_path}/in"))
    out = run(spark, stream, tmp_path, streams.sightings)
    assert out.count() == out.select("date", "user_id", "batch").distinct().count() and out.select("batch").distinct().count() > 1
    want = usage.daily_active_users(sessions, datetime(2024, 1, 31))
    assert sorted(map(tuple, streams.count_daily_users(out).collect())) == sorted(map(tuple, want.collect()))


def test_tokens_across_batches_and_late_rows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("token_usage", '{"user_id": "u"}', t0 + timedelta(seconds=s), v) for s, v in
            ((5, 1.0), (30, 2.0), (61, 4.0), (3600, 8.0), (3601, 16.0))]
    df = spark.createDataFrame(rows, "metric_type STRING, metadata_json STRING, collected_at TIMESTAMP, value DOUBLE")
    late = df.limit(1).withColumn("value", F.lit(99.0))
    stream = files(spark, df, "collected_at", f"{tmp_path}/in", 3)
    run(spark, streams.tokens_per_minute(stream), tmp_path, streams.partial_tokens)
    late.write.mode("append").parquet(f"{tmp_path}/in")
    out = streams.sum_tokens(run(spark, streams.tokens_per_minute(stream), tmp_path, streams.partial_tokens))
    got = {(r.minute - t0).total_seconds(): r.tokens for r in out.collect()}
    assert got == {0.0: 102.0, 60.0: 4.0, 3600.0: 24.0}


def test_late_actions_get_a_decision(spark, tmp_path):
    t0 = datetime(2024, 1, 10)
    rows = [("u", f"{i}", "query", t0 + timedelta(days=d)) for i, d in enumerate((0, 1, 2, -5, 3))]
    df = spark.createDataFrame(rows, "user_id STRING, id STRING, action STRING, ts TIMESTAMP")
    out = run(spark, streams.admission(files(spark, df, "id", f"{tmp_path}/in", 5)), tmp_path)
    assert sorted(r.id for r in out.filter("allowed").collect()) == ["0", "1", "2", "3", "4"]


def test_moderation_sinks(spark, tmp_path):
    messages = view(spark, D, "chat_messages").select("id", "user_id", "message", "created_at")
    stream = files(spark, messages, "created_at", f"{tmp_path}/in", 3)
    sink = streams.moderation_sink(f"{tmp_path}/good", f"{tmp_path}/bad")
    streams.start(stream, sink, f"{tmp_path}/ck", once=True).awaitTermination()
    judged = safety.moderate(messages)
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    assert ids(spark.read.parquet(f"{tmp_path}/good")) == ids(judged.filter("approved"))
    assert ids(spark.read.parquet(f"{tmp_path}/bad")) == ids(judged.filter("NOT approved"))
    sink(messages, 0)  # a batch that runs again overwrites itself
    assert ids(spark.read.parquet(f"{tmp_path}/good/batch=0")) == ids(judged.filter("approved"))
