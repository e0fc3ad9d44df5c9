"""Replays against plain Python, with a busy key cut into many partitions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.operators import limits, wallet
from abacist.operators.folds import replay

T0 = datetime(2024, 1, 1)


def events(seed, kinds, hot=400, others=20):
    """(user_id, id, kind, amount, ts): one user holds most rows; times collide now and then."""
    rng = random.Random(seed)
    users = ["hot"] * hot + [f"u{rng.randrange(12)}" for _ in range(others * 12)]
    rng.shuffle(users)
    return [(u, f"{i:05d}", rng.choice(kinds), rng.randrange(0, 9), T0 + timedelta(seconds=rng.randrange(0, 40_000)))
            for i, u in enumerate(users)]


def in_order(rows):
    by_user = {}
    for row in sorted(rows, key=lambda r: (r[0], r[4], r[1])):
        by_user.setdefault(row[0], []).append(row)
    return by_user


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id STRING, id STRING, kind STRING, amount BIGINT, ts TIMESTAMP")


def python_ledger(rows):
    out = {}
    for user in in_order(rows).values():
        balance = 0
        for _, i, _, amount, _ in user:
            ok = balance + amount >= 0
            balance += amount if ok else 0
            out[i] = (ok, balance)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_ledger(spark, partitions):
    rows = [(u, i, k, a - 4 if k == "x" else a - 5, t) for u, i, k, a, t in events(1, ["x", "y"])]
    got = wallet.ledger_replay(frame(spark, rows).drop("kind"), partitions).collect()
    assert {r.id: (r.accepted, r.balance_after) for r in got} == python_ledger(rows)
    assert min(r.balance_after for r in got) >= 0


def test_ledger_exact_balance(spark):
    rows = [("u", "1", "", 4, T0), ("u", "2", "", -4, T0), ("u", "3", "", -1, T0 + timedelta(1))]
    got = wallet.ledger_replay(frame(spark, rows)).orderBy("id").collect()
    assert [(r.accepted, r.balance_after) for r in got] == [(True, 4), (True, 0), (False, 0)]


def python_sessions(rows):
    out = {}
    for user in in_order(rows).values():
        balance, expiry, live_id = 0, T0 - timedelta(1), None
        for _, i, kind, amount, now in user:
            live = expiry > now
            if kind == "credit":
                balance += amount
                out[i] = ("credited", None, balance)
                continue
            if kind == "start" and live:
                out[i] = ("live", live_id, balance)
                continue
            if balance < 4:
                out[i] = ("rejected", None, balance)
                continue
            balance -= 4
            if kind == "extend" and live:
                expiry += timedelta(minutes=60)
                out[i] = ("extended", live_id, balance)
            else:
                expiry, live_id = now + timedelta(minutes=60), i
                out[i] = ("opened", i, balance)
    return out


@pytest.mark.parametrize("partitions", [1, 25])
@pytest.mark.parametrize("kinds", [["start", "extend", "credit", "credit"], ["start"] * 20 + ["credit"], ["start"] * 9 + ["credit"] * 9 + ["extend"]])
def test_sessions(spark, partitions, kinds):
    rows = events(2, kinds)
    got = wallet.session_replay(frame(spark, rows), partitions).collect()
    assert {r.id: (r.outcome, r.session_id, r.balance_after) for r in got} == python_sessions(rows)


@pytest.mark.parametrize("fold, row", [
    (wallet.Sessions(), lambda rng, i: (rng.choice(["start", "start", "extend", "credit"]), rng.randrange(9), i * 90_000_000, str(i))),
    (limits.Admission(), lambda rng, i: (rng.choice(["query", "query", "session_start", "other"]), i * 5_000_000)),
])
def test_advance_is_step_by_step(fold, row):
    rng = random.Random(9)
    for size in (1, 2, 17, 400):
        rows = [row(rng, i) for i in range(size)]
        stepped = fold.start()
        for r in rows:
            stepped, _ = fold.step(stepped, r)
        assert fold.advance(fold.start(), [np.array(c) for c in zip(*rows)]) == stepped


def python_admission(rows):
    out = {}
    for user in in_order(rows).values():
        queries, sessions = [], []
        for _, i, action, _, now in user:
            queries = [t for t in queries if now - t < timedelta(hours=1)]
            sessions = [t for t in sessions if now - t < timedelta(days=1)]
            broken, wait = [], 0
            if len([t for t in queries if now - t < timedelta(minutes=1)]) >= 10:
                broken, wait = broken + ["queries_per_minute"], 60
            if len(queries) >= 100:
                broken, wait = broken + ["queries_per_hour"], 3600
            if action == "session_start" and len(sessions) >= 5:
                broken = broken + ["sessions_per_day"]
                wait = 86400 - int((now - sessions[0]).total_seconds())
            if not broken and action == "query":
                queries.append(now)
            if not broken and action == "session_start":
                sessions.append(now)
            out[i] = (not broken, ",".join(broken), wait)
    return out


def admitted(spark, rows, partitions):
    df = frame(spark, rows).withColumnRenamed("kind", "action").withColumn("ts_us", F.unix_micros("ts"))
    got = replay(df, limits.Admission(), "user_id", ["ts_us", "id"], partitions).collect()
    return {r.id: (r.allowed, r.violations, r.retry_after_seconds) for r in got}


@pytest.mark.parametrize("partitions", [1, 30])
@pytest.mark.parametrize("squeeze", [1, 20, 200])
def test_admission(spark, partitions, squeeze):
    rows = [(u, i, k, a, T0 + (t - T0) / squeeze) for u, i, k, a, t in events(3, ["query"] * 6 + ["session_start"], hot=900)]
    assert admitted(spark, rows, partitions) == python_admission(rows)


def test_admission_boundaries(spark):
    burst = [("u", f"{i:02d}", "query", 0, T0 + timedelta(seconds=i)) for i in range(11)]
    later = [("u", "90", "query", 0, T0 + timedelta(seconds=59, microseconds=999_999)), ("u", "91", "query", 0, T0 + timedelta(seconds=60))]
    got = admitted(spark, burst + later, 2)
    assert [got[f"{i:02d}"][0] for i in range(11)] == [True] * 10 + [False]
    assert got["10"][1:] == ("queries_per_minute", 60) and not got["90"][0] and got["91"][0]


def test_never_more_than_the_limit(spark):
    rows = [("hot", f"{i:05d}", "query", 0, T0 + timedelta(milliseconds=700 * i)) for i in range(3000)]
    allowed = sorted(i for i, (ok, *_) in admitted(spark, rows, 16).items() if ok)
    times = [0.7 * int(i) for i in allowed]
    assert all(b - a >= 60 for a, b in zip(times, times[10:])) and all(b - a >= 3600 for a, b in zip(times, times[100:]))
    assert admitted(spark, rows, 16) == python_admission(rows)


def test_running_balance_equals_window(spark):
    rows = frame(spark, events(4, ["x"])).select("user_id", "id", "amount", F.col("ts").alias("created_at"))
    got = {r.id: r.balance for r in wallet.ledger_balance(rows, 20).collect()}
    for user in in_order(events(4, ["x"])).values():
        total = 0
        for _, i, _, amount, _ in user:
            total += amount
            assert got[i] == total


def test_fixed_window(spark):
    rows = [("c", f"{i:02d}", T0 + timedelta(seconds=i)) for i in range(12)] + [("c", "20", T0 + timedelta(seconds=60)), ("d", "30", T0)]
    df = spark.createDataFrame(rows, "client STRING, id STRING, ts TIMESTAMP")
    got = {r.id: r.allowed for r in limits.fixed_window_limit(df).collect()}
    assert [got[f"{i:02d}"] for i in range(12)] == [True] * 10 + [False] * 2 and got["20"] and got["30"]


def test_rows_without_a_key_stay_without_a_verdict(spark):
    rows = events(5, ["x"], hot=60, others=3) + [(None, f"n{i:03d}", "x", 1, T0 + timedelta(seconds=i)) for i in range(80)]
    got = wallet.ledger_replay(frame(spark, rows).drop("kind"), 12).collect()
    assert len(got) == len(rows) and {r.accepted for r in got if r.user_id is None} == {None}
    assert {r.id: (r.accepted, r.balance_after) for r in got if r.user_id} == python_ledger([r for r in rows if r[0]])


def test_always_at_the_limit_over_many_partitions(spark):
    rows = [("busy", f"{i:05d}", "query", T0 + timedelta(seconds=i)) for i in range(1500)]
    actions = spark.createDataFrame(rows, "user_id STRING, id STRING, action STRING, ts TIMESTAMP")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = limits.rate_limit_admission(actions).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    taken, hour = [], []
    want = {}
    for _, i, _, t in rows:
        minute = [x for x in taken if (t - x).total_seconds() < 60]
        hour = [x for x in taken if (t - x).total_seconds() < 3600]
        want[i] = len(minute) < 10 and len(hour) < 100
        if want[i]:
            taken.append(t)
    assert {r.id: r.allowed for r in got} == want
