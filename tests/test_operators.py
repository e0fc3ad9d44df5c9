"""Boundary rows of the batch operators."""

import hashlib
import math
import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.functions import stats
from abacist.functions.ranks import quantile_element
from abacist.operators import (chat, experiments, feedback, jobs, metrics, registry, retrieval, reviews, safety, support, usage,
                               wallet)
from abacist.sources import commits, documents, sinks, tables

NOW = datetime(2024, 1, 31)


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 40, 100, 101, 3000])
def test_quantile_element(spark, n):
    values = [float((i * 7919) % 1000) / 7 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    want = sorted(values)[int(n * 0.95)] if n else None
    assert quantile_element(df, "x", 0.95).first().value == want


def test_quantile_element_by_digits(spark):
    """Distinct values over the whole range of doubles, signs and zeros, equal ones, none; three passes over the values."""
    rng = random.Random(4)
    some = [struct.unpack("<d", struct.pack("<q", rng.getrandbits(64) - 2**63))[0] for _ in range(3000)]
    some = [x for x in some if x == x] + [0.0, -0.0, 1.0, math.nextafter(1.0, 2), math.inf, -math.inf, 5e-324, -5e-324]
    for values in (some, [2.5] * 500, [math.nextafter(1.0, 2)] * 30 + [1.0] * 30 + [None]):
        df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
        known = sorted(x for x in values if x is not None)
        for fraction in (0.0, 0.5, 0.95):
            got = quantile_element(df, "x", fraction)
            assert got.first().value == (known[min(int(len(known) * fraction), len(known) - 1)] if known else None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_quantile_element_large_and_constant(spark):
    df = spark.range(200_000).select(F.pmod(F.col("id") * 7919, F.lit(199_999)).cast("double").alias("x"))
    values = sorted((i * 7919) % 199_999 for i in range(200_000))
    assert quantile_element(df, "x", 0.95).first().value == values[190_000]
    assert quantile_element(df.select(F.lit(3.0).alias("x")), "x", 0.95).first().value == 3.0


def test_performance_without_rows(spark):
    empty = spark.createDataFrame([], "metric_type STRING, value DOUBLE, collected_at TIMESTAMP")
    row = usage.system_performance(empty, NOW).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0, 0)


def test_cutoff_is_inclusive(spark):
    rows = [("a", NOW - timedelta(days=30)), ("b", NOW - timedelta(days=30, microseconds=1))]
    df = spark.createDataFrame(rows, "user_id STRING, started_at TIMESTAMP")
    assert [tuple(r) for r in usage.daily_active_users(df, NOW).collect()] == [("2024-01-01", 1)]


def test_payment_failures(spark):
    rows = [("purchase", 0, None), ("purchase", 0, None), ("purchase", 0, "x"), ("purchase", 5, "y"), ("usage", 0, "z")]
    df = spark.createDataFrame([(*r, NOW) for r in rows], "type STRING, amount BIGINT, description STRING, created_at TIMESTAMP")
    got = {(r.row_type, r.reason): (r.failed_payments, r.failure_rate) for r in usage.payment_failures(df, NOW).collect()}
    assert got == {("reason", None): (2, None), ("reason", "x"): (1, None), ("total", None): (3, 0.75)}
    none = usage.payment_failures(df.filter("false"), NOW).collect()
    assert [tuple(r) for r in none] == [("total", None, 0, 0.0)]


def test_totals_take_abs_of_the_sum(spark):
    df = spark.createDataFrame([("purchase", -5, NOW), ("purchase", 2, NOW)], "type STRING, amount BIGINT, created_at TIMESTAMP")
    assert tuple(usage.purchase_totals(df, NOW).first()) == (3, 2, 1.5)
    assert tuple(usage.purchase_totals(df.filter("false"), NOW).first()) == (0, 0, 0.0)


def test_session_expiry_at_as_of(spark):
    rows = [("u", "1", True, NOW), ("v", "2", True, NOW + timedelta(minutes=90)), ("v", "3", True, NOW + timedelta(minutes=30)),
            ("w", "4", False, NOW + timedelta(minutes=5))]
    df = spark.createDataFrame(rows, "user_id STRING, id STRING, is_active BOOLEAN, expires_at TIMESTAMP")
    assert [(r.user_id, r.session_id, r.remaining_minutes) for r in wallet.active_session(df, NOW).collect()] == [("v", "2", 90.0)]
    users = spark.createDataFrame([("u",), ("v",)], "id STRING")
    status = {r.user_id: r.remaining_minutes for r in wallet.session_status(users, df, NOW).collect()}
    assert status == {"u": 0.0, "v": 90.0}


def test_unknown_package(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (0,), (None,)], "package_id BIGINT")
    got = {r.package_id: (r.price, r.coins, r.reject_reason) for r in wallet.package_lookup(df).collect()}
    bad = (None, None, "unknown package")
    assert got == {1: (7, 15, None), 3: (21, 75, None), 4: bad, 0: bad, None: bad}


def test_hash_bucket(spark):
    texts = [f"user{i}:exp{i % 7}:42" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r.t: r.b for r in df.select("t", stats.md5_mod_100(F.col("t")).alias("b")).collect()}
    assert got == {t: int(hashlib.md5(t.encode()).hexdigest(), 16) % 100 for t in texts}


def test_split_zero_and_one(spark):
    pairs = spark.range(200).select(F.col("id").cast("string").alias("user_id"), F.concat(F.lit("e"), F.col("id") % 3).alias("experiment_id"))
    tests = spark.createDataFrame([("e0", 0.0), ("e1", 1.0)], "id STRING, traffic_split DOUBLE")
    got = experiments.assign(pairs, tests).collect()
    assert {(r.experiment_id, r.variant) for r in got} == {("e0", "B"), ("e1", "A")}


def simpson_p(t, df, steps=20_000):
    density = lambda u: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + u * u / df) ** (-(df + 1) / 2)
    h = abs(t) / steps
    return 1 - 2 * h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * density(i * h) for i in range(steps + 1))


@pytest.mark.parametrize("t, df", [(0.0, 18), (0.5, 18), (2.1, 18), (-3.0, 5), (1.96, 1000), (0.01, 100_000), (4.0, 40)])
def test_p_value(spark, t, df):
    row = spark.createDataFrame([(t, float(df))], "t DOUBLE, df DOUBLE").select(stats.t_p_value(F.col("t"), F.col("df")).alias("p"))
    assert row.first().p == pytest.approx(simpson_p(t, df), abs=1e-9)
    assert "Python" not in row._jdf.queryExecution().executedPlan().toString()


def test_ttest_edges(spark):
    def of(name, a, b):
        return [(name, "A", float(v)) for v in a] + [(name, "B", float(v)) for v in b]

    rows = (of("few", range(9), range(20)) + of("ten", range(10), range(10)) + of("flat", [3] * 10, [3] * 12)
            + of("step", [1] * 10, [2] * 10) + of("zero", [0] * 10, [2] * 10) + of("far", range(30), range(40, 70)))
    df = spark.createDataFrame(rows, "experiment_id STRING, variant STRING, metric_value DOUBLE")
    got = {r.experiment_id: r for r in experiments.ttest(df).collect()}
    assert got["few"].error.startswith("Insufficient") and got["few"].winner is None
    assert got["ten"].winner == "inconclusive" and got["ten"].p_value == pytest.approx(1.0)
    assert got["flat"].winner == "inconclusive" and math.isnan(got["flat"].p_value)
    assert got["step"].winner == "B" and got["step"].improvement == pytest.approx(100.0) and got["step"].p_value == 0.0
    assert got["zero"].improvement == math.inf
    assert got["far"].winner == "B" and got["far"].variant_a_std == pytest.approx(np.std(range(30)))


def test_summary_keeps_empty_variant(spark):
    df = spark.createDataFrame([("e", "A", 2.0), ("e", "A", 4.0)], "experiment_id STRING, variant STRING, metric_value DOUBLE")
    got = {r.variant: (r["count"], r["sum"], r.average, r.total_observations) for r in experiments.summary(df).collect()}
    assert got == {"A": (2, 6.0, 3.0, 2), "B": (0, 0.0, 0.0, 2)}


def test_training_thresholds(spark):
    rows = [(m, "u", "correction", r, c, True, True, NOW) for m, n, r, c in
            (("few", 4, 0, "t"), ("five", 5, 0, "t"), ("rated", 10, 3, ""), ("nine", 9, 3, None), ("", 5, None, "t"), (None, 1, None, "t"))
            for _ in range(n)]
    df = spark.createDataFrame(rows, "model_version_id STRING, user_id STRING, feedback_type STRING, rating BIGINT, "
                                     "user_correction STRING, consent_given BOOLEAN, pii_sanitized BOOLEAN, created_at TIMESTAMP")
    got = {r.model_version: (r.corrections, r.ratings, r.total_feedback, r.average_rating) for r in feedback.training_summary(df).collect()}
    assert got == {"five": (5, 0, 5, 0.0), "rated": (0, 10, 10, 3.0), "unknown": (6, 0, 6, 0.0)}
    long = feedback.training_corrections(df.withColumn("id", F.lit("1")))
    assert {(r.model_version, r.user_hash) for r in long.collect()} == {
        (m, hashlib.sha256(b"u").hexdigest()[:16]) for m in ("five", "unknown")}


def test_purge_keeps_unknown(spark):
    old, new = NOW - timedelta(days=366), NOW - timedelta(days=365)
    rows = [("old", old, False), ("consented", old, True), ("new", new, False), ("no time", None, False), ("no consent", old, None)]
    df = spark.createDataFrame(rows, "id STRING, created_at TIMESTAMP, consent_given BOOLEAN")
    assert {r.id for r in feedback.purge_expired(df, NOW).collect()} == {"consented", "new", "no time", "no consent"}


def test_old_chats(spark):
    rows = [("old", NOW - timedelta(days=7, seconds=1)), ("edge", NOW - timedelta(days=7)), ("none", None)]
    df = spark.createDataFrame(rows, "id STRING, created_at TIMESTAMP")
    assert {r.id for r in jobs.delete_old_chats(df, NOW).collect()} == {"edge", "none"}
    assert jobs.count_old_chats(df, NOW).first().deleted_chats == 1


def test_grant_is_idempotent(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "id STRING")
    coins = spark.createDataFrame([("a", 1, NOW + timedelta(hours=1)), ("b", 2, NOW - timedelta(seconds=1)), ("gone", 9, None)],
                                  "user_id STRING, balance BIGINT, free_daily_coins_last_grant_date TIMESTAMP")
    noon = NOW + timedelta(hours=12)
    once = jobs.daily_grant(users, coins, noon)
    assert {r.user_id: (r.balance, r.granted) for r in once.collect()} == {
        "a": (1, False), "b": (6, True), "c": (4, True), "gone": (9, False)}
    assert {r.user_id for r in jobs.grant_ledger(once, noon).collect()} == {"b", "c"}
    twice = jobs.daily_grant(users, once.drop("granted"), noon + timedelta(hours=1))
    assert {r.user_id: r.balance for r in twice.collect()} == {"a": 1, "b": 6, "c": 4, "gone": 9}
    assert not any(r.granted for r in twice.collect())


def test_abuse_rules(spark):
    def of(user, n, query, gap, flagged):
        return [(user, f"{i:03d}", query(i), NOW + timedelta(seconds=gap * i), i < flagged) for i in range(n)]

    rows = (of("repeat", 6, lambda i: "same", 60, 0) + of("five", 5, lambda i: "same", 60, 0) + of("rapid", 11, lambda i: f"q{i}", 4.9, 0)
            + of("ten", 10, lambda i: f"q{i}", 1, 0) + of("flagged", 4, lambda i: f"q{i}", 60, 3) + of("half", 4, lambda i: f"q{i}", 60, 2)
            + of("days", 11, lambda i: f"q{i}", 86_400, 0) + of("all", 12, lambda i: "same", 1, 12))
    df = spark.createDataFrame(rows, "user_id STRING, id STRING, query STRING, ts TIMESTAMP, flagged BOOLEAN")
    got = {r.user_id: (r.patterns_detected, round(r.risk_score, 9), r.suspicious_activity) for r in safety.abuse_patterns(df).collect()}
    assert got["repeat"] == (["repetitive_queries"], 0.3, False) and got["five"] == ([], 0.0, False)
    assert got["rapid"] == (["rapid_fire_queries"], 0.4, False) and got["ten"][0] == []
    assert got["flagged"] == (["consistently_flagged"], 0.5, False) and got["half"][0] == []
    assert got["days"][0] == ["rapid_fire_queries"]  # whole days are dropped from a gap
    assert got["all"] == (["repetitive_queries", "rapid_fire_queries", "consistently_flagged"], 1.2, True)


def test_model_summary_maximum(spark):
    m = spark.createDataFrame([("m", "t", -2.0, NOW)], "model_version_id STRING, metric_type STRING, value DOUBLE, collected_at TIMESTAMP")
    f = spark.createDataFrame([("f", 4, "rating", NOW), (None, 1, "rating", NOW)],
                              "model_version_id STRING, rating BIGINT, feedback_type STRING, created_at TIMESTAMP")
    got = {r.model_version_id: (r["min"], r["max"], r.total_ratings, r.average_rating) for r in metrics.model_summary(m, f, NOW).collect()}
    assert got == {"m": (-2.0, 0.0, 0, 0.0), "f": (None, None, 1, 4.0)}


def test_version_compare_top_over_all_types(spark):
    rows = [("a", f"{i:03d}", "x" if i < 100 else "y", 0.0 if i < 100 else 5.0, NOW + timedelta(seconds=i)) for i in range(150)]
    rows += [("b", "1", "z", 3.0, NOW)]
    df = spark.createDataFrame(rows, "model_version_id STRING, id STRING, metric_type STRING, value DOUBLE, collected_at TIMESTAMP")
    pairs = spark.createDataFrame([("a", "b")], "version_a STRING, version_b STRING")
    got = {r.metric_type: (r.version_a_avg, r.version_b_avg, r.improvement) for r in metrics.version_compare(df, pairs).collect()}
    assert got == {"x": (0.0, 0.0, 0.0), "y": (5.0, 0.0, -100.0), "z": (0.0, 3.0, 0.0)}


def test_deploy_takes_requests_in_order(spark):
    versions = spark.createDataFrame(
        [("old", "n", "production", NOW), ("v1", "n", "vetted", None), ("v2", "n", "vetted", None), ("v3", "n", "vetted", None),
         ("s", "n", "staging", None), ("other", "m", "production", NOW), ("c", "m", "vetted", None)],
        "id STRING, model_name STRING, status STRING, deployed_at TIMESTAMP")
    at = lambda h: NOW + timedelta(hours=h)
    requests = spark.createDataFrame(
        [("v1", "production", at(2)), ("v2", "production", at(1)), ("v2", "production", at(9)), ("v3", "canary", at(3)),
         ("s", "production", at(4)), ("c", "canary", at(1))], "model_version_id STRING, target STRING, requested_at TIMESTAMP")
    got = {r.id: (r.status, r.deployed_at) for r in registry.deploy(versions, requests).collect()}
    assert got == {"old": ("deprecated", NOW), "v1": ("production", at(2)), "v2": ("deprecated", at(1)), "v3": ("production", at(3)),
                   "s": ("staging", None), "other": ("production", NOW), "c": ("production", at(1))}


def test_vetting_defaults(spark):
    rows = [("none", None, None), ("good", '{"accuracy": 0.8, "toxicity_score": 0.1, "latency_ms": 5000}', '{"consent_verified": true}'),
            ("bad", '{"accuracy": 0.79, "toxicity_score": 0.11, "latency_ms": 5001}', "{}")]
    df = spark.createDataFrame(rows, "id STRING, performance_metrics STRING, training_metadata STRING")
    got = {r.id: r for r in reviews.vetting_checks(df).collect()}
    assert got["good"].checks_passed and got["good"].recommendations == []
    assert got["bad"].recommendations == list(reviews.ADVICE.values())
    assert [got["none"][c] for c in reviews.ADVICE] == [False, False, False, True]


def test_escalation_strips(spark):
    df = spark.createDataFrame([("1", None), ("2", " a "), ("3", "b")], "id STRING, comments STRING")
    why = spark.createDataFrame([("1", "slow "), ("2", "x")], "id STRING, reason STRING")
    got = {r.id: r.comments for r in reviews.escalate(df, why).collect()}
    assert got == {"1": "[ESCALATED] slow", "2": "a \n\n[ESCALATED] x", "3": "b"}


def test_abuse_ticket_text(spark):
    df = spark.createDataFrame([("1", "u", "chat", "9", "spam", None, NOW)],
                               "id STRING, user_id STRING, content_type STRING, content_id STRING, reason STRING, description STRING, created_at TIMESTAMP")
    row = support.abuse_tickets(df).first()
    assert row.description == "Content Type: chat\nContent ID: 9\nReason: spam\nDescription: N/A"
    assert (row.subject, row.priority, row.status) == ("Abuse Report: chat", "high", "open")


def test_attachments(spark):
    files = spark.createDataFrame([("1", "a"), ("2", "b")], "id STRING, filename STRING")
    messages = spark.createDataFrame([("m", ["2", "9", "1", "2"]), ("n", None), ("o", [])], "id STRING, attachments ARRAY<STRING>")
    got = {r.id: [(f.file_id, f.filename) for f in r.files] for r in retrieval.resolve_attachments(messages, files).collect()}
    assert got == {"m": [("2", "b"), ("1", "a"), ("2", "b")], "n": [], "o": []}


def vectors(spark, n, d, seed, clusters=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, d)) * 3
    data = centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, d))
    data[::50] = data[0]  # copies, so scores tie
    data[7 % n] = 0.0
    return data, spark.createDataFrame([(f"{i:04d}", [float(x) for x in v]) for i, v in enumerate(data)], "id STRING, embedding ARRAY<DOUBLE>")


@pytest.mark.parametrize(("floats", "cells"), [(1 << 23, 12), (8 * 20, 12), (8, 40)])
def test_topk_is_brute_force(spark, monkeypatch, floats, cells):
    """Whatever the blocks are: of several cells, of part of a cell, of one vector."""
    monkeypatch.setattr(retrieval, "BLOCK_FLOATS", floats)
    data, df = vectors(spark, 400, 8, 1)
    asked, queries = vectors(spark, 70, 8, 2)
    index = retrieval.build_index(df, cells=cells)
    found, got = retrieval.topk(queries.repartition(3), index, 5), {}
    assert index.rows.groupBy("block").count().agg(F.max("count")).first()[0] <= 400 if floats > 8 else True
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(asked) @ unit(data).T, 9)
    for q in range(70):
        best = sorted(range(400), key=lambda i: (-scores[q, i], i))[:5]
        assert [got[f"{q:04d}"][i + 1][0] for i in range(5)] == [f"{i:04d}" for i in best], q
        assert [got[f"{q:04d}"][i + 1][1] for i in range(5)] == pytest.approx([scores[q, i] for i in best])


def test_topk_with_fewer_vectors_than_k(spark):
    _, df = vectors(spark, 3, 4, 3)
    assert retrieval.topk(df.limit(2), retrieval.build_index(df), 5).count() == 6
    assert retrieval.topk(df.filter("false"), retrieval.build_index(df), 5).count() == 0
    assert retrieval.topk(df, retrieval.build_index(df.filter("false")), 5).count() == 0


def test_cells_lie_in_blocks():
    first, blocks = retrieval._in_blocks(np.array([3, 4, 0, 2, 25, 5, 5, 1]), 10)
    assert first.tolist() == [0, 0, 0, 0, 1, 4, 4, 5] and blocks.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]


def test_near_copies_in_other_cells_tie_by_id(spark):
    angle = 1e-5
    data = [("z", [1.0, 0.0]), ("a", [float(np.cos(angle)), float(np.sin(angle))]), ("m", [0.0, 1.0])]
    df = spark.createDataFrame(data, "id STRING, embedding ARRAY<DOUBLE>")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "id STRING, embedding ARRAY<DOUBLE>")
    assert [r.id for r in retrieval.topk(query, retrieval.build_index(df, cells=3), 1).collect()] == ["a"]


def test_cells_follow_the_vectors(spark):
    _, df = vectors(spark, 400, 4, 3)
    index = retrieval.build_index(df)
    assert len(index.cells.pivots) == 20 and index.rows.select("cell").distinct().count() > 1


def test_conform_and_append(spark, tmp_path):
    rows = spark.createDataFrame([("1", "u", NOW), ("2", "u", NOW + timedelta(days=1))], "id STRING, user_id STRING, created_at TIMESTAMP")
    path = str(tmp_path / "tickets")
    for batch in ("one", "one", "two"):  # the first one twice, as a job that runs again does
        commits.append(rows, path, batch, "support_tickets")
    back = commits.read(spark, path)
    assert back.count() == 4 and {(r.status, r.priority) for r in back.collect()} == {("open", "medium")}
    assert commits.read(spark, path, 1).count() == 2


def test_append_that_fails_half_way(spark, tmp_path, monkeypatch):
    rows, path = spark.createDataFrame([("1",), ("2",)], "id STRING"), str(tmp_path / "t")
    commits.append(rows, path, "zero")
    publish = commits.Log.publish
    monkeypatch.setattr(commits.Log, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        commits.append(rows.withColumn("id", F.concat(F.lit("n"), "id")), path, "one")
    assert commits.read(spark, path).count() == 2  # written, but named by no manifest
    monkeypatch.setattr(commits.Log, "publish", publish)
    commits.append(rows.withColumn("id", F.concat(F.lit("n"), "id")), path, "one")
    assert sorted(r.id for r in commits.read(spark, path).collect()) == ["1", "2", "n1", "n2"]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """The slower one of two appends takes the next version; of two updates of a bucket it fails and changes nothing."""
    rows, path = spark.createDataFrame([("1", 1)], "id STRING, v INT"), str(tmp_path / "t")
    log = commits.Log(spark, path)
    assert log.publish(1, {"a": "x"}) and not log.publish(1, {"a": "y"}) and log.parts(1) == {"a": "x"}
    assert log.commit({"b": "z"}) == 2 and log.parts(2) == {"a": "x", "b": "z"}
    with pytest.raises(commits.Conflict):
        log.commit({"a": "w"}, based_on={"a": "older"})
    with pytest.raises(FileNotFoundError):
        commits.read(spark, str(tmp_path / "none"))
    with pytest.raises(commits.Conflict):
        commits.create(rows, ["id"], str(tmp_path / "u")), commits.create(rows, ["id"], str(tmp_path / "u"))


def test_merge_keeps_the_files_of_other_buckets(spark, tmp_path):
    rows, path = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v"), F.lit("x").alias("kept")), str(tmp_path / "t")
    commits.create(rows, ["id"], path)
    changes = spark.createDataFrame([("7", 1, 1), ("7", 2, 2), ("new", 3, 1)], "id STRING, v INT, at INT")
    before = commits.Log(spark, path).parts(1)
    assert commits.merge(changes, ["id"], "at", path) == 2
    after = commits.Log(spark, path).parts(2)
    assert len(before) == commits.BUCKETS and sum(before[p] != after[p] for p in before) == 2
    got = {r.id: (r.v, r.kept) for r in commits.read(spark, path).collect()}
    assert got == {**{str(i): (0, "x") for i in range(500)}, "7": (2, "x"), "new": (3, None)}
    assert commits.read(spark, path, 1).count() == 500 and commits.merge(changes.where("false"), ["id"], "at", path) == 2


def test_uploads_that_cannot_be_read(spark):
    rows = [("scan.PDF", b"%PDF"), ("a.txt", b""), ("b.txt", b"caf\xc3\xa9\xff\xfe"), ("c.docx", b"no archive"), ("d.txt", None)]
    got = documents.extract_text(spark.createDataFrame(rows, "name STRING, content BINARY"))
    assert {r.name: (r.ext, r.text) for r in got.collect()} == {"scan.PDF": ("pdf", ""), "a.txt": ("txt", ""), "b.txt": ("txt", "café"),
                                                                 "c.docx": ("docx", ""), "d.txt": ("txt", "")}
    assert [r.name for r in documents.indexable(got).collect()] == ["b.txt"]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_read_formats(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("1", "u", "purchase", 5)], "id STRING, user_id STRING, type STRING, amount BIGINT")
    rows.write.format(fmt).save(str(tmp_path / fmt))
    row = tables.read(spark, "transactions", str(tmp_path / fmt), fmt).first()
    assert (row.id, row.amount, row.description) == ("1", 5, None)


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", "keep"), ("b", "y", "keep")], "k STRING, v STRING, extra STRING")
    new = spark.createDataFrame([("a", "1", 1), ("a", None, 2), ("c", "3", 1)], "k STRING, v STRING, at INT")
    got = {r.k: (r.v, r.extra) for r in sinks.upsert(old, new, ["k"], "at").collect()}
    assert got == {"a": (None, "keep"), "b": ("y", "keep"), "c": ("3", None)}


def test_upsert_fills_declared_defaults(spark):
    old = spark.createDataFrame([("1", "u", "closed", "high")], "id STRING, user_id STRING, status STRING, priority STRING")
    new = spark.createDataFrame([("1", "v", 1), ("2", "w", 1)], "id STRING, user_id STRING, at INT")
    got = {tuple(r) for r in sinks.upsert(old, new, ["id"], "at", "support_tickets").collect()}
    assert got == {("1", "v", "closed", "high"), ("2", "w", "open", "medium")}


def test_update_refuses_unknown_keys(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "k STRING, v STRING")
    new = spark.createDataFrame([("a", "1", 1), ("a", "2", 1), ("z", "3", 1)], "k STRING, v STRING, at INT")
    after, refused = sinks.update(old, new, ["k"], "at")
    assert {tuple(r) for r in after.collect()} == {("a", "2"), ("b", "y")}
    assert [(r.k, r.reject_reason) for r in refused.collect()] == [("z", "not found")]


def test_export_both_ends(spark, tmp_path):
    rows = [("m", "t", 1.0, NOW), ("m", "t", 2.0, NOW + timedelta(days=1)), ("m", "t", 3.0, NOW + timedelta(days=1, microseconds=1))]
    df = spark.createDataFrame([(*r, None) for r in rows], "model_version_id STRING, metric_type STRING, value DOUBLE, collected_at TIMESTAMP, metadata_json STRING")
    out = metrics.export_metrics(df, NOW, NOW + timedelta(days=1))
    assert sorted(r.value for r in out.collect()) == [1.0, 2.0]
    sinks.export(out, str(tmp_path / "out"))
    assert (tmp_path / "out" / "date=2024-02-01").exists()
    sinks.export(metrics.export_metrics(df, NOW + timedelta(days=1), NOW + timedelta(days=1)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2  # the first day is still there


def test_private_chat_needs_its_key(spark):
    df = spark.createDataFrame([("1", "u", None, "héllo", None, None, NOW), ("2", "u", "x", "héllo", True, ["f"], NOW)],
                               "id STRING, user_id STRING, admin_id STRING, message STRING, is_from_admin BOOLEAN, attachments ARRAY<STRING>, created_at TIMESTAMP")
    key, other = F.lit(b"k" * 16), F.lit(b"o" * 16)
    stored = chat.private_rows(df, key)
    assert all("llo" not in r.message for r in stored.collect())
    back = chat.read_private(stored, key).orderBy("id").collect()
    assert [(r.message, r.admin_id, r.is_from_admin, r.attachments) for r in back] == [("héllo", "admin", False, []), ("héllo", "x", True, ["f"])]
    assert [r.message for r in chat.read_private(stored, other).collect()] == [None, None]


def test_nested_observations(spark):
    one = '{"user_id": "u", "variant": "A", "metric_value": 1.5, "timestamp": "t", "metadata": null}'
    df = spark.createDataFrame([("e", f'{{"observations": [{one}, {one}, {one}]}}'), ("none", None), ("empty", '{"observations": []}')],
                               "id STRING, results STRING")
    rows = experiments.observations(df).collect()
    assert [(r.experiment_id, r.variant, r.metric_value) for r in rows] == [("e", "A", 1.5)] * 3


def test_jobs_written_twice_are_written_once(spark, tmp_path):
    users = spark.createDataFrame([("a",), ("b",)], "id STRING")
    coins = spark.createDataFrame([("a", 1, NOW)], "user_id STRING, balance BIGINT, free_daily_coins_last_grant_date TIMESTAMP")
    for _ in range(2):
        done = jobs.run_daily_grant(users, coins, str(tmp_path / "coins"), str(tmp_path / "ledger"), NOW + timedelta(hours=1))
        assert done.first().granted_to_users == 1
    ledger = sinks.read_snapshot(spark, str(tmp_path / "ledger"), NOW + timedelta(hours=1))
    assert [(r.user_id, r.amount) for r in ledger.collect()] == [("b", 4)]
    chats = spark.createDataFrame([("old", NOW - timedelta(days=8)), ("new", NOW)], "id STRING, created_at TIMESTAMP")
    assert jobs.run_delete_old_chats(chats, str(tmp_path / "chats"), NOW).first().deleted_chats == 1
    assert [r.id for r in sinks.read_snapshot(spark, str(tmp_path / "chats"), NOW).collect()] == ["new"]


def test_newest_first_with_id_as_tie_break(spark):
    rows = [("2", "u", "open", NOW), ("1", "u", "open", NOW), ("3", "v", "open", NOW + timedelta(1)), ("4", "v", "closed", NOW)]
    df = spark.createDataFrame(rows, "id STRING, user_id STRING, status STRING, created_at TIMESTAMP")
    assert [r.id for r in support.tickets_by_status(df, "open", 2).collect()] == ["3", "1"]
    assert [r.id for r in support.tickets_of_user(df, "u").collect()] == ["1", "2"]
    assert [r.id for r in registry.list_models(df, status="open").collect()] == ["3", "1", "2"]


def test_share_of_variants(spark):
    pairs = spark.range(20_000).select(F.col("id").cast("string").alias("user_id"), F.lit("e").alias("experiment_id"))
    tests = spark.createDataFrame([("e", 0.3)], "id STRING, traffic_split DOUBLE")
    share = experiments.assign(pairs, tests).filter("variant = 'A'").count() / 20_000
    assert abs(share - 0.3) < 0.015


def test_hot_model_and_user_keep_their_rows(spark):
    """A third of all rows on one key: counts stay whole and only the latest ten per user are ranked."""
    rows = spark.range(30_000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "m").otherwise(F.concat(F.lit("m"), F.col("id") % 9)).alias("model_version_id"),
        F.lit("correction").alias("feedback_type"), (F.col("id") % 6).alias("rating"), F.lit("text").alias("user_correction"),
        (F.col("id") % 2 == 0).alias("consent_given"), F.lit(True).alias("pii_sanitized"), F.lit(None).cast("string").alias("metadata_json"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("created_at"))
    report = {r.user_id: r for r in feedback.privacy_report(rows).collect()}
    assert report["hot"].total_feedback_items == 10_000 and sum(r.total_feedback_items for r in report.values()) == 30_000
    assert feedback.privacy_history(rows).count() == 30_000
    assert feedback.training_corrections(rows).groupBy().count().first()[0] == 15_000
    status = {r.user_id: r for r in feedback.consent_status(rows).collect()}
    assert all(len(r.consent_history) == 10 for r in status.values())


def test_estimated_users_are_near(spark):
    df = spark.range(40_000).select((F.col("id") % 9_000).cast("string").alias("user_id"),
                                    F.timestamp_seconds(F.lit(1_706_000_000) + F.col("id")).alias("started_at"))
    exact = {r.date: r.active_users for r in usage.daily_active_users(df, NOW).collect()}
    near = {r.date: r.active_users for r in usage.daily_active_users(df, NOW, error=0.01).collect()}
    assert exact.keys() == near.keys() and all(abs(near[d] - n) <= 0.05 * n for d, n in exact.items())
