"""Queries on metrics, counters, histograms and exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from abacist.functions.timing import iso
from abacist.operators import metrics as op
from abacist.plans.views import AS_OF, AS_OF_ORDERS, appended, view, with_views
from abacist.session import scratch_path
from abacist.sources import sinks

_START, _END = datetime(2024, 1, 10), datetime(2024, 1, 20, 12)
_F_START, _F_END = datetime(1996, 1, 1), datetime(1996, 12, 31)


def _json_contains(spark, d):
    rows = op.metrics_of_user(view(spark, d, "model_metrics"))
    return rows.select("id", "user_id", "model_version_id", "metric_type", "value", iso("collected_at").alias("collected_at"))


def _new_metrics(spark, d):
    return appended(op.new_metrics(view(spark, d, "model_metrics")), "metrics").withColumn("collected_at", iso("collected_at"))


def _user_metrics_summary(spark, d):
    out = op.user_summary(view(spark, d, "model_metrics"), view(spark, d, "user_feedback"), AS_OF, AS_OF_ORDERS)
    return out.withColumns({c: F.round(c, 6) for c in ("total_tokens_used", "average_rating")})


def _model_perf_summary(spark, d):
    out = op.model_summary(view(spark, d, "model_metrics"), view(spark, d, "user_feedback"), AS_OF, AS_OF_ORDERS)
    return out.withColumns({c: F.round(c, 6) for c in ("sum", "avg", "min", "max", "average_rating")})


def _counter_rollup(spark, d):
    metrics, feedback = view(spark, d, "model_metrics"), view(spark, d, "user_feedback")
    tokens = op.metrics_of_user(metrics.filter(F.col("metric_type") == "token_usage")).withColumn(
        "operation_type", F.lit("inference")).withColumnRenamed("model_version_id", "model_version")
    flagged = feedback.filter(F.col("feedback_type") == "flag_bad_response").select(
        F.get_json_object("metadata_json", "$.reason").alias("reason"), F.col("model_version_id").alias("model_version"))
    errors = metrics.filter(F.col("metric_type") == "inference_errors").select(
        F.col("model_version_id").alias("model_version"), F.when(F.col("value") > 50, "timeout").otherwise("failure").alias("error_type"))
    out = (op.counter(tokens, "token_usage_total", ["user_id", "model_version", "operation_type"], F.col("value"))
           .unionByName(op.counter(flagged, "bad_responses_total", ["reason", "model_version"]))
           .unionByName(op.counter(errors, "model_inference_errors_total", ["model_version", "error_type"]))
           .unionByName(op.counter(view(spark, d, "requests"), "http_requests_total", ["method", "endpoint", "status"])))
    return out.withColumn("value", F.round("value", 6))


def _histogram_rollup(spark, d):
    metrics, feedback = view(spark, d, "model_metrics"), view(spark, d, "user_feedback")
    latency = metrics.filter(F.col("metric_type") == "inference_latency").select(
        F.col("model_version_id").alias("model_version"), F.lit("inference").alias("operation_type"),
        (F.col("value") / 20).alias("seconds"))
    rated = feedback.filter(F.col("feedback_type") == "rating").select(
        F.col("model_version_id").alias("model_version"), F.col("rating").cast("double").alias("rating"))
    quality = metrics.filter(F.col("metric_type") == "token_usage").select(
        F.col("model_version_id").alias("model_version"), (F.col("value") / 500).alias("score"))
    out = (op.histogram(latency, "model_inference_latency_seconds", ["model_version", "operation_type"], "seconds")
           .unionByName(op.histogram(rated, "user_satisfaction_score", ["model_version"], "rating"))
           .unionByName(op.histogram(quality, "response_quality_score", ["model_version"], "score"))
           .unionByName(op.histogram(view(spark, d, "requests"), "http_request_duration_seconds", ["method", "endpoint"],
                                     "seconds")))
    return out.withColumn("sum", F.round("sum", 6))


def _model_metrics_recent(spark, d):
    rows = op.recent_per_version(view(spark, d, "model_metrics"))
    return rows.select("model_version_id", F.col("rn").cast("bigint").alias("rn"), "id", "metric_type", "value",
                       iso("collected_at").alias("collected_at"))


def _version_compare(spark, d):
    metrics = view(spark, d, "model_metrics")
    versions = metrics.select(F.col("model_version_id").alias("version_a")).distinct()
    pairs = versions.withColumn("version_b", F.when(F.col("version_a") == "m0", "m1").when(F.col("version_a") == "m1", "m2")
                                .when(F.col("version_a") == "m2", "m3").otherwise("missing"))
    out = op.version_compare(metrics, pairs)
    return out.withColumns({c: F.round(c, 6) for c in ("version_a_avg", "version_b_avg", "improvement")})


def _export_metrics(spark, d):
    """Exported in two steps as JSON lines, the second one again as a job that runs twice, and read back."""
    path, half, step = scratch_path(spark, "export"), datetime(2024, 1, 15), timedelta(microseconds=1)
    for start, end in ((_START, half - step), (half, _END), (half, _END)):
        sinks.export(op.export_metrics(view(spark, d, "model_metrics"), start, end), path)
    kinds = "model_version_id STRING, metric_type STRING, value DOUBLE, timestamp STRING, metadata STRING"
    return spark.read.schema(kinds).json(path).drop("date")


def _export_feedback(spark, d):
    """Exported in two steps, the second half year again as a job that runs twice, and read back."""
    path, half, step = scratch_path(spark, "export"), datetime(1996, 7, 1), timedelta(microseconds=1)
    for start, end in ((_F_START, half - step), (half, _F_END), (half, _F_END)):
        sinks.export(op.export_feedback(view(spark, d, "user_feedback"), start, end), path, "parquet")
    return spark.read.parquet(path).drop("date")


QUERIES = {
    "json_contains": _json_contains,
    "sink_append_metrics": _new_metrics,
    "user_metrics_summary": _user_metrics_summary,
    "model_perf_summary": _model_perf_summary,
    "counter_rollup": _counter_rollup,
    "histogram_rollup": _histogram_rollup,
    "model_metrics_recent": _model_metrics_recent,
    "version_compare": _version_compare,
    "sink_range_export": _export_metrics,
    "sink_range_export_feedback": _export_feedback,
}

_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"
_RATED = """SELECT {key}, avg(rating) AS average_rating, count(rating) AS total_ratings,
    count(*) FILTER (feedback_type = 'flag_bad_response') AS bad_responses_flagged,
    count(*) FILTER (feedback_type = 'correction') AS corrections_provided,
    count(*) FILTER (consent_given) AS consent_given_count
  FROM user_feedback WHERE created_at >= TIMESTAMP '{since} 00:00:00' AND {key} IS NOT NULL GROUP BY {key}"""


def _sql_histogram(name: str, labels: str, label_columns: str, value: str, source: str) -> str:
    bounds = ", ".join(f"('{b}', {b})" for b in op.BOUNDS) + ", ('+Inf', CAST('inf' AS DOUBLE))"
    return f"""SELECT '{name}' AS histogram, {labels} AS labels, le,
        count(*) FILTER (v <= bound) AS bucket_count, round(sum(v), 6) AS sum, count(*) AS count
      FROM (SELECT *, {value} AS v FROM {source}) s, (VALUES {bounds}) b(le, bound)
      GROUP BY {label_columns}, le"""


ORACLES = {
    "json_contains": with_views("model_metrics", f"""
        SELECT id, json_extract_string(metadata_json, '$.user_id') AS user_id, model_version_id, metric_type, value,
               {_AT.format('collected_at')} AS collected_at FROM model_metrics"""),
    "sink_append_metrics": with_views("model_metrics", f"""
        SELECT id, model_version_id, metric_type, value, metadata_json, {_AT.format('collected_at')} AS collected_at
        FROM model_metrics"""),
    "user_metrics_summary": with_views("model_metrics user_feedback", f"""
        , t AS (SELECT json_extract_string(metadata_json, '$.user_id') AS user_id, sum(value) AS tokens FROM model_metrics
                WHERE metric_type = 'token_usage' AND collected_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1),
        f AS ({_RATED.format(key='user_id', since='2001-07-03')})
        SELECT coalesce(t.user_id, f.user_id) AS user_id, round(coalesce(tokens, 0), 6) AS total_tokens_used,
               round(coalesce(average_rating, 0), 6) AS average_rating, coalesce(total_ratings, 0) AS total_ratings,
               coalesce(bad_responses_flagged, 0) AS bad_responses_flagged,
               coalesce(corrections_provided, 0) AS corrections_provided,
               coalesce(consent_given_count, 0) AS consent_given_count
        FROM t FULL JOIN f ON t.user_id = f.user_id"""),
    "model_perf_summary": with_views("model_metrics user_feedback", f"""
        , m AS (SELECT model_version_id, metric_type, count(*) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg,
                       round(min(value), 6) AS min, round(greatest(0, max(value)), 6) AS max
                FROM model_metrics WHERE collected_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2),
        f AS ({_RATED.format(key='model_version_id', since='2001-07-26')})
        SELECT coalesce(m.model_version_id, f.model_version_id) AS model_version_id, metric_type, count, sum, avg, min, max,
               coalesce(total_ratings, 0) AS total_ratings, round(coalesce(average_rating, 0), 6) AS average_rating,
               coalesce(bad_responses_flagged, 0) AS bad_responses_flagged
        FROM m FULL JOIN f ON m.model_version_id = f.model_version_id"""),
    "counter_rollup": with_views("model_metrics user_feedback requests", """
        , all_counters AS (
        SELECT 'token_usage_total' AS counter,
               '{"user_id":"' || json_extract_string(metadata_json, '$.user_id') || '","model_version":"' || model_version_id
                 || '","operation_type":"inference"}' AS labels, value AS v FROM model_metrics WHERE metric_type = 'token_usage'
        UNION ALL
        SELECT 'bad_responses_total', '{"reason":' || coalesce('"' || json_extract_string(metadata_json, '$.reason') || '"', 'null')
                 || ',"model_version":' || coalesce('"' || model_version_id || '"', 'null') || '}', 1.0
        FROM user_feedback WHERE feedback_type = 'flag_bad_response'
        UNION ALL
        SELECT 'model_inference_errors_total', '{"model_version":"' || model_version_id || '","error_type":"'
                 || CASE WHEN value > 50 THEN 'timeout' ELSE 'failure' END || '"}', 1.0
        FROM model_metrics WHERE metric_type = 'inference_errors'
        UNION ALL
        SELECT 'http_requests_total', '{"method":"' || method || '","endpoint":"' || endpoint || '","status":"' || status
                 || '"}', 1.0 FROM requests)
        SELECT counter, labels, round(sum(v), 6) AS value FROM all_counters GROUP BY 1, 2"""),
    "histogram_rollup": with_views("model_metrics user_feedback requests", ""
        + _sql_histogram("model_inference_latency_seconds",
                         """'{"model_version":"' || model_version_id || '","operation_type":"inference"}'""", "model_version_id",
                         "value / 20", "(SELECT * FROM model_metrics WHERE metric_type = 'inference_latency')")
        + " UNION ALL " + _sql_histogram(
            "user_satisfaction_score", """'{"model_version":' || coalesce('"' || model_version_id || '"', 'null') || '}'""",
            "model_version_id", "CAST(rating AS DOUBLE)",
            "(SELECT * FROM user_feedback WHERE feedback_type = 'rating' AND rating IS NOT NULL)")
        + " UNION ALL " + _sql_histogram(
            "response_quality_score", """'{"model_version":"' || model_version_id || '"}'""", "model_version_id",
            "value / 500", "(SELECT * FROM model_metrics WHERE metric_type = 'token_usage')")
        + " UNION ALL " + _sql_histogram(
            "http_request_duration_seconds", """'{"method":"' || method || '","endpoint":"' || endpoint || '"}'""",
            "method, endpoint", "seconds", "requests")),
    "model_metrics_recent": with_views("model_metrics", f"""
        SELECT model_version_id, row_number() OVER w AS rn, id, metric_type, value,
               {_AT.format('collected_at')} AS collected_at FROM model_metrics
        WINDOW w AS (PARTITION BY model_version_id ORDER BY collected_at DESC, id) QUALIFY rn <= 100"""),
    "version_compare": with_views("model_metrics", """
        , recent AS (SELECT *, row_number() OVER (PARTITION BY model_version_id ORDER BY collected_at DESC, id) AS rn
                     FROM model_metrics QUALIFY rn <= 100),
        a AS (SELECT model_version_id AS v, metric_type AS t, avg(value) AS m FROM recent GROUP BY 1, 2),
        pairs(x, y) AS (VALUES ('m0', 'm1'), ('m1', 'm2'), ('m2', 'm3'), ('m3', 'missing')),
        l AS (SELECT x, y, t, m FROM pairs JOIN a ON v = x), r AS (SELECT x, y, t, m FROM pairs JOIN a ON v = y)
        SELECT coalesce(l.x, r.x) AS version_a, coalesce(l.y, r.y) AS version_b, coalesce(l.t, r.t) AS metric_type,
               round(coalesce(l.m, 0), 6) AS version_a_avg, round(coalesce(r.m, 0), 6) AS version_b_avg,
               round(CASE WHEN coalesce(l.m, 0) <> 0 THEN (coalesce(r.m, 0) - l.m) / l.m * 100 ELSE 0 END, 6) AS improvement
        FROM l FULL JOIN r ON l.x = r.x AND l.y = r.y AND l.t = r.t"""),
    "sink_range_export": with_views("model_metrics", f"""
        SELECT model_version_id, metric_type, value, {_AT.format('collected_at')} AS timestamp, metadata_json AS metadata
        FROM model_metrics WHERE collected_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""),
    "sink_range_export_feedback": with_views("user_feedback", f"""
        SELECT user_id, model_version_id, feedback_type, rating, consent_given, {_AT.format('created_at')} AS timestamp
        FROM user_feedback WHERE created_at BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'"""),
}
