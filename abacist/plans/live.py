"""Streaming queries, run over what the input folder holds now and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions.timing import iso
from abacist.plans import safety as batch_safety
from abacist.plans.views import view, with_views
from abacist.session import scratch_path
from abacist.streaming import streams


#: Files, and so batches, over which the rows of a table are dealt out in no order.
FILES = 4


def _run(spark, stream, name, reduce=None):
    """The rows a stream writes, with the number of the batch that wrote them."""
    path = scratch_path(spark, name)
    streams.start(stream, streams.batch_folder(f"{path}/out", reduce), f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _stream_moderation(spark, d):
    stream = view(spark, d, "chat_messages", stream=True).select("id", "user_id", "message", "created_at")
    root = scratch_path(spark, "moderation")
    approved, incidents = f"{root}/approved", f"{root}/incidents"
    streams.start(stream, streams.moderation_sink(approved, incidents), f"{root}/checkpoint", once=True).awaitTermination()
    good = spark.read.parquet(approved).select("id", F.lit("approved").alias("outcome"), F.lit(None).cast("string").alias("severity"))
    bad = spark.read.parquet(incidents).select("id", F.lit("blocked").alias("outcome"), "severity")
    return good.unionByName(bad)


def _stream_rate_limit(spark, d):
    stream = streams.admission(view(spark, d, "actions", stream=True))
    return _run(spark, stream, "admission").drop("batch")


def _stream_tokens_per_minute(spark, d):
    stream = streams.tokens_per_minute(view(spark, d, "model_metrics", stream=True, files=FILES))
    out = streams.sum_tokens(_run(spark, stream, "tokens", streams.partial_tokens))
    return out.select(iso("minute").alias("minute"), "user_id", F.round("tokens", 6).alias("tokens"))


def _stream_dau(spark, d):
    stream = streams.daily_users(view(spark, d, "ai_sessions", stream=True, files=FILES))
    return streams.count_daily_users(_run(spark, stream, "dau", streams.sightings))


QUERIES = {
    "stream_moderation": _stream_moderation,
    "stream_rate_limit": _stream_rate_limit,
    "stream_tokens_per_minute": _stream_tokens_per_minute,
    "stream_dau": _stream_dau,
}

ORACLES = {
    "stream_moderation": with_views("chat_messages", batch_safety.CHECKED + """
        SELECT m.id, CASE WHEN coalesce(top, 0) < 0.7 THEN 'approved' ELSE 'blocked' END AS outcome,
               CASE WHEN top > 0.8 THEN 'medium' WHEN top >= 0.7 THEN 'low' END AS severity
        FROM chat_messages m LEFT JOIN found USING (id)"""),
    "stream_rate_limit": batch_safety.ORACLES["rate_limit_admission"],
    "stream_tokens_per_minute": with_views("model_metrics", """
        SELECT strftime(date_trunc('minute', collected_at), '%Y-%m-%dT%H:%M:%S.%f') AS minute,
               json_extract_string(metadata_json, '$.user_id') AS user_id, round(sum(value), 6) AS tokens
        FROM model_metrics WHERE metric_type = 'token_usage' GROUP BY 1, 2"""),
    "stream_dau": with_views("ai_sessions", """
        SELECT strftime(started_at, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS active_users FROM ai_sessions GROUP BY 1"""),
}
