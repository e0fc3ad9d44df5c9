"""Queries on activity, purchases and support."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions.timing import iso
from abacist.operators import support, usage
from abacist.plans.views import AS_OF, AS_OF_ORDERS, appended, view, with_views


def _dau(spark, d):
    return usage.daily_active_users(view(spark, d, "ai_sessions"), AS_OF)


def _coin_purchase_totals(spark, d):
    out = usage.purchase_totals(view(spark, d, "transactions"), AS_OF)
    return out.withColumn("average_purchase_amount", F.round("average_purchase_amount", 6))


def _coin_purchase_daily(spark, d):
    return usage.purchase_trend(view(spark, d, "transactions"), AS_OF)


def _ai_usage_totals(spark, d):
    out = usage.usage_totals(view(spark, d, "ai_sessions"), AS_OF)
    return out.withColumns({c: F.round(c, 6) for c in ("total_minutes_consumed", "average_session_length")})


def _ai_usage_daily(spark, d):
    return usage.usage_trend(view(spark, d, "ai_sessions"), AS_OF).withColumn("minutes_used", F.round("minutes_used", 6))


def _payment_failures(spark, d):
    return usage.payment_failures(view(spark, d, "transactions"), AS_OF).withColumn(
        "failure_rate", F.round("failure_rate", 9))


def _system_perf(spark, d):
    return usage.system_performance(view(spark, d, "model_metrics"), AS_OF).withColumns(
        {c: F.round(c, 6) for c in ("average_latency_seconds", "p95_latency_seconds", "error_rate")})


def _dashboard_summary(spark, d):
    out = usage.dashboard_summary(*(view(spark, d, v) for v in ("ai_sessions", "transactions", "support_tickets",
                                                               "safety_incidents")), _DASHBOARD_DAY)
    return out.withColumn("minutes_used", F.round("minutes_used", 6))


_DASHBOARD_DAY = AS_OF.replace(day=30, hour=18)


def _tickets_by_status(spark, d):
    rows = support.tickets_by_status(view(spark, d, "support_tickets"), "open", 50)
    return rows.select("id", "user_id", "subject", "category", "status", "priority",
                       iso("created_at").alias("created_at"), iso("last_updated").alias("last_updated"), "assigned_to")


def _tickets_of_user(spark, d):
    rows = support.tickets_of_user(view(spark, d, "support_tickets"))
    return rows.select("id", "user_id", "subject", "category", "status", "priority", iso("created_at").alias("created_at"))


def _abuse_reports(spark, d):
    rows = support.abuse_reports(view(spark, d, "safety_incidents"), AS_OF_ORDERS, days=365)
    return rows.withColumn("created_at", iso("created_at"))


def _new_tickets(spark, d):
    requests = view(spark, d, "support_tickets").select(
        "id", "user_id", "subject", "category", F.concat(F.lit("About "), "subject").alias("description"),
        F.when(F.col("priority") != "low", F.col("priority")).alias("priority"), "created_at")
    return appended(support.new_tickets(requests), "tickets", "support_tickets").select("id", "user_id", "subject", "category", "description", "status", "priority",
                                                iso("created_at").alias("created_at"))


def _reports(spark, d):
    messages = view(spark, d, "chat_messages")
    return messages.select(
        F.concat(F.lit("r"), "id").alias("id"), "user_id", F.lit("chat").alias("content_type"),
        F.col("id").alias("content_id"), F.when(F.col("user_age") % 2 == 0, "spam").otherwise("insult").alias("reason"),
        F.when(F.col("user_age") % 3 == 0, "please look").when(F.col("user_age") % 3 == 1, "").alias("description"),
        F.col("message").alias("content_snippet"), "created_at")


def _abuse_tickets(spark, d):
    return appended(support.abuse_tickets(_reports(spark, d)), "abuse-tickets", "support_tickets").select(
        "id", "user_id", "subject", "category", "description", "status", "priority", iso("created_at").alias("created_at"))


def _abuse_incidents(spark, d):
    return appended(support.abuse_incidents(_reports(spark, d)), "abuse-incidents", "safety_incidents").select(
        "id", "incident_type", "severity", "description", "user_id", "content_snippet", "actions_taken", "resolved",
        iso("created_at").alias("created_at"))


QUERIES = {
    "dau": _dau,
    "coin_purchase_totals": _coin_purchase_totals,
    "coin_purchase_daily": _coin_purchase_daily,
    "ai_usage_totals": _ai_usage_totals,
    "ai_usage_daily": _ai_usage_daily,
    "payment_failures": _payment_failures,
    "system_perf": _system_perf,
    "dashboard_summary": _dashboard_summary,
    "tickets_by_status": _tickets_by_status,
    "tickets_of_user": _tickets_of_user,
    "abuse_reports": _abuse_reports,
    "sink_append": _new_tickets,
    "sink_append_abuse_tickets": _abuse_tickets,
    "sink_append_abuse_incidents": _abuse_incidents,
}

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') AS {0}"
_TS = ISO.format("created_at")
_REPORTS = """, reports AS (
    SELECT 'r' || id AS id, user_id, 'chat' AS content_type, id AS content_id,
           CASE WHEN user_age % 2 = 0 THEN 'spam' ELSE 'insult' END AS reason,
           CASE user_age % 3 WHEN 0 THEN 'please look' WHEN 1 THEN '' END AS description,
           message AS content_snippet, created_at FROM chat_messages) """

ORACLES = {
    "dau": with_views("ai_sessions", """
        SELECT strftime(started_at, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS active_users FROM ai_sessions
        WHERE started_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1"""),
    "coin_purchase_totals": with_views("transactions", """
        SELECT CAST(abs(coalesce(sum(amount), 0)) AS BIGINT) AS total_coins_purchased,
               count(*) AS total_purchase_transactions, round(abs(coalesce(avg(amount), 0)), 6) AS average_purchase_amount
        FROM transactions WHERE type = 'purchase' AND created_at >= TIMESTAMP '2024-01-01 00:00:00'"""),
    "coin_purchase_daily": with_views("transactions", """
        SELECT strftime(created_at, '%Y-%m-%d') AS date, CAST(abs(sum(amount)) AS BIGINT) AS coins_purchased,
               count(*) AS transaction_count
        FROM transactions WHERE type = 'purchase' AND created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1"""),
    "ai_usage_totals": with_views("ai_sessions", """
        SELECT round(coalesce(sum(minutes_used), 0), 6) AS total_minutes_consumed, count(*) AS total_sessions,
               round(coalesce(avg(minutes_used), 0), 6) AS average_session_length,
               CAST(coalesce(sum(total_duration_minutes), 0) AS BIGINT) AS total_allocated_minutes
        FROM ai_sessions WHERE started_at >= TIMESTAMP '2024-01-01 00:00:00'"""),
    "ai_usage_daily": with_views("ai_sessions", """
        SELECT strftime(started_at, '%Y-%m-%d') AS date, round(sum(minutes_used), 6) AS minutes_used,
               count(*) AS session_count
        FROM ai_sessions WHERE started_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1"""),
    "payment_failures": with_views("transactions", """
        , bought AS (SELECT * FROM transactions WHERE type = 'purchase' AND created_at >= TIMESTAMP '2024-01-01 00:00:00')
        SELECT 'reason' AS row_type, description AS reason, count(*) AS failed_payments,
               CAST(NULL AS DOUBLE) AS failure_rate FROM bought WHERE amount = 0 GROUP BY description
        UNION ALL SELECT 'total', NULL, count(*) FILTER (amount = 0),
               round(count(*) FILTER (amount = 0) / greatest(1, count(*)), 9) FROM bought"""),
    "system_perf": with_views("model_metrics", """
        , recent AS (SELECT * FROM model_metrics WHERE collected_at >= TIMESTAMP '2024-01-24 00:00:00'
                     AND metric_type IN ('inference_latency', 'inference_errors')),
        latencies AS (SELECT list_sort(list(value)) AS l FROM recent WHERE metric_type = 'inference_latency')
        SELECT round(avg(value) FILTER (metric_type = 'inference_latency'), 6) AS average_latency_seconds,
               round((SELECT l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] FROM latencies), 6) AS p95_latency_seconds,
               round(count(*) FILTER (metric_type = 'inference_errors') / count(*), 6) AS error_rate,
               count(*) AS total_requests, count(*) FILTER (metric_type = 'inference_errors') AS total_errors FROM recent"""),
    "dashboard_summary": with_views("ai_sessions transactions support_tickets safety_incidents", """
        , s AS (SELECT CAST(started_at AS DATE) AS d, count(DISTINCT user_id) AS users, count(*) AS n, sum(minutes_used) AS m
                FROM ai_sessions GROUP BY 1),
        t AS (SELECT * FROM s WHERE d = DATE '2024-01-30'), y AS (SELECT * FROM s WHERE d = DATE '2024-01-29')
        SELECT coalesce((SELECT users FROM t), 0) AS active_users, coalesce((SELECT n FROM t), 0) AS sessions,
               round(coalesce((SELECT m FROM t), 0), 6) AS minutes_used,
               (SELECT CAST(coalesce(sum(abs(amount)), 0) AS BIGINT) FROM transactions WHERE type = 'purchase'
                  AND CAST(created_at AS DATE) = DATE '2024-01-30') AS coins_purchased,
               coalesce((SELECT users FROM t), 0) - coalesce((SELECT users FROM y), 0) AS active_users_change,
               coalesce((SELECT n FROM t), 0) - coalesce((SELECT n FROM y), 0) AS sessions_change,
               (SELECT count(*) FROM support_tickets WHERE status = 'open') AS pending_support_tickets,
               (SELECT count(*) FROM safety_incidents WHERE NOT resolved
                  AND created_at >= TIMESTAMP '2024-01-23 00:00:00') AS unresolved_safety_incidents"""),
    "tickets_by_status": with_views("support_tickets", f"""
        , top AS (SELECT * FROM support_tickets WHERE status = 'open' ORDER BY created_at DESC, id LIMIT 50)
        SELECT id, user_id, subject, category, status, priority, {_TS}, CAST(NULL AS VARCHAR) AS last_updated, assigned_to
        FROM top"""),
    "tickets_of_user": with_views("support_tickets", f"""
        SELECT id, user_id, subject, category, status, priority, {_TS} FROM support_tickets"""),
    "abuse_reports": with_views("safety_incidents", f"""
        SELECT id, incident_type, severity, description, user_id, content_snippet, resolved, {_TS}
        FROM safety_incidents WHERE created_at >= TIMESTAMP '2000-08-02 00:00:00'
          AND incident_type IN ('abuse', 'harmful_content')"""),
    "sink_append": with_views("support_tickets", f"""
        SELECT id, user_id, subject, category, 'About ' || subject AS description, 'open' AS status,
               CASE WHEN priority = 'low' THEN 'medium' ELSE priority END AS priority, {_TS} FROM support_tickets"""),
    "sink_append_abuse_tickets": with_views("chat_messages", _REPORTS + f"""
        SELECT id, user_id, 'Abuse Report: ' || content_type AS subject, 'abuse' AS category,
               'Content Type: ' || content_type || chr(10) || 'Content ID: ' || content_id || chr(10) || 'Reason: ' || reason
                 || chr(10) || 'Description: ' || CASE WHEN coalesce(description, '') = '' THEN 'N/A' ELSE description END
                 AS description, 'open' AS status, 'high' AS priority, {_TS} FROM reports"""),
    "sink_append_abuse_incidents": with_views("chat_messages", _REPORTS + f"""
        SELECT id, 'abuse' AS incident_type, 'medium' AS severity, 'Abusive content reported: ' || reason AS description,
               user_id, content_snippet,
               '[{{"action":"reported","reported_by":"' || user_id || '","reason":"' || reason || '","content_type":"chat",'
                 || '"content_id":"' || content_id || '","timestamp":"'
                 || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '"}}]' AS actions_taken,
               false AS resolved, {_TS} FROM reports"""),
}
