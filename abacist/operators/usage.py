"""Activity, purchases, payments, performance and the admin dashboard."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions.ranks import quantile_element
from abacist.functions.timing import at, day_of, on_day, since


def daily_active_users(ai_sessions: DataFrame, as_of: datetime, days: int = 30, error: float | None = None) -> DataFrame:
    """Distinct users per calendar day of ``started_at``; with ``error`` estimated to that relative deviation.

    The exact count merges (day, user) pairs on the map side first, so a busy day is many groups; the estimate
    moves one sketch per day and partition.
    """
    recent = ai_sessions.filter(since(ai_sessions, "started_at", as_of, days)).select(
        F.to_date("started_at").alias("date"), "user_id")
    if error is None:
        counted = recent.distinct().groupBy("date").agg(F.count("user_id").alias("active_users"))
    else:
        counted = recent.groupBy("date").agg(F.approx_count_distinct("user_id", error).alias("active_users"))
    return counted.orderBy("date").withColumn("date", day_of("date"))


def _purchases(transactions: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return transactions.filter((F.col("type") == "purchase") & since(transactions, "created_at", as_of, days))


def purchase_totals(transactions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return _purchases(transactions, as_of, days).agg(
        F.abs(F.coalesce(F.sum("amount"), F.lit(0))).alias("total_coins_purchased"),
        F.count(F.lit(1)).alias("total_purchase_transactions"),
        F.abs(F.coalesce(F.avg("amount"), F.lit(0.0))).alias("average_purchase_amount"))


def purchase_trend(transactions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return (_purchases(transactions, as_of, days).groupBy(F.to_date("created_at").alias("date"))
            .agg(F.abs(F.sum("amount")).alias("coins_purchased"), F.count(F.lit(1)).alias("transaction_count"))
            .orderBy("date").withColumn("date", day_of("date")))


def usage_totals(ai_sessions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return ai_sessions.filter(since(ai_sessions, "started_at", as_of, days)).agg(
        F.coalesce(F.sum("minutes_used"), F.lit(0.0)).alias("total_minutes_consumed"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.coalesce(F.avg("minutes_used"), F.lit(0.0)).alias("average_session_length"),
        F.coalesce(F.sum("total_duration_minutes"), F.lit(0)).alias("total_allocated_minutes"))


def usage_trend(ai_sessions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return (ai_sessions.filter(since(ai_sessions, "started_at", as_of, days))
            .groupBy(F.to_date("started_at").alias("date"))
            .agg(F.coalesce(F.sum("minutes_used"), F.lit(0.0)).alias("minutes_used"),
                 F.count(F.lit(1)).alias("session_count"))
            .orderBy("date").withColumn("date", day_of("date")))


def payment_failures(transactions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Purchases of amount 0: one row per description and one ``total`` row with the failure rate.

    A missing description is a reason of its own. The total is summed from the few rows of the reasons.
    """
    reasons = _purchases(transactions, as_of, days).groupBy("description").agg(
        F.count_if(F.col("amount") == 0).alias("failed"), F.count(F.lit(1)).alias("purchases"))
    total = reasons.agg(F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
                        F.coalesce(F.sum("purchases"), F.lit(0)).alias("purchases"))
    rate = F.col("failed") / F.greatest(F.lit(1), F.col("purchases"))
    return reasons.filter(F.col("failed") > 0).select(
        F.lit("reason").alias("row_type"), F.col("description").alias("reason"), F.col("failed").alias("failed_payments"),
        F.lit(None).cast("double").alias("failure_rate"),
    ).unionByName(total.select(F.lit("total").alias("row_type"), F.lit(None).cast("string").alias("reason"),
                               F.col("failed").alias("failed_payments"), rate.alias("failure_rate")))


def system_performance(model_metrics: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Average and 95th-percentile latency, error rate and counts, in one row."""
    recent = model_metrics.filter(
        F.col("metric_type").isin("inference_latency", "inference_errors")
        & since(model_metrics, "collected_at", as_of, days))
    latency = F.col("metric_type") == "inference_latency"
    p95 = quantile_element(recent.filter(latency), "value", 0.95).scalar()
    errors, total = F.count_if(~latency), F.count(F.lit(1))
    return recent.agg(
        F.coalesce(F.avg(F.when(latency, F.col("value"))), F.lit(0.0)).alias("average_latency_seconds"),
        (errors / F.greatest(F.lit(1), total)).alias("error_rate"),
        total.alias("total_requests"), errors.alias("total_errors"),
    ).select("average_latency_seconds", F.coalesce(p95, F.lit(0.0)).alias("p95_latency_seconds"),
             "error_rate", "total_requests", "total_errors")


def dashboard_summary(ai_sessions: DataFrame, transactions: DataFrame, tickets: DataFrame,
                      incidents: DataFrame, as_of: datetime) -> DataFrame:
    """Today's activity against yesterday's, open tickets and the week's unresolved incidents.

    Each fact is read once, cut to the days it needs, and gives partial columns of one row.
    """
    today = datetime(as_of.year, as_of.month, as_of.day)
    yesterday = today - timedelta(days=1)
    is_today = on_day(ai_sessions, "started_at", today)
    two_days = ai_sessions.filter(is_today | on_day(ai_sessions, "started_at", yesterday))
    # One row per user keeps the distinct counts mergeable.
    per_user = two_days.groupBy("user_id").agg(
        F.count_if(is_today).alias("now"), F.count_if(~is_today).alias("before"),
        F.sum(F.when(is_today, F.col("minutes_used"))).alias("minutes"))
    sessions = per_user.agg(
        F.count_if(F.col("now") > 0).alias("active_users"), F.coalesce(F.sum("now"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes_used"),
        (F.count_if(F.col("now") > 0) - F.count_if(F.col("before") > 0)).alias("active_users_change"),
        (F.coalesce(F.sum("now"), F.lit(0)) - F.coalesce(F.sum("before"), F.lit(0))).alias("sessions_change"))
    bought = transactions.filter((F.col("type") == "purchase") & on_day(transactions, "created_at", today)).agg(
        F.coalesce(F.sum(F.abs("amount")), F.lit(0)).alias("v"))
    opened = tickets.filter(F.col("status") == "open").agg(F.count(F.lit(1)).alias("v"))
    unresolved = incidents.filter(
        ~F.col("resolved") & (F.col("created_at") >= at(incidents, "created_at", today - timedelta(days=7)))
    ).agg(F.count(F.lit(1)).alias("v"))
    return sessions.select(
        "active_users", "sessions", "minutes_used", bought.scalar().alias("coins_purchased"),
        "active_users_change", "sessions_change", opened.scalar().alias("pending_support_tickets"),
        unresolved.scalar().alias("unresolved_safety_incidents"))
