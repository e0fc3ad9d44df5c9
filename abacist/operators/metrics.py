"""Model and user metrics, counters, histograms and exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions.timing import at, iso, since

# Default upper bounds of the metrics client's histograms.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def metrics_of_user(model_metrics: DataFrame, user_id: str | None = None) -> DataFrame:
    """Metrics whose metadata names a user (or the given one), with the name as ``user_id``."""
    tagged = model_metrics.withColumn("user_id", F.get_json_object("metadata_json", "$.user_id"))
    return tagged.filter(F.col("user_id").isNotNull() if user_id is None else F.col("user_id") == user_id)


def new_metrics(rows: DataFrame) -> DataFrame:
    """Metric rows ready to append."""
    return rows.select("id", "model_version_id", "metric_type", F.col("value").cast("double").alias("value"),
                       "metadata_json", "collected_at")


def user_summary(model_metrics: DataFrame, feedback: DataFrame, metrics_as_of: datetime,
                 feedback_as_of: datetime | None = None, days: int = 30) -> DataFrame:
    """Per user over ``days``: tokens, ratings, flags, corrections and consents; 0 where there is none."""
    tokens = (metrics_of_user(model_metrics.filter((F.col("metric_type") == "token_usage")
                                                   & since(model_metrics, "collected_at", metrics_as_of, days)))
              .groupBy("user_id").agg(F.sum("value").alias("total_tokens_used")))
    given = (feedback.filter(since(feedback, "created_at", feedback_as_of or metrics_as_of, days)).groupBy("user_id").agg(
        F.avg("rating").alias("average_rating"), F.count("rating").alias("total_ratings"),
        F.count_if(F.col("feedback_type") == "flag_bad_response").alias("bad_responses_flagged"),
        F.count_if(F.col("feedback_type") == "correction").alias("corrections_provided"),
        F.count_if("consent_given").alias("consent_given_count")))
    joined = tokens.join(given, "user_id", "full_outer")
    return joined.select("user_id", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in joined.dtypes if c != "user_id"))


def model_summary(model_metrics: DataFrame, feedback: DataFrame, metrics_as_of: datetime,
                  feedback_as_of: datetime | None = None, days: int = 7) -> DataFrame:
    """Per model version and metric type: count, sum, avg, min and max, with the version's feedback.

    The maximum starts from 0, so it is never negative. Versions with feedback only keep one row.
    """
    per_type = (model_metrics.filter(since(model_metrics, "collected_at", metrics_as_of, days))
                .groupBy("model_version_id", "metric_type").agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.avg("value").alias("avg"),
        F.min("value").alias("min"), F.greatest(F.lit(0.0), F.max("value")).alias("max")))
    rated = (feedback.filter(F.col("model_version_id").isNotNull()
                             & since(feedback, "created_at", feedback_as_of or metrics_as_of, days))
             .groupBy("model_version_id").agg(
        F.count("rating").alias("total_ratings"), F.avg("rating").alias("average_rating"),
        F.count_if(F.col("feedback_type") == "flag_bad_response").alias("bad_responses_flagged")))
    return per_type.join(rated, "model_version_id", "full_outer").select(
        "model_version_id", "metric_type", "count", "sum", "avg", "min", "max",
        F.coalesce("total_ratings", F.lit(0).cast("bigint")).alias("total_ratings"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"),
        F.coalesce("bad_responses_flagged", F.lit(0).cast("bigint")).alias("bad_responses_flagged"))


def counter(rows: DataFrame, name: str, labels: Sequence[str], amount: Column | None = None) -> DataFrame:
    """A labelled counter: rows, or the sum of ``amount``, per label combination."""
    value = F.count(F.lit(1)).cast("double") if amount is None else F.sum(amount).cast("double")
    return rows.groupBy(*labels).agg(value.alias("value")).select(
        F.lit(name).alias("counter"),
        F.to_json(F.struct(*labels), {"ignoreNullFields": "false"}).alias("labels"), "value")


def histogram(rows: DataFrame, name: str, labels: Sequence[str], value: str,
              bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """A labelled histogram: cumulative count per upper bound, with the overall sum and count.

    One aggregation counts all bounds; the buckets are unpivoted from its few result rows.
    """
    counts = [F.expr(f"count_if(`{value}` <= {b}D) AS b{i}") for i, b in enumerate(bounds)]
    wide = rows.filter(F.col(value).isNotNull()).groupBy(*labels).agg(
        *counts, F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count"))
    buckets = ", ".join([f"struct('{b}' AS le, b{i} AS bucket_count)" for i, b in enumerate(bounds)] + ["struct('+Inf' AS le, count AS bucket_count)"])
    return wide.select(
        F.lit(name).alias("histogram"), F.to_json(F.struct(*labels), {"ignoreNullFields": "false"}).alias("labels"),
        F.expr(f"inline(array({buckets}))"), "sum", "count",
    )


def recent_per_version(model_metrics: DataFrame, limit: int = 100, metric_type: str | None = None) -> DataFrame:
    """Each version's latest ``limit`` metrics, over all types unless one is given."""
    chosen = model_metrics if metric_type is None else model_metrics.filter(F.col("metric_type") == metric_type)
    newest = Window.partitionBy("model_version_id").orderBy(F.col("collected_at").desc(), "id")
    return chosen.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= limit)


def version_compare(model_metrics: DataFrame, pairs: DataFrame, limit: int = 100) -> DataFrame:
    """Averages of two versions per metric type over each version's latest ``limit`` metrics.

    ``pairs`` has version_a and version_b. A type only one side knows counts as 0 on the other;
    improvement is 0 where A's average is 0.
    """
    averages = recent_per_version(model_metrics, limit).groupBy("model_version_id", "metric_type").agg(
        F.avg("value").alias("average"))
    a = pairs.join(averages.withColumnsRenamed({"model_version_id": "version_a", "average": "avg_a"}), "version_a")
    b = pairs.join(averages.withColumnsRenamed({"model_version_id": "version_b", "average": "avg_b"}), "version_b")
    both = a.join(b, ["version_a", "version_b", "metric_type"], "full_outer")
    avg_a, avg_b = F.coalesce("avg_a", F.lit(0.0)), F.coalesce("avg_b", F.lit(0.0))
    return both.select(
        "version_a", "version_b", "metric_type", avg_a.alias("version_a_avg"), avg_b.alias("version_b_avg"),
        F.when(avg_a != 0, (avg_b - avg_a) / F.nullif(avg_a, F.lit(0.0)) * 100).otherwise(0.0).alias("improvement"))


def export_metrics(model_metrics: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Metrics with ``start <= collected_at <= end``, times as ISO text."""
    inside = F.col("collected_at").between(at(model_metrics, "collected_at", start), at(model_metrics, "collected_at", end))
    return model_metrics.filter(inside).select(
        "model_version_id", "metric_type", "value", iso("collected_at").alias("timestamp"),
        F.col("metadata_json").alias("metadata"))


def export_feedback(feedback: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Feedback of the same kind of range, without any text."""
    inside = F.col("created_at").between(at(feedback, "created_at", start), at(feedback, "created_at", end))
    return feedback.filter(inside).select(
        "user_id", "model_version_id", "feedback_type", "rating", "consent_given", iso("created_at").alias("timestamp"))
