"""Content safety, moderation, abuse patterns and incident statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import harm
from abacist.functions.timing import micros, seconds_between, since

SNIPPET = 200  # characters of a blocked message kept in its incident

# Advice for suspicious accounts.
ABUSE_ADVICE = ("Implement temporary rate limiting", "Require additional verification", "Monitor user activity closely")


def content_safety(df: DataFrame, text: str, age: str | None = None) -> DataFrame:
    """Adds ``violations``, ``severity_score``, ``is_safe`` and ``recommendations``."""
    found = F.col("violations")
    none = F.array().cast("array<string>")
    return (df.withColumn("violations", harm.violations(F.col(text)))
            .withColumn("severity_score", harm.score(found, None if age is None else F.col(age)))
            .withColumn("is_safe", F.col("severity_score") < harm.UNSAFE_FROM)
            .withColumn("recommendations", F.when(F.col("is_safe"), none).otherwise(harm.advice(found))))


def moderate(messages: DataFrame, text: str = "message") -> DataFrame:
    """Adds ``approved`` and ``verdict``; also what an incident needs (``violations``, ``severity_score``)."""
    checked = content_safety(messages, text)
    reason = F.concat(F.lit("Message blocked due to safety concerns: "),
                      F.array_join(F.col("violations").getField("category"), ", "))
    return checked.withColumns({"approved": F.col("is_safe"),
                                "verdict": F.when(F.col("is_safe"), "Message approved").otherwise(reason)})


def incidents_of(moderated: DataFrame, text: str = "message") -> DataFrame:
    """Incident rows for the messages ``moderate`` did not approve."""
    long = F.char_length(F.col(text)) > SNIPPET
    return moderated.filter(~F.col("approved")).select(
        "id", F.lit("harmful_content").alias("incident_type"),
        F.when(F.col("severity_score") > 0.8, "medium").otherwise("low").alias("severity"),
        F.lit("Harmful content detected in global chat").alias("description"), "user_id",
        F.when(long, F.concat(F.substring(text, 1, SNIPPET), F.lit("..."))).otherwise(F.col(text)).alias("content_snippet"),
        F.lit(False).alias("resolved"), "created_at")


def keyword_moderation(messages: DataFrame, text: str = "message") -> DataFrame:
    """Adds ``allowed``: no blocked word occurs, not even inside another word."""
    return messages.withColumn("allowed", ~harm.has_blocked_word(F.col(text)))


def query_intent(queries: DataFrame, text: str) -> DataFrame:
    return queries.withColumn("intents", harm.intents(F.col(text)))


def rapid_fire_gaps(interactions: DataFrame, last: int = 10) -> DataFrame:
    """Whole-second gaps between each user's ``last`` interactions; whole days are dropped from a gap.

    (user_id, ts, id) in; the rank filter runs before the shuffle, so at most ``last`` rows per user and
    input partition move.
    """
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    tail = interactions.select("user_id", "id", "ts").withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= last)
    gap = F.floor((micros("ts") - micros("previous")) / F.lit(1_000_000))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy(F.col("rn").desc()))
    return (tail.withColumn("previous", before).filter(F.col("previous").isNotNull())
            .select("user_id", "id", "ts", F.pmod(gap, F.lit(86_400)).alias("gap_seconds")))


def abuse_patterns(interactions: DataFrame) -> DataFrame:
    """Per user: repetition, rapid fire and flagged share over all its interactions (user_id, id, query, ts, flagged)."""
    # Query texts are counted per (user, text) first, so neither a busy user nor a common text is one group.
    texts = (interactions.groupBy("user_id", "query").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))
             .groupBy("user_id").agg(F.sum("n").alias("interactions"), F.count(F.lit(1)).alias("distinct_queries"),
                                     F.sum("flagged").alias("flagged")))
    gaps = rapid_fire_gaps(interactions).groupBy("user_id").agg(F.avg("gap_seconds").alias("average_gap"))
    n = F.col("interactions")
    repetitive = (n > 5) & (F.col("distinct_queries") / n < 0.3)
    rapid = (n > 10) & F.coalesce(F.col("average_gap") < 5, F.lit(False))
    flagged = F.col("flagged") / n > 0.5
    rules = (("repetitive_queries", repetitive, 0.3), ("rapid_fire_queries", rapid, 0.4), ("consistently_flagged", flagged, 0.5))
    risk = F.lit(0.0)
    for _, hit, weight in rules:
        risk = risk + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    patterns = F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit, _ in rules)), lambda p: p.isNotNull())
    none = F.array().cast("array<string>")
    return (texts.join(gaps, "user_id", "left")
            .select("user_id", "interactions", patterns.alias("patterns_detected"), risk.alias("risk_score"))
            .withColumn("suspicious_activity", F.col("risk_score") > 0.5)
            .withColumn("recommendations", F.when(F.col("suspicious_activity"), F.array(*(F.lit(a) for a in ABUSE_ADVICE)))
                        .otherwise(none)))


def safety_stats(incidents: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Incident counts by type, by severity and overall, with resolved counts and average hours to resolve.

    Rows carry ``breakdown`` (type, severity or total), all summed from one count per (type, severity); the total
    is there even without incidents.
    """
    timed = F.col("resolved") & F.col("resolved_at").isNotNull()
    hours = seconds_between("resolved_at", "created_at") / 3600
    base = incidents.filter(since(incidents, "created_at", as_of, days)).groupBy("incident_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved"), F.count_if(timed).alias("timed"),
        F.sum(F.when(timed, hours)).alias("hours"))
    def part(breakdown: str, value: str | None) -> DataFrame:
        rows = base if value is None else base.groupBy(F.col(value).alias("value"))
        summed = rows.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved_incidents"),
            F.coalesce(F.try_divide(F.sum("hours"), F.sum("timed")), F.lit(0.0)).alias("average_resolution_time_hours"))
        named = summed if value is not None else summed.withColumn("value", F.lit(None).cast("string"))
        return named.select(F.lit(breakdown).alias("breakdown"), "value", "incidents", "resolved_incidents",
                            "average_resolution_time_hours")

    return part("type", "incident_type").unionByName(part("severity", "severity")).unionByName(part("total", None))
