"""Support tickets and abuse reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions.timing import iso, since


def tickets_by_status(tickets: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest tickets; the id breaks ties, which makes the cut repeatable."""
    chosen = tickets if status is None else tickets.filter(F.col("status") == status)
    return chosen.orderBy(F.col("created_at").desc(), "id").limit(limit)


def tickets_of_user(tickets: DataFrame, user_id: str | None = None) -> DataFrame:
    """One user's tickets, newest first; without ``user_id`` those of all users, in no order."""
    if user_id is None:
        return tickets
    return tickets.filter(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), "id")


def abuse_reports(incidents: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return (incidents.filter(F.col("incident_type").isin("abuse", "harmful_content")
                             & since(incidents, "created_at", as_of, days))
            .select("id", "incident_type", "severity", "description", "user_id", "content_snippet", "resolved",
                    "created_at")
            .orderBy(F.col("created_at").desc(), "id"))


def new_tickets(requests: DataFrame) -> DataFrame:
    """Ticket rows from requests (id, user_id, subject, category, description, priority, created_at)."""
    return requests.select(
        "id", "user_id", "subject", "category", "description", F.lit("open").alias("status"),
        F.coalesce("priority", F.lit("medium")).alias("priority"), F.lit(None).cast("string").alias("assigned_to"),
        "created_at", F.lit(None).cast("timestamp").alias("last_updated"),
        F.lit(None).cast("string").alias("resolution_notes"))


def abuse_tickets(reports: DataFrame) -> DataFrame:
    """High-priority abuse tickets from reports (id, user_id, content_type, content_id, reason, description, created_at)."""
    text = F.concat_ws(
        "\n", F.concat(F.lit("Content Type: "), "content_type"), F.concat(F.lit("Content ID: "), "content_id"),
        F.concat(F.lit("Reason: "), "reason"),
        F.concat(F.lit("Description: "), F.coalesce(F.nullif("description", F.lit("")), F.lit("N/A"))))
    return new_tickets(reports.select(
        "id", "user_id", F.concat(F.lit("Abuse Report: "), "content_type").alias("subject"),
        F.lit("abuse").alias("category"), text.alias("description"), F.lit("high").alias("priority"), "created_at"))


def abuse_incidents(reports: DataFrame) -> DataFrame:
    """Incident rows for the same reports, with the report itself as the first action taken."""
    action = F.struct(
        F.lit("reported").alias("action"), F.col("user_id").alias("reported_by"), "reason", "content_type", "content_id",
        iso("created_at").alias("timestamp"))
    return new_incidents(reports.select(
        "id", F.lit("abuse").alias("incident_type"), F.lit("medium").alias("severity"),
        F.concat(F.lit("Abusive content reported: "), "reason").alias("description"), "user_id",
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("model_version_id"),
        "content_snippet", F.to_json(F.array(action)).alias("actions_taken"), "created_at"))


def new_incidents(rows: DataFrame) -> DataFrame:
    """Incident rows with the defaults of the log (type unknown, severity low, empty text, no actions)."""
    return rows.select(
        "id", F.coalesce("incident_type", F.lit("unknown")).alias("incident_type"),
        F.coalesce("severity", F.lit("low")).alias("severity"),
        F.coalesce("description", F.lit("")).alias("description"), "user_id", "session_id", "model_version_id",
        F.coalesce("content_snippet", F.lit("")).alias("content_snippet"),
        F.coalesce("actions_taken", F.lit("[]")).alias("actions_taken"), F.lit(False).alias("resolved"),
        F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("timestamp").alias("resolved_at"),
        "created_at")

