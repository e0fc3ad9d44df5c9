"""Rows of the public and the private chat, and the queue of interaction feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import harm


def _attachments() -> Column:
    return F.coalesce("attachments", F.array().cast("array<string>"))


def public_rows(messages: DataFrame) -> DataFrame:
    """Messages (id, user_id, message, attachments, created_at) as stored: blocked words keep a message out."""
    return messages.filter(~harm.has_blocked_word(F.col("message"))).select(
        "id", F.coalesce("user_id", F.lit("anonymous")).alias("user_id"), "message", _attachments().alias("attachments"),
        F.lit(False).alias("is_moderated"), F.lit(None).cast("string").alias("moderated_by"), "created_at")


def private_rows(messages: DataFrame, key: Column) -> DataFrame:
    """Messages to or from an admin with their text encrypted (AES-GCM, base64) under ``key``.

    Each text gets a fresh initial vector, so equal messages differ when stored.
    """
    return messages.select(
        "id", "user_id", F.coalesce("admin_id", F.lit("admin")).alias("admin_id"),
        F.base64(F.aes_encrypt(F.encode("message", "UTF-8"), key)).alias("message"),
        F.coalesce("is_from_admin", F.lit(False)).alias("is_from_admin"), _attachments().alias("attachments"), "created_at")


def read_private(rows: DataFrame, key: Column) -> DataFrame:
    """The same rows with their text readable; text under another key is null."""
    return rows.withColumn("message", F.decode(F.try_aes_decrypt(F.unbase64("message"), key), "UTF-8"))


def feedback_queue(items: DataFrame) -> DataFrame:
    """Feedback on single interactions as queued: (interaction_id, feedback as JSON, timestamp)."""
    about = F.struct(*(c for c in items.columns if c not in ("interaction_id", "created_at")))
    return items.select("interaction_id", F.to_json(about).alias("feedback"), F.col("created_at").alias("timestamp"))
