"""Feedback intake, consent, training aggregates, privacy reports and retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import pii
from abacist.functions.timing import at, iso

TRAINING_TYPES = ("correction", "training_suggestion")


def detect(df: DataFrame, text: str) -> DataFrame:
    """Adds ``pii_types`` and ``fully_sanitized``."""
    return df.withColumn("pii_types", pii.detected(F.col(text))).withColumn("fully_sanitized", F.size("pii_types") == 0)


def redact(df: DataFrame, text: str) -> DataFrame:
    """Adds ``sanitized_text``, ``pii_types`` and ``fully_sanitized`` (always true: everything found is replaced)."""
    return (df.withColumn("pii_types", pii.detected(F.col(text)))
            .withColumns({"sanitized_text": pii.redacted(F.col(text), F.col("pii_types")), "fully_sanitized": F.lit(True)}))


def anonymize(df: DataFrame) -> DataFrame:
    """Replaces user_id, email and ip_address, where present, by their coarse forms."""
    coarse = {"user_id": ("user_hash", pii.user_hash), "email": ("email_domain", pii.email_domain),
              "ip_address": ("ip_region", pii.ip_region)}
    for column, (name, make) in coarse.items():
        if column in df.columns:
            df = df.withColumn(name, make(F.col(column))).drop(column)
    return df


#: Where an item belongs: kept as submitted by every kind of intake.
PLACE = ("session_id", "chat_id", "model_version_id")


def _anonymous(metadata: Column) -> Column:
    """A metadata map with the coarse forms of user_id, email and ip_address in place of these."""
    coarse = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("user_hash").alias("k"), pii.user_hash(metadata["user_id"]).alias("v")),
        F.struct(F.lit("email_domain").alias("k"), pii.email_domain(metadata["email"]).alias("v")),
        F.struct(F.lit("ip_region").alias("k"), pii.ip_region(metadata["ip_address"]).alias("v"))), lambda e: e["v"].isNotNull()))
    rest = F.map_filter(metadata, lambda k, v: ~k.isin("user_id", "email", "ip_address", "user_hash", "email_domain", "ip_region"))
    return F.map_concat(rest, coarse)


def _merged(*objects: Column) -> Column:
    """One JSON object from the members of several; null where all are empty or null."""
    members = [F.nullif(F.substring(F.coalesce(o, F.lit("{}")), F.lit(2), F.length(F.coalesce(o, F.lit("{}"))) - 2), F.lit("")) for o in objects]
    joined = F.concat_ws(",", *members)
    return F.when(joined != "", F.concat(F.lit("{"), joined, F.lit("}")))


def ingest(submissions: DataFrame) -> DataFrame:
    """Feedback rows from submissions, with ``reject_reason`` set instead of an error.

    Columns: id, user_id, type, consent_given, correction, flagged_content, rating, session_id, chat_id, model_version_id,
    metadata (map of texts), created_at. Corrections are only checked, flagged text is redacted; metadata is made anonymous
    and joined with what was found in the texts.
    """
    none = F.array().cast("array<string>")
    checked = submissions.select(
        "*", F.when(F.col("correction").isNotNull(), pii.detected(F.col("correction"))).otherwise(none).alias("in_correction"),
        F.when(F.col("flagged_content").isNotNull(), pii.detected(F.col("flagged_content"))).otherwise(none).alias("in_flagged"))
    rows = checked.select(
        "id", "user_id", *PLACE, "metadata", F.coalesce("type", F.lit("general")).alias("feedback_type"), "rating",
        F.coalesce("consent_given", F.lit(False)).alias("consent_given"), F.col("correction").alias("user_correction"),
        F.when(F.col("flagged_content").isNotNull(), pii.redacted(F.col("flagged_content"), F.col("in_flagged")))
        .alias("flagged_content"),
        F.array_sort(F.array_union("in_correction", "in_flagged")).alias("pii_types"), "created_at")
    # A correction is stored as given, so only text free of findings counts as sanitized; a submission
    # without a correction differs from nothing, and passes only when nothing was found either.
    found = F.when(F.size("pii_types") > 0, F.to_json(F.struct(
        F.col("pii_types").alias("pii_detected"), F.lit(True).alias("pii_sanitization_performed"))))
    return rows.select(
        *[c for c in rows.columns if c != "metadata"], (F.size("pii_types") == 0).alias("pii_sanitized"),
        _merged(F.to_json(_anonymous(F.col("metadata"))), found).alias("metadata_json"),
        F.when(F.col("feedback_type").isin(*TRAINING_TYPES) & ~F.col("consent_given"), F.lit("consent required"))
        .alias("reject_reason"))


def ingest_ratings(ratings: DataFrame) -> DataFrame:
    """Rating rows; anything outside 1..5 (or missing) carries a ``reject_reason``."""
    return ratings.select(
        "id", "user_id", *PLACE, F.lit("rating").alias("feedback_type"), "rating",
        F.coalesce("consent_given", F.lit(False)).alias("consent_given"), F.lit(True).alias("pii_sanitized"),
        F.when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), F.lit("rating out of range")).alias("reject_reason"), "created_at")


def ingest_flags(flags: DataFrame) -> DataFrame:
    """Flagged-response rows from (id, user_id, session_id, chat_id, model_version_id, flagged_content, reason, created_at)."""
    return flags.select(
        "id", "user_id", *PLACE, F.lit("flag_bad_response").alias("feedback_type"), "flagged_content",
        F.lit(False).alias("consent_given"), F.lit(True).alias("pii_sanitized"),
        F.to_json(F.struct("reason", iso("created_at").alias("flagged_at"))).alias("metadata_json"), "created_at")


def ingest_corrections(corrections: DataFrame) -> DataFrame:
    """Correction rows whose sanitized flag is the strict gate's verdict."""
    return corrections.select(
        "id", "user_id", *PLACE, F.lit("correction").alias("feedback_type"), "user_correction",
        F.coalesce("consent_given", F.lit(False)).alias("consent_given"),
        pii.passes_gate(F.col("user_correction")).alias("pii_sanitized"), "created_at")


def consent_requests(requests: DataFrame, retention_days: int = 365) -> DataFrame:
    """Pending consent requests as feedback rows, from (id, user_id, consent_type, purpose, created_at)."""
    return requests.select(
        "id", "user_id", F.lit("consent_request").alias("feedback_type"), F.lit(False).alias("consent_given"),
        F.to_json(F.struct("user_id", "consent_type", "purpose", F.lit(retention_days).alias("retention_period_days"),
                           iso("created_at").alias("requested_at"), F.lit("pending").alias("status"))).alias("metadata_json"),
        "created_at")


def consent_status(feedback: DataFrame, recent: int = 10) -> DataFrame:
    """Per user over the latest ``recent`` items: any consent, its latest time, the history newest first.

    The rank filter is applied before the shuffle too, so a busy user sends few rows.
    """
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "id")
    last = (feedback.select("user_id", "id", "created_at", "feedback_type", "consent_given")
            .withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= recent))
    history = F.sort_array(F.collect_list(F.struct("rn", "feedback_type", "consent_given", iso("created_at").alias("timestamp"))))
    return last.groupBy("user_id").agg(
        F.coalesce(F.bool_or("consent_given"), F.lit(False)).alias("training_consent_given"),
        F.max(F.when(F.col("consent_given"), F.col("created_at"))).alias("last_consent_check"),
        history.alias("consent_history"))


def _training(feedback: DataFrame, consent_only: bool) -> DataFrame:
    usable = feedback.filter(F.col("feedback_type").isin(*TRAINING_TYPES) & F.col("pii_sanitized"))
    if consent_only:
        usable = usable.filter("consent_given")
    return usable.withColumn("model_version", F.coalesce(F.nullif("model_version_id", F.lit("")), F.lit("unknown")))


def training_summary(feedback: DataFrame, consent_only: bool = True, min_ratings: int = 10,
                     min_corrections: int = 5) -> DataFrame:
    """Per model version with enough ratings or corrections: counts and the average rating.

    A rating of 0 and an empty correction count as missing.
    """
    rated = F.when(F.col("rating") != 0, F.col("rating"))
    return (_training(feedback, consent_only).groupBy("model_version").agg(
        F.count_if(F.coalesce("user_correction", F.lit("")) != "").alias("corrections"),
        F.count(rated).alias("ratings"), F.count(F.lit(1)).alias("total_feedback"),
        F.coalesce(F.avg(rated), F.lit(0.0)).alias("average_rating"))
        .filter((F.col("ratings") >= min_ratings) | (F.col("corrections") >= min_corrections)))


def training_corrections(feedback: DataFrame, consent_only: bool = True, min_ratings: int = 10,
                         min_corrections: int = 5) -> DataFrame:
    """The corrections of those model versions, one row each with the user hashed.

    Kept in long form: the corrections of one popular model need not fit in one task.
    """
    kept = training_summary(feedback, consent_only, min_ratings, min_corrections).select("model_version")
    rows = _training(feedback, consent_only).filter(F.coalesce("user_correction", F.lit("")) != "")
    return rows.join(kept, "model_version", "left_semi").select(
        "model_version", "id", F.col("user_correction").alias("correction"),
        pii.user_hash(F.col("user_id")).alias("user_hash"), iso("created_at").alias("timestamp"))


def privacy_report(feedback: DataFrame, retention_days: int = 365) -> DataFrame:
    """One row per user: how the user's feedback was handled."""
    training = F.col("consent_given") & F.col("feedback_type").isin(*TRAINING_TYPES)
    return feedback.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_feedback_items"), F.count_if("consent_given").alias("consent_given_count"),
        F.count_if("pii_sanitized").alias("pii_sanitized_count"), F.count_if(training).alias("data_used_for_training"),
        F.count_if(_pii_types() != F.lit("[]")).alias("pii_incidents"),
        F.lit(retention_days).cast("bigint").alias("data_retention_period_days"),
        iso_max("created_at").alias("last_activity"))


def iso_max(column: str):
    return F.date_format(F.max(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _pii_types():
    return F.get_json_object("metadata_json", "$.pii_detected")


def privacy_history(feedback: DataFrame) -> DataFrame:
    """The report's two lists in long form, in no order: consent history and, where found, the PII incident."""
    return feedback.select(
        "user_id", "id", "feedback_type", "consent_given", iso("created_at").alias("timestamp"),
        F.when(_pii_types() != F.lit("[]"), _pii_types()).alias("pii_types"),
        F.col("pii_sanitized").alias("sanitized"))


def _expired(feedback: DataFrame, as_of: datetime, retention_days: int):
    cutoff = at(feedback, "created_at", as_of - timedelta(days=retention_days))
    return F.coalesce((F.col("created_at") < cutoff) & ~F.col("consent_given"), F.lit(False))


def purge_expired(feedback: DataFrame, as_of: datetime, retention_days: int = 365) -> DataFrame:
    """The rows to keep: everything but old rows known to lack consent."""
    return feedback.filter(~_expired(feedback, as_of, retention_days))


def count_expired(feedback: DataFrame, as_of: datetime, retention_days: int = 365) -> DataFrame:
    """The number of rows that ``purge_expired`` leaves out."""
    return feedback.agg(F.count_if(_expired(feedback, as_of, retention_days)).alias("purged_count"))
