"""Review workflow of model versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions.timing import seconds_between

# What a reviewer has to look at.
CRITERIA = {
    "safety": ("No harmful content generation", "PII protection maintained", "Bias mitigation implemented",
               "Content moderation effective", "Emergency stop mechanisms present"),
    "quality": ("Response accuracy verified", "Context understanding adequate", "Educational value maintained",
                "Response coherence good", "Performance metrics acceptable"),
    "compliance": ("Data privacy regulations followed", "Training data consent verified", "Model documentation complete",
                   "Audit trail maintained", "Rollback plan documented"),
}
# Thresholds of the automated checks and the advice given when one fails.
MIN_ACCURACY, MAX_TOXICITY, MAX_LATENCY_MS = 0.8, 0.1, 5000
ADVICE = {
    "accuracy_threshold": "Model accuracy below 80% threshold",
    "consent_verified": "Training data consent not verified",
    "toxicity_check": "High toxicity score detected",
    "latency_check": "Response latency too high",
}


def _criteria() -> Column:
    return F.to_json(F.struct(*(F.array(*(F.lit(x) for x in items)).alias(k) for k, items in CRITERIA.items())))


def vetting_checks(versions: DataFrame) -> DataFrame:
    """Adds the four checks, ``checks_passed`` and ``recommendations``; a missing figure takes its default."""
    measured = F.from_json("performance_metrics", "accuracy DOUBLE, toxicity_score DOUBLE, latency_ms DOUBLE")
    trained = F.from_json("training_metadata", "consent_verified BOOLEAN")
    checks = {
        "accuracy_threshold": F.coalesce(measured.getField("accuracy"), F.lit(0.0)) >= MIN_ACCURACY,
        "consent_verified": F.coalesce(trained.getField("consent_verified"), F.lit(False)),
        "toxicity_check": F.coalesce(measured.getField("toxicity_score"), F.lit(1.0)) <= MAX_TOXICITY,
        "latency_check": F.coalesce(measured.getField("latency_ms"), F.lit(0.0)) <= MAX_LATENCY_MS,
    }
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    advice = F.array(*(F.when(~F.col(name), F.lit(text)) for name, text in ADVICE.items()))
    return versions.withColumns(checks).withColumns(
        {"checks_passed": passed, "recommendations": F.filter(advice, lambda a: a.isNotNull())})


def submit(submissions: DataFrame, versions: DataFrame) -> DataFrame:
    """Review rows for submissions (model_version_id, reviewer_id); only staging versions are eligible."""
    status = versions.select(F.col("id").alias("model_version_id"), "status")
    joined = submissions.join(status, "model_version_id", "left")
    ok = F.coalesce(F.col("status") == "staging", F.lit(False))
    return joined.select(
        "model_version_id", "reviewer_id", F.lit("pending").alias("status"), F.when(ok, _criteria()).alias("review_criteria"),
        F.when(~ok, "not eligible for review").alias("reject_reason"))


def judge(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Decisions (review_id, decision, reviewer_id, ...) beside their review's version, with a ``reject_reason``.

    ``reviews`` has one row per id, as the table's key says; the join relies on it.
    """
    owner = reviews.select(F.col("id").alias("review_id"), "model_version_id", F.col("reviewer_id").alias("owner"))
    return decisions.join(owner, "review_id", "left").withColumn(
        "reject_reason", F.when(F.col("owner").isNull(), "unknown review")
        .when(F.col("owner") != F.col("reviewer_id"), "unauthorized reviewer")
        .when(~F.col("decision").isin("approved", "rejected"), "invalid decision")).drop("owner")


def apply_to_reviews(reviews: DataFrame, judged: DataFrame) -> DataFrame:
    """Reviews with the accepted decisions written in; of several for one review the last counts."""
    made = F.struct("decided_at", "decision", "safety_score", "quality_score", "comments")
    last = (judged.filter(F.col("reject_reason").isNull()).groupBy(F.col("review_id").alias("id"))
            .agg(F.max(made).alias("made")))
    joined = reviews.join(last, "id", "left")
    done = F.col("made").isNotNull()

    def pick(column: str, source: str) -> Column:
        return F.when(done, F.col(f"made.{source}")).otherwise(F.col(column))

    return joined.withColumns({
        "status": pick("status", "decision"), "safety_score": pick("safety_score", "safety_score"),
        "quality_score": pick("quality_score", "quality_score"), "comments": pick("comments", "comments"),
        "reviewed_at": pick("reviewed_at", "decided_at")}).drop("made")


def apply_to_versions(versions: DataFrame, judged: DataFrame) -> DataFrame:
    """Versions moved to vetted (with reviewer and time) or rejected; the last accepted decision counts."""
    last = (judged.filter(F.col("reject_reason").isNull()).groupBy(F.col("model_version_id").alias("id")).agg(
        F.max(F.struct("decided_at", "review_id", "decision", "reviewer_id")).alias("made"),
        F.max(F.when(F.col("decision") == "approved", F.struct("decided_at", "review_id", "reviewer_id"))).alias("vetted")))
    joined = versions.join(last, "id", "left")
    decision = F.col("made.decision")
    return joined.withColumns({
        "status": F.when(decision == "approved", "vetted").when(decision == "rejected", "rejected").otherwise(F.col("status")),
        "vetted_by": F.coalesce("vetted.reviewer_id", "vetted_by"),
        "vetted_at": F.coalesce("vetted.decided_at", "vetted_at")}).select(*versions.columns)


def pending_reviews(reviews: DataFrame, versions: DataFrame, reviewer_id: str | None = None) -> DataFrame:
    """Pending reviews with their version; one reviewer's come newest version first, those of all in no order."""
    pending = reviews.filter(F.col("status") == "pending")
    if reviewer_id is not None:
        pending = pending.filter(F.col("reviewer_id") == reviewer_id)
    about = versions.select(F.col("id").alias("model_version_id"), "model_name", "version",
                            F.col("created_at").alias("version_created_at"))
    found = pending.join(about, "model_version_id")
    return found if reviewer_id is None else found.orderBy(F.col("version_created_at").desc(), "id")


def review_details(reviews: DataFrame, versions: DataFrame) -> DataFrame:
    """Reviews (with their criteria, where the row has none the ones every review is given) with their version's data and
    automated checks.

    The checks run once per version, before the join, not once per review.
    """
    kept = F.col("review_criteria") if "review_criteria" in reviews.columns else F.lit(None).cast("string")
    reviews = reviews.withColumn("review_criteria", F.coalesce(kept, _criteria()))
    about = vetting_checks(versions).select(
        F.col("id").alias("model_version_id"), F.col("model_name").alias("name"), "version", F.col("model_type").alias("type"),
        "performance_metrics", "training_metadata", *ADVICE, "checks_passed", "recommendations")
    return reviews.join(about, "model_version_id")


def review_history(reviews: DataFrame, model_version_id: str | None = None, reviewer_id: str | None = None) -> DataFrame:
    """Reviews of one version or one reviewer, newest first; without either, all of them in no order."""
    if model_version_id is not None:
        reviews = reviews.filter(F.col("model_version_id") == model_version_id)
    if reviewer_id is not None:
        reviews = reviews.filter(F.col("reviewer_id") == reviewer_id)
    if model_version_id is None and reviewer_id is None:
        return reviews
    return reviews.orderBy(F.col("created_at").desc(), "id")


def escalate(reviews: DataFrame, escalations: DataFrame) -> DataFrame:
    """Reviews with the reason appended to their comments where an escalation (id, reason) names them."""
    joined = reviews.join(escalations, "id", "left")
    text = F.concat(F.coalesce("comments", F.lit("")), F.lit("\n\n[ESCALATED] "), "reason")
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    return joined.withColumn("comments", F.when(F.col("reason").isNotNull(), stripped).otherwise(F.col("comments"))).drop("reason")


def review_stats(reviews: DataFrame) -> DataFrame:
    """Counts by status, approval rate and average hours; the average divides by all completed reviews."""
    total, approved = F.count(F.lit(1)), F.count_if(F.col("status") == "approved")
    completed = F.col("status").isin("approved", "rejected")
    seconds = F.sum(F.when(completed & F.col("reviewed_at").isNotNull(), seconds_between("reviewed_at", "created_at")))
    return reviews.agg(
        total.alias("total_reviews"), F.count_if(F.col("status") == "pending").alias("pending_reviews"),
        approved.alias("approved_reviews"), F.count_if(F.col("status") == "rejected").alias("rejected_reviews"),
        (approved / F.greatest(total, F.lit(1))).alias("approval_rate"),
        F.coalesce(F.try_divide(seconds, F.count_if(completed) * 3600), F.lit(0.0)).alias("average_review_time_hours"))
