"""Model versions: listing, status changes and deployment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions.timing import at


def list_models(versions: DataFrame, model_name: str | None = None, status: str | None = None) -> DataFrame:
    """Versions newest first, optionally of one model and one status."""
    if model_name is not None:
        versions = versions.filter(F.col("model_name") == model_name)
    if status is not None:
        versions = versions.filter(F.col("status") == status)
    return versions.orderBy(F.col("created_at").desc(), "id")


def model_version(versions: DataFrame, version_id: str) -> DataFrame:
    return versions.filter(F.col("id") == version_id)


def active_model(versions: DataFrame, by_type: bool = False) -> DataFrame:
    """The production version deployed last, per model name or per (name, type).

    ``max_by`` merges on the map side, so the versions of one name need not meet in one task.
    """
    keys = ["model_name", "model_type"] if by_type else ["model_name"]
    row = F.struct("id", "version", "model_type", "deployed_at")
    best = (versions.filter(F.col("status") == "production").groupBy(*keys)
            .agg(F.max_by(row, F.struct(F.col("deployed_at"), F.col("id"))).alias("best")))
    return best.select("model_name", "best.*")


def register(rows: DataFrame) -> DataFrame:
    """New versions (id, model_name, version, model_type, metrics, created_at): status staging, artifact path by rule."""
    return rows.select(
        "id", "model_name", "version", "model_type", F.lit("staging").alias("status"),
        F.concat(F.lit("models/"), "model_name", F.lit("/"), "version", F.lit("/artifacts/")).alias("s3_path"),
        "performance_metrics", "training_metadata", "created_at")


def update_status(versions: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Snapshot with the changes (id, new_status, vetted_by) applied: production sets deployed_at, a reviewer vetted_*."""
    joined = versions.join(changes.select("id", "new_status", F.col("vetted_by").alias("reviewer")), "id", "left")
    changed, reviewer = F.col("new_status"), F.col("reviewer")
    now = {c: at(versions, c, as_of) for c in ("deployed_at", "vetted_at")}
    return joined.withColumns({
        "status": F.coalesce(changed, "status"),
        "deployed_at": F.when(changed == "production", now["deployed_at"]).otherwise(F.col("deployed_at")),
        "vetted_at": F.when(changed.isNotNull() & reviewer.isNotNull(), now["vetted_at"]).otherwise(F.col("vetted_at")),
        "vetted_by": F.when(changed.isNotNull(), F.coalesce(reviewer, "vetted_by")).otherwise(F.col("vetted_by")),
    }).select(*versions.columns)


def deploy(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Snapshot after deploy requests (model_version_id, target, requested_at) taken in time order.

    Only vetted versions deploy, so only a version's first request can count. A deployment to production
    deprecates every version of the name in production at that time, so of several the last one stays.
    Another target deploys without deprecating anything.
    """
    first = requests.groupBy(F.col("model_version_id").alias("id")).agg(
        F.min(F.struct("requested_at", "target")).alias("request"))
    joined = versions.join(first, "id", "left").withColumn(
        "deployed", F.when(F.col("status") == "vetted", F.col("request.requested_at")))
    turn = F.struct("deployed", "id")
    last = (joined.filter(F.col("deployed").isNotNull() & (F.col("request.target") == "production"))
            .groupBy("model_name").agg(F.max(turn).alias("last_turn")))
    result = joined.join(last, "model_name", "left")
    is_new, replaced = F.col("deployed").isNotNull(), F.col("last_turn").isNotNull()
    status = (F.when(is_new & replaced & (turn < F.col("last_turn")), "deprecated").when(is_new, "production")
              .when((F.col("status") == "production") & replaced, "deprecated").otherwise(F.col("status")))
    return result.withColumn("new_status", status).withColumn(
        "deployed_at", F.coalesce("deployed", "deployed_at")).withColumn(
        "status", F.col("new_status")).select(*versions.columns)
