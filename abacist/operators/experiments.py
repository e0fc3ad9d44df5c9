"""Experiments: assignment, observations, significance and closing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions.stats import md5_mod_100, pooled_t, t_p_value
from abacist.functions.timing import at

SEED = 42
MIN_PER_VARIANT, SIGNIFICANT_BELOW = 10, 0.05
OBSERVATIONS = ("observations ARRAY<STRUCT<user_id: STRING, variant: STRING, metric_value: DOUBLE, timestamp: STRING, "
                "metadata: STRING>>")


def variant_of(user_id: Column, experiment_id: Column, traffic_split: Column, seed: int = SEED) -> Column:
    """"A" for the share ``traffic_split`` of users, by a hash that never changes for a user and experiment."""
    bucket = md5_mod_100(F.concat_ws(":", user_id, experiment_id, F.lit(str(seed))))
    return F.when(bucket < traffic_split * 100, "A").otherwise("B")


def assign(pairs: DataFrame, ab_tests: DataFrame, seed: int = SEED) -> DataFrame:
    """Variant of each (user_id, experiment_id); pairs of an unknown experiment drop out."""
    known = ab_tests.select(F.col("id").alias("experiment_id"), "traffic_split")
    return pairs.join(known, "experiment_id").select(
        "user_id", "experiment_id",
        variant_of(F.col("user_id"), F.col("experiment_id"), F.col("traffic_split"), seed).alias("variant"))


def validate(ab_tests: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` where a version is missing or the two belong to different models."""
    names = versions.select("id", "model_name")
    a = names.withColumnsRenamed({"id": "model_a_version", "model_name": "name_a"})
    b = names.withColumnsRenamed({"id": "model_b_version", "model_name": "name_b"})
    joined = ab_tests.join(a, "model_a_version", "left").join(b, "model_b_version", "left")
    missing = F.col("name_a").isNull() | F.col("name_b").isNull()
    return joined.withColumn("reject_reason", F.when(missing, "invalid model version ids").when(
        F.col("name_a") != F.col("name_b"), "versions of different models")).drop("name_a", "name_b")


def active_experiments(ab_tests: DataFrame, versions: DataFrame, model_name: str | None = None) -> DataFrame:
    """Active tests with the model's name, optionally of one model."""
    names = versions.select(F.col("id").alias("model_a_version"), "model_name")
    active = ab_tests.filter(F.col("status") == "active").join(names, "model_a_version")
    return active if model_name is None else active.filter(F.col("model_name") == model_name)


def observations(ab_tests: DataFrame) -> DataFrame:
    """The nested observations of each test, one row each."""
    parsed = F.from_json("results", OBSERVATIONS).getField("observations")
    return ab_tests.select(F.col("id").alias("experiment_id"), F.inline(parsed))


def record(observed: DataFrame, ab_tests: DataFrame) -> DataFrame:
    """New observation rows to append; those of unknown experiments are ignored."""
    return observed.join(ab_tests.select(F.col("id").alias("experiment_id")), "experiment_id", "left_semi")


def summary(observed: DataFrame) -> DataFrame:
    """Per experiment both variants, even an empty one: count, sum, average; and the experiment's total.

    Both variants are counted in one aggregation and unpivoted afterwards.
    """
    def of(variant: str) -> list[Column]:
        value = F.when(F.col("variant") == variant, F.col("metric_value"))
        return [F.count(value).alias(f"{variant}_n"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{variant}_sum")]

    wide = observed.groupBy("experiment_id").agg(*of("A"), *of("B"), F.count(F.lit(1)).alias("total_observations"))
    sides = F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"{v}_n").alias("count"), F.col(f"{v}_sum").alias("sum"))
                      for v in "AB"))
    return wide.select("experiment_id", "total_observations", F.inline(sides)).withColumn(
        "average", F.coalesce(F.try_divide(F.col("sum"), F.col("count")), F.lit(0.0)))


def ttest(observed: DataFrame) -> DataFrame:
    """Per experiment: counts, means, population deviations, pooled t, p-value, winner and improvement.

    All from one mergeable aggregation. Fewer than 10 values on a side give an ``error`` and nothing else.
    """
    value = {v: F.when(F.col("variant") == v, F.col("metric_value")) for v in "AB"}
    stats = observed.groupBy("experiment_id").agg(*(
        column for v, name in (("A", "variant_a"), ("B", "variant_b")) for column in (
            F.count(value[v]).alias(f"{name}_count"), F.avg(value[v]).alias(f"{name}_mean"),
            F.stddev_pop(value[v]).alias(f"{name}_std"), F.var_samp(value[v]).alias(f"{name}_var"))))
    n1, n2, m1, m2 = (F.col(c) for c in ("variant_a_count", "variant_b_count", "variant_a_mean", "variant_b_mean"))
    enough = (n1 >= MIN_PER_VARIANT) & (n2 >= MIN_PER_VARIANT)
    tested = (stats.filter(enough)
              .withColumn("t_statistic", pooled_t(n1, m1, F.col("variant_a_var"), n2, m2, F.col("variant_b_var")))
              .withColumn("p_value", F.when(F.isnan("t_statistic"), F.lit(float("nan"))).otherwise(
                  t_p_value(F.col("t_statistic"), (n1 + n2 - 2).cast("double")))))
    significant = ~F.isnan("p_value") & (F.col("p_value") < SIGNIFICANT_BELOW)
    high, low = F.greatest(m1, m2), F.least(m1, m2)
    improvement = F.when(low == 0, F.lit(float("inf"))).otherwise(F.try_divide(high - low, low) * 100)
    tested = tested.withColumn("statistically_significant", significant).withColumn(
        "winner", F.when(~F.col("statistically_significant"), "inconclusive").when(m2 > m1, "B").otherwise("A")
    ).withColumn("improvement", F.when(F.col("statistically_significant"), improvement))
    short = stats.filter(~enough).select("experiment_id", F.lit("Insufficient data for statistical analysis").alias("error"))
    return tested.drop("variant_a_var", "variant_b_var").unionByName(short, allowMissingColumns=True)


def stop(ab_tests: DataFrame, decisions: DataFrame, as_of: datetime) -> DataFrame:
    """Tests named in ``decisions`` (id, winner_letter) completed at ``as_of``, the letter turned into its version."""
    joined = ab_tests.join(decisions.withColumn("stopped", F.lit(True)), "id", "left")
    done = F.col("stopped").isNotNull()
    winner = F.when(F.col("winner_letter") == "A", F.col("model_a_version")).when(
        F.col("winner_letter") == "B", F.col("model_b_version")).otherwise(F.col("winner"))
    return joined.withColumns({
        "status": F.when(done, "completed").otherwise(F.col("status")),
        "end_date": F.when(done, at(ab_tests, "end_date", as_of)).otherwise(F.col("end_date")),
        "winner": F.when(done, winner).otherwise(F.col("winner")),
    }).drop("stopped", "winner_letter")
