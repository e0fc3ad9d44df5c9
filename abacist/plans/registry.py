"""Queries on model versions, reviews and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions.timing import iso
from abacist.operators import experiments, registry, reviews
from abacist.plans.views import AS_OF, appended, view, with_views


def _list_models(spark, d):
    rows = registry.list_models(view(spark, d, "model_versions"))
    return rows.select("id", "model_name", "version", "model_type", "status", "performance_metrics", "training_metadata",
                       iso("created_at").alias("created_at"))


def _list_models_of_status(spark, d):
    rows = registry.list_models(view(spark, d, "model_versions"), "Brand#7", "production")
    return rows.select("id", "model_name", "status", iso("created_at").alias("created_at"))


def _active_model(spark, d):
    return registry.active_model(view(spark, d, "model_versions")).withColumn("deployed_at", iso("deployed_at"))


def _active_model_by_type(spark, d):
    return registry.active_model(view(spark, d, "model_versions"), by_type=True).withColumn("deployed_at", iso("deployed_at"))


def _register_version(spark, d):
    return registry.register(view(spark, d, "model_versions")).withColumn("created_at", iso("created_at"))


def _status_update(spark, d):
    versions = view(spark, d, "model_versions")
    changes = versions.filter(F.col("status").isin("staging", "vetted")).select(
        "id", F.when(F.col("status") == "staging", "deprecated").otherwise("production").alias("new_status"),
        F.when(F.col("model_type") == "ECONOMY", "admin").alias("vetted_by"))
    out = registry.update_status(versions, changes, AS_OF)
    return out.select("id", "status", "vetted_by", iso("vetted_at").alias("vetted_at"), iso("deployed_at").alias("deployed_at"))


def _deploy_promote(spark, d):
    out = registry.deploy(view(spark, d, "model_versions"), view(spark, d, "deploy_requests"))
    return out.select("id", "model_name", "status", iso("deployed_at").alias("deployed_at"))


def _vetting_checks(spark, d):
    out = reviews.vetting_checks(view(spark, d, "model_versions"))
    return out.select("id", *reviews.ADVICE, "checks_passed", F.array_join("recommendations", ";").alias("recommendations"))


def _review_eligibility(spark, d):
    out = reviews.submit(view(spark, d, "review_submissions"), view(spark, d, "model_versions"))
    return out.select("model_version_id", "reviewer_id", "status", "review_criteria", "reject_reason")


def _judged(spark, d):
    return reviews.judge(view(spark, d, "review_decisions"), view(spark, d, "human_reviews"))


def _review_decision(spark, d):
    return _judged(spark, d).select("review_id", "model_version_id", "decision", "reviewer_id", "reject_reason")


def _review_decision_reviews(spark, d):
    out = reviews.apply_to_reviews(view(spark, d, "human_reviews"), _judged(spark, d))
    return out.select("id", "status", "safety_score", "quality_score", "comments", iso("reviewed_at").alias("reviewed_at"))


def _review_decision_versions(spark, d):
    out = reviews.apply_to_versions(view(spark, d, "model_versions"), _judged(spark, d))
    return out.select("id", "status", "vetted_by", iso("vetted_at").alias("vetted_at"))


def _pending_reviews(spark, d):
    out = reviews.pending_reviews(view(spark, d, "human_reviews"), view(spark, d, "model_versions"))
    return out.select("id", "model_version_id", "reviewer_id", "model_name", "version",
                      iso("version_created_at").alias("version_created_at"))


def _review_details(spark, d):
    out = reviews.review_details(view(spark, d, "human_reviews"), view(spark, d, "model_versions"))
    return out.select("id", "model_version_id", "name", "version", "type", "performance_metrics", "training_metadata",
                      "reviewer_id", "status", "review_criteria", "safety_score", "quality_score", "comments", *reviews.ADVICE, "checks_passed",
                      F.array_join("recommendations", ";").alias("recommendations"),
                      iso("created_at").alias("created_at"), iso("reviewed_at").alias("reviewed_at"))


def _review_history(spark, d):
    out = reviews.review_history(view(spark, d, "human_reviews"))
    return out.select("id", "model_version_id", "reviewer_id", "status", iso("created_at").alias("created_at"))


def _review_escalate(spark, d):
    rows = view(spark, d, "human_reviews").select("id", "reviewer_id", "status", "comments")
    escalations = rows.filter(F.col("status") == "pending").select("id", F.concat(F.lit("late by "), "reviewer_id", F.lit(" \n")).alias("reason"))
    return reviews.escalate(rows, escalations).select("id", "status", "comments")


def _review_stats(spark, d):
    out = reviews.review_stats(view(spark, d, "human_reviews"))
    return out.withColumns({c: F.round(c, 6) for c in ("approval_rate", "average_review_time_hours")})


def _experiment_validate(spark, d):
    out = experiments.validate(view(spark, d, "ab_tests"), view(spark, d, "model_versions"))
    return out.select("id", "name", "model_a_version", "model_b_version", "reject_reason")


def _active_experiments(spark, d):
    out = experiments.active_experiments(view(spark, d, "ab_tests"), view(spark, d, "model_versions"))
    return out.select("id", "name", "model_a_version", "model_name")


def _ab_assign(spark, d):
    return experiments.assign(view(spark, d, "ab_assignments"), view(spark, d, "ab_tests"))


def _nested_tests(spark, d):
    """Tests whose results column nests observations, as the service stores them: here two, one the other's mirror."""
    def item(sign):
        return F.struct("user_id", "variant", (F.col("metric_value") * sign).alias("metric_value"),
                        iso("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("metadata"))

    seen = view(spark, d, "ab_observations")
    return seen.select(F.col("experiment_id").alias("id"), F.to_json(F.struct(F.array(item(1), item(-1)).alias("observations"))).alias("results"))


def _ab_observations(spark, d):
    return experiments.observations(_nested_tests(spark, d)).select("experiment_id", "user_id", "variant", "metric_value", "timestamp")


def _ab_record(spark, d):
    """Observations arrive, some of experiments that there are not; the others are appended and read back."""
    seen = view(spark, d, "ab_observations")
    arriving = seen.withColumn("experiment_id", F.when(F.col("user_id").endswith("9"), "unknown").otherwise(F.col("experiment_id")))
    tests = seen.select(F.col("experiment_id").alias("id")).distinct()
    return appended(experiments.record(arriving, tests), "observations").withColumn("timestamp", iso("timestamp"))


def _ab_summary(spark, d):
    out = experiments.summary(view(spark, d, "ab_observations"))
    return out.withColumns({c: F.round(c, 6) for c in ("sum", "average")})


def _ab_ttest(spark, d):
    out = experiments.ttest(view(spark, d, "ab_observations"))
    rounded = ("variant_a_mean", "variant_b_mean", "variant_a_std", "variant_b_std", "t_statistic", "p_value", "improvement")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


def _ab_stop(spark, d):
    tests = view(spark, d, "ab_tests")
    decisions = tests.filter(F.col("status") == "active").select(
        "id", F.when(F.col("traffic_split") < 0.35, "A").when(F.col("traffic_split") > 0.65, "B").alias("winner_letter"))
    out = experiments.stop(tests, decisions, AS_OF)
    return out.select("id", "status", "winner", iso("end_date").alias("end_date"))


QUERIES = {
    "list_models": _list_models,
    "list_models_filtered": _list_models_of_status,
    "active_model": _active_model,
    "active_model_by_type": _active_model_by_type,
    "register_version": _register_version,
    "status_update": _status_update,
    "deploy_promote": _deploy_promote,
    "vetting_checks": _vetting_checks,
    "review_eligibility": _review_eligibility,
    "review_decision": _review_decision,
    "review_decision_reviews": _review_decision_reviews,
    "review_decision_versions": _review_decision_versions,
    "pending_reviews": _pending_reviews,
    "review_details": _review_details,
    "review_history": _review_history,
    "review_escalate": _review_escalate,
    "review_stats": _review_stats,
    "experiment_validate": _experiment_validate,
    "active_experiments": _active_experiments,
    "ab_assign": _ab_assign,
    "ab_observations": _ab_observations,
    "ab_observations_record": _ab_record,
    "ab_summary": _ab_summary,
    "ab_ttest": _ab_ttest,
    "ab_stop": _ab_stop,
}

_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"
_NUMBER = "CAST(json_extract_string(performance_metrics, '$.{0}') AS DOUBLE)"
_CHECKS = f""", checked AS (
    SELECT *, coalesce({_NUMBER.format('accuracy')}, 0) >= 0.8 AS accuracy_threshold,
           coalesce(json_extract_string(training_metadata, '$.consent_verified') = 'true', false) AS consent_verified,
           coalesce({_NUMBER.format('toxicity_score')}, 1) <= 0.1 AS toxicity_check,
           coalesce({_NUMBER.format('latency_ms')}, 0) <= 5000 AS latency_check FROM model_versions),
  vetted AS (SELECT *, accuracy_threshold AND consent_verified AND toxicity_check AND latency_check AS checks_passed,
           concat_ws(';', CASE WHEN NOT accuracy_threshold THEN 'Model accuracy below 80% threshold' END,
                     CASE WHEN NOT consent_verified THEN 'Training data consent not verified' END,
                     CASE WHEN NOT toxicity_check THEN 'High toxicity score detected' END,
                     CASE WHEN NOT latency_check THEN 'Response latency too high' END) AS recommendations FROM checked) """
_JUDGED = """, owners AS (SELECT DISTINCT id AS review_id, model_version_id, reviewer_id AS owner FROM human_reviews),
  judged AS (SELECT d.*, model_version_id,
               CASE WHEN owner IS NULL THEN 'unknown review' WHEN owner <> d.reviewer_id THEN 'unauthorized reviewer'
                    WHEN decision NOT IN ('approved', 'rejected') THEN 'invalid decision' END AS reject_reason
             FROM review_decisions d LEFT JOIN owners USING (review_id)) """
_CRITERIA = "{" + ",".join(
    f'"{k}":[' + ",".join(f'"{x}"' for x in items) + "]" for k, items in reviews.CRITERIA.items()) + "}"
_STATS = """, s AS (
    SELECT experiment_id, count(*) FILTER (variant = 'A') AS n1, count(*) FILTER (variant = 'B') AS n2,
           avg(metric_value) FILTER (variant = 'A') AS m1, avg(metric_value) FILTER (variant = 'B') AS m2,
           stddev_pop(metric_value) FILTER (variant = 'A') AS s1, stddev_pop(metric_value) FILTER (variant = 'B') AS s2
    FROM ab_observations GROUP BY 1),
  t AS (SELECT *, n1 + n2 - 2 AS df, (m1 - m2) / sqrt((n1 * s1 * s1 + n2 * s2 * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t
        FROM s WHERE n1 >= 10 AND n2 >= 10),
  -- Simpson's rule over the density of Student's t between 0 and |t|
  area AS (SELECT experiment_id,
             sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                 * power(1 + power(abs(t) * i / 2000, 2) / df, -(df + 1) / 2)) * abs(any_value(t)) / 2000 / 3
               * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(any_value(df) * pi()) AS half
           FROM t, range(2001) r(i) GROUP BY experiment_id, t),
  p AS (SELECT t.*, 1 - 2 * half AS p FROM t JOIN area USING (experiment_id)) """

ORACLES = {
    "list_models": with_views("model_versions", f"""
        SELECT id, model_name, version, model_type, status, performance_metrics, training_metadata,
               {_AT.format('created_at')} AS created_at FROM model_versions"""),
    "list_models_filtered": with_views("model_versions", f"""
        SELECT id, model_name, status, {_AT.format('created_at')} AS created_at FROM model_versions
        WHERE model_name = 'Brand#7' AND status = 'production'"""),
    "active_model": with_views("model_versions", f"""
        SELECT model_name, id, version, model_type, {_AT.format('deployed_at')} AS deployed_at FROM model_versions
        WHERE status = 'production' QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY deployed_at DESC, id DESC) = 1"""),
    "active_model_by_type": with_views("model_versions", f"""
        SELECT model_name, id, version, model_type, {_AT.format('deployed_at')} AS deployed_at FROM model_versions
        WHERE status = 'production'
        QUALIFY row_number() OVER (PARTITION BY model_name, model_type ORDER BY deployed_at DESC, id DESC) = 1"""),
    "register_version": with_views("model_versions", f"""
        SELECT id, model_name, version, model_type, 'staging' AS status,
               'models/' || model_name || '/' || version || '/artifacts/' AS s3_path, performance_metrics, training_metadata,
               {_AT.format('created_at')} AS created_at FROM model_versions"""),
    "status_update": with_views("model_versions", f"""
        SELECT id, CASE status WHEN 'staging' THEN 'deprecated' WHEN 'vetted' THEN 'production' ELSE status END AS status,
               CASE WHEN status IN ('staging', 'vetted') AND model_type = 'ECONOMY' THEN 'admin' END AS vetted_by,
               CASE WHEN status IN ('staging', 'vetted') AND model_type = 'ECONOMY' THEN '2024-01-31T00:00:00.000000' END AS vetted_at,
               CASE WHEN status = 'vetted' THEN '2024-01-31T00:00:00.000000' ELSE {_AT.format('deployed_at')} END AS deployed_at
        FROM model_versions"""),
    "deploy_promote": with_views("model_versions deploy_requests", f"""
        , e AS (SELECT v.id, v.model_name, target, requested_at FROM model_versions v JOIN deploy_requests r ON v.id = r.model_version_id
                WHERE status = 'vetted'),
        p AS (SELECT model_name, max(requested_at) AS last_at FROM e WHERE target = 'production' GROUP BY 1),
        w AS (SELECT model_name, max(id) AS last_id FROM e JOIN p USING (model_name)
              WHERE target = 'production' AND requested_at = last_at GROUP BY 1)
        SELECT v.id, v.model_name,
               CASE WHEN e.id IS NOT NULL AND (e.requested_at < p.last_at OR (e.requested_at = p.last_at AND e.id < w.last_id)) THEN 'deprecated'
                    WHEN e.id IS NOT NULL THEN 'production'
                    WHEN v.status = 'production' AND p.model_name IS NOT NULL THEN 'deprecated' ELSE v.status END AS status,
               {_AT.format('coalesce(e.requested_at, v.deployed_at)')} AS deployed_at
        FROM model_versions v LEFT JOIN e ON e.id = v.id LEFT JOIN p ON p.model_name = v.model_name
        LEFT JOIN w ON w.model_name = v.model_name"""),
    "vetting_checks": with_views("model_versions", _CHECKS + """
        SELECT id, accuracy_threshold, consent_verified, toxicity_check, latency_check, checks_passed, recommendations FROM vetted"""),
    "review_eligibility": with_views("review_submissions model_versions", f"""
        SELECT model_version_id, reviewer_id, 'pending' AS status,
               CASE WHEN v.status = 'staging' THEN '{_CRITERIA}' END AS review_criteria,
               CASE WHEN v.status = 'staging' THEN NULL ELSE 'not eligible for review' END AS reject_reason
        FROM review_submissions s LEFT JOIN model_versions v ON v.id = s.model_version_id"""),
    "review_decision": with_views("review_decisions human_reviews", _JUDGED + """
        SELECT review_id, model_version_id, decision, reviewer_id, reject_reason FROM judged"""),
    "review_decision_reviews": with_views("review_decisions human_reviews", _JUDGED + f"""
        SELECT id, coalesce(j.decision, h.status) AS status,
               CASE WHEN j.review_id IS NULL THEN h.safety_score ELSE j.safety_score END AS safety_score,
               CASE WHEN j.review_id IS NULL THEN h.quality_score ELSE j.quality_score END AS quality_score,
               CASE WHEN j.review_id IS NULL THEN h.comments ELSE j.comments END AS comments,
               {_AT.format('coalesce(j.decided_at, h.reviewed_at)')} AS reviewed_at
        FROM human_reviews h LEFT JOIN (SELECT * FROM judged WHERE reject_reason IS NULL
          QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY decided_at DESC, decision DESC) = 1) j ON j.review_id = h.id"""),
    "review_decision_versions": with_views("review_decisions human_reviews model_versions", _JUDGED + f"""
        , accepted AS (SELECT * FROM judged WHERE reject_reason IS NULL),
        l AS (SELECT model_version_id, decision FROM accepted
              QUALIFY row_number() OVER (PARTITION BY model_version_id ORDER BY decided_at DESC, review_id DESC) = 1),
        a AS (SELECT model_version_id, reviewer_id, decided_at FROM accepted WHERE decision = 'approved'
              QUALIFY row_number() OVER (PARTITION BY model_version_id ORDER BY decided_at DESC, review_id DESC) = 1)
        SELECT id, CASE l.decision WHEN 'approved' THEN 'vetted' WHEN 'rejected' THEN 'rejected' ELSE status END AS status,
               a.reviewer_id AS vetted_by, {_AT.format('a.decided_at')} AS vetted_at
        FROM model_versions v LEFT JOIN l ON l.model_version_id = v.id LEFT JOIN a ON a.model_version_id = v.id"""),
    "pending_reviews": with_views("human_reviews model_versions", f"""
        SELECT h.id, model_version_id, reviewer_id, model_name, version, {_AT.format('v.created_at')} AS version_created_at
        FROM human_reviews h JOIN model_versions v ON v.id = h.model_version_id WHERE h.status = 'pending'"""),
    "review_details": with_views("human_reviews model_versions", _CHECKS + f"""
        SELECT h.id, model_version_id, model_name AS name, version, model_type AS type, performance_metrics, training_metadata,
               reviewer_id, h.status, '{_CRITERIA}' AS review_criteria, safety_score, quality_score, comments, accuracy_threshold, consent_verified, toxicity_check, latency_check,
               checks_passed, recommendations, {_AT.format('h.created_at')} AS created_at, {_AT.format('reviewed_at')} AS reviewed_at
        FROM human_reviews h JOIN vetted v ON v.id = h.model_version_id"""),
    "review_history": with_views("human_reviews", f"""
        SELECT id, model_version_id, reviewer_id, status, {_AT.format('created_at')} AS created_at FROM human_reviews"""),
    "review_escalate": with_views("human_reviews", """
        SELECT id, status, CASE WHEN status = 'pending'
               THEN trim(coalesce(comments, '') || chr(10) || chr(10) || '[ESCALATED] late by ' || reviewer_id, ' ' || chr(10))
               ELSE comments END AS comments FROM human_reviews"""),
    "review_stats": with_views("human_reviews", """
        SELECT count(*) AS total_reviews, count(*) FILTER (status = 'pending') AS pending_reviews,
               count(*) FILTER (status = 'approved') AS approved_reviews, count(*) FILTER (status = 'rejected') AS rejected_reviews,
               round(count(*) FILTER (status = 'approved') / greatest(count(*), 1), 6) AS approval_rate,
               round(sum((epoch_us(reviewed_at) - epoch_us(created_at)) / 1000000.0) FILTER (status IN ('approved', 'rejected'))
                     / count(*) FILTER (status IN ('approved', 'rejected')) / 3600, 6) AS average_review_time_hours
        FROM human_reviews"""),
    "experiment_validate": with_views("ab_tests model_versions", """
        SELECT t.id, t.name, model_a_version, model_b_version,
               CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'invalid model version ids'
                    WHEN a.model_name <> b.model_name THEN 'versions of different models' END AS reject_reason
        FROM ab_tests t LEFT JOIN model_versions a ON a.id = model_a_version LEFT JOIN model_versions b ON b.id = model_b_version"""),
    "active_experiments": with_views("ab_tests model_versions", """
        SELECT t.id, t.name, model_a_version, model_name FROM ab_tests t JOIN model_versions v ON v.id = model_a_version
        WHERE t.status = 'active'"""),
    "ab_assign": with_views("ab_assignments ab_tests", """
        , h AS (SELECT user_id, experiment_id, traffic_split, md5(user_id || ':' || experiment_id || ':42') AS d
                FROM ab_assignments JOIN ab_tests t ON t.id = experiment_id),
        digits AS (SELECT user_id, experiment_id, traffic_split,
                     list_reduce(list_transform(string_split(d, ''), lambda c: strpos('0123456789abcdef', c) - 1),
                                 lambda acc, x: (acc * 16 + x) % 100) AS bucket FROM h)
        SELECT user_id, experiment_id, CASE WHEN bucket < traffic_split * 100 THEN 'A' ELSE 'B' END AS variant FROM digits"""),
    "ab_observations": with_views("ab_observations", f"""
        SELECT experiment_id, user_id, variant, metric_value * s AS metric_value, {_AT.format('timestamp')} AS timestamp
        FROM ab_observations, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) x(s)"""),
    "ab_observations_record": with_views("ab_observations", f"""
        SELECT experiment_id, user_id, variant, metric_value, {_AT.format('timestamp')} AS timestamp
        FROM ab_observations WHERE user_id NOT LIKE '%9'"""),
    "ab_summary": with_views("ab_observations", """
        , e AS (SELECT experiment_id, count(*) AS total_observations FROM ab_observations GROUP BY 1),
        v AS (SELECT experiment_id, variant, count(*) AS n, sum(metric_value) AS s FROM ab_observations GROUP BY 1, 2)
        SELECT e.experiment_id, total_observations, x.variant, coalesce(n, 0) AS count, round(coalesce(s, 0), 6) AS sum,
               round(coalesce(s / n, 0), 6) AS average
        FROM e CROSS JOIN (VALUES ('A'), ('B')) x(variant)
        LEFT JOIN v ON v.experiment_id = e.experiment_id AND v.variant = x.variant"""),
    "ab_ttest": with_views("ab_observations", _STATS + """
        SELECT experiment_id, n1 AS variant_a_count, n2 AS variant_b_count, round(m1, 6) AS variant_a_mean,
               round(m2, 6) AS variant_b_mean, round(s1, 6) AS variant_a_std, round(s2, 6) AS variant_b_std,
               round(t, 6) AS t_statistic, round(p, 6) AS p_value, p < 0.05 AS statistically_significant,
               CASE WHEN p >= 0.05 THEN 'inconclusive' WHEN m2 > m1 THEN 'B' ELSE 'A' END AS winner,
               round(CASE WHEN p < 0.05 THEN (greatest(m1, m2) - least(m1, m2)) / least(m1, m2) * 100 END, 6) AS improvement,
               CAST(NULL AS VARCHAR) AS error FROM p
        UNION ALL
        SELECT experiment_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
               'Insufficient data for statistical analysis' FROM s WHERE n1 < 10 OR n2 < 10"""),
    "ab_stop": with_views("ab_tests", """
        SELECT id, CASE WHEN status = 'active' THEN 'completed' ELSE status END AS status,
               CASE WHEN status = 'active' AND traffic_split < 0.35 THEN model_a_version
                    WHEN status = 'active' AND traffic_split > 0.65 THEN model_b_version END AS winner,
               CASE WHEN status = 'active' THEN '2024-01-31T00:00:00.000000' END AS end_date FROM ab_tests"""),
}
