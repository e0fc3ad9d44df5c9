"""Queries on feedback, consent and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions import pii
from abacist.functions.timing import iso
from abacist.operators import feedback as op
from abacist.plans.views import AS_OF_ORDERS, appended, view, with_views
from abacist.sources.tables import spread


def _joined(column):
    return F.array_join(column, ",")


def _pii_detect(spark, d):
    return op.detect(spread(view(spark, d, "pii_text")), "text").select(
        "id", _joined("pii_types").alias("pii_types"), "fully_sanitized")


def _pii_redact(spark, d):
    return op.redact(spread(view(spark, d, "pii_text")), "text").select(
        "id", "sanitized_text", _joined("pii_types").alias("pii_types"), "fully_sanitized")


def _pii_gate(spark, d):
    return spread(view(spark, d, "pii_text")).select("id", pii.passes_gate(F.col("text")).alias("clean"))


def _anonymize(spark, d):
    return op.anonymize(spread(view(spark, d, "pii_text")).select("id", "user_id", "email", "ip_address"))


def _placed(rows):
    """Rows with the session, chat, model and time that an item comes with."""
    n = F.col("id").cast("bigint")
    return rows.withColumns({
        "session_id": F.concat(F.lit("s"), n % 40), "chat_id": F.when(n % 7 != 0, F.concat(F.lit("c"), n % 90)),
        "model_version_id": F.when(n % 11 != 0, F.concat(F.lit("m"), n % 4)),
        "created_at": F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=n.cast("int"))})


def _feedback_ingest(spark, d):
    text = _placed(spread(view(spark, d, "pii_text")))
    sent = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (
        ("page", "type"), ("user_id", "user_id"), ("email", "email"), ("ip_address", "ip_address"))]), lambda e: e["v"].isNotNull()))
    submissions = text.select(
        "id", "user_id", "type", "consent_given", "rating", *op.PLACE,
        F.when(F.col("id").cast("bigint") % 3 != 0, sent).alias("metadata"),
        F.when(F.col("type").isin("correction", "training_suggestion"), F.col("text")).alias("correction"),
        F.when(F.col("type") == "flag_bad_response", F.col("text")).alias("flagged_content"),
        "created_at")
    return op.ingest(submissions).select(
        "id", "user_id", *op.PLACE, "feedback_type", "rating", "consent_given", "user_correction", "pii_sanitized",
        _joined("pii_types").alias("pii_types"), "metadata_json", "reject_reason", iso("created_at").alias("created_at"))


def _rating_ingest(spark, d):
    return op.ingest_ratings(_placed(spread(view(spark, d, "pii_text")))).withColumn("created_at", iso("created_at"))


def _flag_ingest(spark, d):
    flags = view(spark, d, "chat_messages").select(
        "id", "user_id", F.split("id", "-")[0].alias("session_id"), F.col("id").alias("chat_id"),
        F.concat(F.lit("m"), F.col("user_age") % 4).alias("model_version_id"), F.col("message").alias("flagged_content"),
        F.when(F.col("user_age") > 18, "wrong").otherwise("unclear").alias("reason"), "created_at")
    return op.ingest_flags(flags).withColumn("created_at", iso("created_at"))


def _correction_ingest(spark, d):
    rows = _placed(spread(view(spark, d, "pii_text"))).withColumnRenamed("text", "user_correction")
    return op.ingest_corrections(rows).withColumn("created_at", iso("created_at"))


def _consent_requests(spark, d):
    rows = view(spark, d, "support_tickets").select(
        "id", "user_id", F.col("category").alias("consent_type"), F.lit("model_training").alias("purpose"), "created_at")
    return appended(op.consent_requests(rows), "consent").withColumn("created_at", iso("created_at"))


def _consent_status(spark, d):
    rows = op.consent_status(view(spark, d, "user_feedback"))
    items = F.transform("consent_history", lambda h: F.concat_ws("|", h.feedback_type, h.consent_given.cast("string"), h.timestamp))
    return rows.select("user_id", "training_consent_given", iso("last_consent_check").alias("last_consent_check"),
                       F.array_join(items, ";").alias("consent_history"))


def _feedback_training_agg(spark, d):
    return op.training_summary(view(spark, d, "user_feedback")).withColumn("average_rating", F.round("average_rating", 6))


def _feedback_training_corrections(spark, d):
    return op.training_corrections(view(spark, d, "user_feedback"))


def _privacy_report(spark, d):
    return op.privacy_report(view(spark, d, "user_feedback"))


def _privacy_history(spark, d):
    return op.privacy_history(view(spark, d, "user_feedback"))


def _job_purge_feedback(spark, d):
    kept = op.purge_expired(view(spark, d, "user_feedback"), AS_OF_ORDERS)
    return kept.select("id", "user_id", "feedback_type", "consent_given", iso("created_at").alias("created_at"))


QUERIES = {
    "pii_detect": _pii_detect,
    "pii_redact": _pii_redact,
    "pii_gate": _pii_gate,
    "anonymize": _anonymize,
    "feedback_ingest": _feedback_ingest,
    "rating_ingest": _rating_ingest,
    "flag_ingest": _flag_ingest,
    "correction_ingest": _correction_ingest,
    "sink_append_consent_requests": _consent_requests,
    "consent_status": _consent_status,
    "feedback_training_agg": _feedback_training_agg,
    "feedback_training_corrections": _feedback_training_corrections,
    "privacy_report": _privacy_report,
    "privacy_history": _privacy_history,
    "job_purge_feedback": _job_purge_feedback,
    "job_purge_feedback_count": lambda spark, d: op.count_expired(view(spark, d, "user_feedback"), AS_OF_ORDERS),
}

_TS = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"
_CREATED = _TS.format("created_at")
_PLACE = """'s' || CAST(CAST(id AS BIGINT) % 40 AS VARCHAR) AS session_id,
               CASE WHEN CAST(id AS BIGINT) % 7 <> 0 THEN 'c' || CAST(CAST(id AS BIGINT) % 90 AS VARCHAR) END AS chat_id,
               CASE WHEN CAST(id AS BIGINT) % 11 <> 0 THEN 'm' || CAST(CAST(id AS BIGINT) % 4 AS VARCHAR) END AS model_version_id"""
_PLACED_AT = _TS.format("TIMESTAMP '2024-01-01' + to_minutes(CAST(id AS BIGINT))") + " AS created_at"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# The same patterns for an engine whose \\b, \\w and \\s know ASCII only: the neighbours of a match are spelt out.
_W, _S = r"[\pL\pN_]", r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_FROM, _TO = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
_SPELT = {
    "email": rf"(?:{_FROM}[A-Za-z0-9_][A-Za-z0-9._%+-]*|{_W}[.%+-][A-Za-z0-9._%+-]*)@[A-Za-z0-9.-]+"
             rf"\.(?:[A-Za-z|]+[A-Za-z]{_TO}|[A-Za-z|]+\|{_W})",
    "phone": rf"{_FROM}\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}{_TO}",
    "ssn": rf"{_FROM}\d{{3}}-\d{{2}}-\d{{4}}{_TO}",
    "credit_card": rf"{_FROM}\d{{4}}(?:-|{_S})?\d{{4}}(?:-|{_S})?\d{{4}}(?:-|{_S})?\d{{4}}{_TO}",
    "ip_address": rf"{_FROM}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{_TO}",
    "address": rf"{_FROM}\d+{_S}+(?:(?:[A-Za-z0-9,.-]|{_S})*[A-Za-z0-9]{_TO}|(?:[A-Za-z0-9,.-]|{_S})*(?:[,.-]|{_S}){_W})",
    "name": rf"{_FROM}[A-Za-z]{{2,}}{_S}+[A-Za-z]{{2,}}{_TO}",
}


def _sql_detect(text: str) -> str:
    flags = ", ".join(f"CASE WHEN regexp_matches({text}, {_sql_text(p)}) THEN '{k}' END" for k, p in _SPELT.items())
    return f"concat_ws(',', {flags})"


# Redaction in that engine: every non-ASCII letter or digit is wrapped in "_" while the ASCII patterns run, so that
# "\\b" sees a word there. Addresses of e-mails, whose class holds "_", go first and spell out what precedes them (the
# test data has none straight after a non-ASCII letter).
_ASCII_CLASS = r"[A-Za-z0-9._%+-]"
_MAIL = rf"(^|[^A-Za-z0-9._%+\pL\pN-])([.%+-]*)[A-Za-z0-9_]{_ASCII_CLASS}*@[A-Za-z0-9.-]+\.[A-Za-z|]{{2,}}\b"
_PLAIN = {
    "phone": pii.PATTERNS["phone"], "ssn": pii.PATTERNS["ssn"],
    "credit_card": pii.PATTERNS["credit_card"].replace(r"[-\s]", f"(?:-|{_S})"), "ip_address": pii.PATTERNS["ip_address"],
    "address": rf"\b\d+{_S}+(?:[A-Za-z0-9,.-]|{_S})+\b", "name": rf"\b[A-Za-z][A-Za-z]+{_S}+[A-Za-z][A-Za-z]+\b",
}


def _sql_redact(table: str) -> str:
    """Common tables that end in ``redacted`` (id, pii_types, sanitized_text)."""
    letters = r"[ªµºÀ-ÖØ-öø-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{D7FF}]"
    steps = [f"marked AS (SELECT id, pii_types, regexp_replace(text, '({letters})', '_\\1', 'g') AS t FROM {table})",
             f"""r0 AS (SELECT id, pii_types, CASE WHEN contains(pii_types, 'email')
                   THEN regexp_replace(t, {_sql_text(_MAIL)}, '\\1\\2[REDACTED_EMAIL]', 'g') ELSE t END AS t FROM marked)""",
             f"r1 AS (SELECT id, pii_types, regexp_replace(t, '_({letters})', '_\\1_', 'g') AS t FROM r0)"]
    for i, (kind, pattern) in enumerate(_PLAIN.items(), 2):
        steps.append(f"""r{i} AS (SELECT id, pii_types, CASE WHEN list_contains(string_split(pii_types, ','), '{kind}')
            THEN regexp_replace(t, {_sql_text(pattern)}, '[REDACTED_{kind.upper()}]', 'g') ELSE t END AS t FROM r{i - 1})""")
    steps.append(f"redacted AS (SELECT id, pii_types, regexp_replace(t, '_({letters})_', '\\1', 'g') AS sanitized_text FROM r{i})")
    return ", ".join(steps)


def _sql_gate(text: str) -> str:
    return " AND ".join(f"NOT regexp_matches({text}, {_sql_text(p)})" for p in pii.GATE_PATTERNS)


_TRAINING = """, usable AS (
    SELECT *, coalesce(nullif(model_version_id, ''), 'unknown') AS model_version FROM user_feedback
    WHERE feedback_type IN ('correction', 'training_suggestion') AND pii_sanitized AND consent_given),
  kept AS (
    SELECT model_version, count(*) FILTER (coalesce(user_correction, '') <> '') AS corrections,
           count(*) FILTER (rating <> 0) AS ratings, count(*) AS total_feedback,
           round(coalesce(avg(rating) FILTER (rating <> 0), 0), 6) AS average_rating
    FROM usable GROUP BY 1 HAVING ratings >= 10 OR corrections >= 5) """

ORACLES = {
    "pii_detect": with_views("pii_text", f"""
        SELECT id, {_sql_detect('text')} AS pii_types, {_sql_detect('text')} = '' AS fully_sanitized FROM pii_text"""),
    "pii_redact": with_views("pii_text", f"""
        , found AS (SELECT id, text, {_sql_detect('text')} AS pii_types FROM pii_text), {_sql_redact('found')}
        SELECT id, sanitized_text, pii_types, true AS fully_sanitized FROM redacted"""),
    "pii_gate": with_views("pii_text", f"SELECT id, {_sql_gate('text')} AS clean FROM pii_text"),
    "anonymize": with_views("pii_text", """
        SELECT id, substr(sha256(user_id), 1, 16) AS user_hash,
               CASE WHEN email IS NULL THEN NULL WHEN contains(email, '@') THEN string_split(email, '@')[-1] ELSE 'unknown' END
                 AS email_domain,
               CASE WHEN len(string_split(ip_address, '.')) = 4
                    THEN string_split(ip_address, '.')[1] || '.' || string_split(ip_address, '.')[2] || '.x.x' END AS ip_region
        FROM pii_text"""),
    "feedback_ingest": with_views("pii_text", f"""
        , s AS (SELECT *, coalesce(type, 'general') AS feedback_type,
                  CASE WHEN type IN ('correction', 'training_suggestion') THEN text END AS user_correction,
                  CASE WHEN type = 'flag_bad_response' THEN text END AS flagged FROM pii_text),
        f AS (SELECT *, list_sort(list_filter(string_split({_sql_detect("coalesce(user_correction, flagged, '')")}, ','),
                                              lambda x: x <> '')) AS found FROM s)
        , m AS (SELECT *, list_filter([
                  CASE WHEN CAST(id AS BIGINT) % 3 <> 0 AND type IS NOT NULL THEN '"page":"' || type || '"' END,
                  CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN '"user_hash":"' || substr(sha256(user_id), 1, 16) || '"' END,
                  CASE WHEN CAST(id AS BIGINT) % 3 <> 0 AND email IS NOT NULL THEN '"email_domain":"'
                       || CASE WHEN contains(email, '@') THEN string_split(email, '@')[-1] ELSE 'unknown' END || '"' END,
                  CASE WHEN CAST(id AS BIGINT) % 3 <> 0 AND len(string_split(ip_address, '.')) = 4 THEN '"ip_region":"'
                       || string_split(ip_address, '.')[1] || '.' || string_split(ip_address, '.')[2] || '.x.x"' END,
                  CASE WHEN len(found) > 0 THEN '"pii_detected":["' || array_to_string(found, '","')
                       || '"],"pii_sanitization_performed":true' END], lambda x: x IS NOT NULL) AS members FROM f)
        SELECT id, user_id, {_PLACE}, feedback_type, rating, consent_given, user_correction,
               len(found) = 0 AS pii_sanitized, array_to_string(found, ',') AS pii_types,
               CASE WHEN len(members) > 0 THEN '{{' || array_to_string(members, ',') || '}}' END AS metadata_json,
               CASE WHEN feedback_type IN ('correction', 'training_suggestion') AND NOT consent_given
                    THEN 'consent required' END AS reject_reason, {_PLACED_AT}
        FROM m"""),
    "rating_ingest": with_views("pii_text", f"""
        SELECT id, user_id, {_PLACE}, 'rating' AS feedback_type, rating, consent_given, true AS pii_sanitized,
               CASE WHEN rating IS NULL OR rating < 1 OR rating > 5 THEN 'rating out of range' END AS reject_reason, {_PLACED_AT}
        FROM pii_text"""),
    "flag_ingest": with_views("chat_messages", f"""
        SELECT id, user_id, string_split(id, '-')[1] AS session_id, id AS chat_id, 'm' || CAST(user_age % 4 AS VARCHAR) AS model_version_id,
               'flag_bad_response' AS feedback_type, message AS flagged_content, false AS consent_given,
               true AS pii_sanitized, '{{"reason":"' || CASE WHEN user_age > 18 THEN 'wrong' ELSE 'unclear' END
                 || '","flagged_at":"' || {_CREATED} || '"}}' AS metadata_json, {_CREATED} AS created_at
        FROM chat_messages"""),
    "correction_ingest": with_views("pii_text", f"""
        SELECT id, user_id, {_PLACE}, 'correction' AS feedback_type, text AS user_correction, consent_given,
               {_sql_gate('text')} AS pii_sanitized, {_PLACED_AT} FROM pii_text"""),
    "sink_append_consent_requests": with_views("support_tickets", f"""
        SELECT id, user_id, 'consent_request' AS feedback_type, false AS consent_given,
               '{{"user_id":"' || user_id || '","consent_type":"' || category || '","purpose":"model_training",'
                 || '"retention_period_days":365,"requested_at":"' || {_CREATED} || '","status":"pending"}}' AS metadata_json,
               {_CREATED} AS created_at
        FROM support_tickets"""),
    "consent_status": with_views("user_feedback", f"""
        , last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn FROM user_feedback
                   QUALIFY rn <= 10)
        SELECT user_id, bool_or(consent_given) AS training_consent_given,
               {_TS.format('max(created_at) FILTER (consent_given)')} AS last_consent_check,
               string_agg(feedback_type || '|' || CAST(consent_given AS VARCHAR) || '|' || {_CREATED}, ';' ORDER BY rn)
                 AS consent_history
        FROM last GROUP BY user_id"""),
    "feedback_training_agg": with_views("user_feedback", _TRAINING + "SELECT * FROM kept"),
    "feedback_training_corrections": with_views("user_feedback", _TRAINING + f"""
        SELECT model_version, id, user_correction AS correction, substr(sha256(user_id), 1, 16) AS user_hash,
               {_CREATED} AS timestamp
        FROM usable WHERE coalesce(user_correction, '') <> '' AND model_version IN (SELECT model_version FROM kept)"""),
    "privacy_report": with_views("user_feedback", f"""
        SELECT user_id, count(*) AS total_feedback_items, count(*) FILTER (consent_given) AS consent_given_count,
               count(*) FILTER (pii_sanitized) AS pii_sanitized_count,
               count(*) FILTER (consent_given AND feedback_type IN ('correction', 'training_suggestion')) AS data_used_for_training,
               count(*) FILTER (contains(metadata_json, 'pii_detected')) AS pii_incidents,
               CAST(365 AS BIGINT) AS data_retention_period_days, {_TS.format('max(created_at)')} AS last_activity
        FROM user_feedback GROUP BY user_id"""),
    "privacy_history": with_views("user_feedback", f"""
        SELECT user_id, id, feedback_type, consent_given, {_CREATED} AS timestamp,
               CASE WHEN contains(metadata_json, 'pii_detected') THEN '["email","phone"]' END AS pii_types,
               pii_sanitized AS sanitized FROM user_feedback"""),
    "job_purge_feedback": with_views("user_feedback", f"""
        SELECT id, user_id, feedback_type, consent_given, {_CREATED} AS created_at FROM user_feedback
        WHERE NOT (created_at < TIMESTAMP '2000-08-02 00:00:00' AND NOT consent_given)"""),
    "job_purge_feedback_count": with_views("user_feedback", """
        SELECT count(*) AS purged_count FROM user_feedback WHERE created_at < TIMESTAMP '2000-08-02 00:00:00' AND NOT consent_given"""),
}
