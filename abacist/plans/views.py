"""The assistant's tables as views over the driver's tables.

One SQL text per view, in the part of the dialect Spark and DuckDB share, so both
sides of a check start from the same rows. ``{table}`` names a driver table.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from abacist.session import scratch_path
from abacist.sources import commits

AS_OF = datetime(2024, 1, 31)
AS_OF_ORDERS = datetime(2001, 8, 2)

VIEWS: dict[str, str] = {
    "users": """
        SELECT DISTINCT CAST(user_id AS STRING) AS id,
               'u' || CAST(user_id AS STRING) || '@school' || CAST(user_id % 7 AS STRING) || '.example' AS email
        FROM {events}""",
    "ai_sessions": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id, ts AS started_at,
               ts + INTERVAL 60 MINUTE AS expires_at, event_id % 13 <> 0 AS is_active, value AS minutes_used,
               CAST(60 AS BIGINT) AS total_duration_minutes
        FROM {events} WHERE event_type IN ('view', 'click')""",
    "login_links": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id,
               md5(CAST(event_id AS STRING)) AS token, ts + INTERVAL 24 HOUR AS expires_at, ts AS created_at
        FROM {events} WHERE event_type = 'signup'""",
    "transactions": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id,
               CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'view' THEN 'usage' ELSE 'free_grant' END AS type,
               CASE WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN CAST(0 AS BIGINT)
                    WHEN event_type = 'purchase' THEN CAST(round(value) AS BIGINT)
                    WHEN event_type = 'view' THEN CAST(-4 AS BIGINT) ELSE CAST(4 AS BIGINT) END AS amount,
               CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'declined' END AS description,
               ts AS created_at
        FROM {events} WHERE event_type IN ('purchase', 'view', 'signup')""",
    "purchases": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id,
               CAST(event_id % 5 AS BIGINT) AS package_id
        FROM {events} WHERE event_type = 'purchase'""",
    "model_metrics": """
        SELECT CAST(event_id AS STRING) AS id, 'm' || CAST(user_id % 4 AS STRING) AS model_version_id,
               CASE event_type WHEN 'error' THEN 'inference_errors' WHEN 'purchase' THEN 'token_usage'
                    ELSE 'inference_latency' END AS metric_type,
               value, '{"user_id": "' || CAST(user_id AS STRING) || '"}' AS metadata_json, ts AS collected_at
        FROM {events} WHERE event_type IN ('view', 'click', 'error', 'purchase')""",
    "requests": """
        SELECT CAST(event_id AS STRING) AS id, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
               '/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
               value / 100 AS seconds, ts
        FROM {events}""",
    "user_feedback": """
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS user_id,
               CASE WHEN o_orderkey % 11 <> 0 THEN 'm' || CAST(o_orderkey % 4 AS STRING) END AS model_version_id,
               CASE o_orderstatus WHEN 'O' THEN 'rating' WHEN 'F' THEN 'correction' ELSE 'flag_bad_response' END AS feedback_type,
               CASE WHEN o_orderstatus IN ('O', 'F') THEN CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS rating,
               CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS flagged_content,
               CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS user_correction,
               o_orderkey % 3 <> 0 AS consent_given, o_orderkey % 5 <> 0 AS pii_sanitized,
               CASE WHEN o_orderkey % 7 = 0 THEN '{"pii_detected": ["email", "phone"], "reason": "wrong"}'
                    WHEN o_orderkey % 2 = 0 THEN '{"reason": "unclear"}' END AS metadata_json,
               o_orderdate AS created_at
        FROM {orders}""",
    "support_tickets": """
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS user_id,
               'Ticket ' || CAST(o_orderkey AS STRING) AS subject,
               CASE o_orderkey % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'billing' WHEN 2 THEN 'abuse' ELSE 'general' END AS category,
               CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'in_progress' END AS status,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'
                    ELSE 'low' END AS priority,
               o_orderdate AS created_at, CAST(NULL AS TIMESTAMP) AS last_updated, CAST(NULL AS STRING) AS assigned_to
        FROM {orders}""",
    "safety_incidents": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
                 || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS id,
               CASE l_returnflag WHEN 'A' THEN 'abuse' WHEN 'N' THEN 'harmful_content' ELSE 'pii_leak' END AS incident_type,
               CASE WHEN l_quantity <= 12 THEN 'low' WHEN l_quantity <= 25 THEN 'medium' WHEN l_quantity <= 37 THEN 'high'
                    ELSE 'critical' END AS severity,
               'line ' || CAST(l_linenumber AS STRING) AS description, CAST(l_suppkey AS STRING) AS user_id,
               CAST(NULL AS STRING) AS content_snippet, l_linestatus = 'F' AS resolved,
               CASE WHEN CAST(l_quantity AS INT) % 7 <> 0
                    THEN l_shipdate + CAST(l_quantity AS INT) * INTERVAL 1 HOUR END AS resolved_at,
               l_shipdate AS created_at
        FROM {lineitem}""",
    "model_versions": """
        SELECT CAST(p_partkey AS STRING) AS id, p_brand AS model_name, CAST(p_size AS STRING) AS version,
               p_type AS model_type,
               CASE p_partkey % 5 WHEN 0 THEN 'staging' WHEN 1 THEN 'vetted' WHEN 2 THEN 'production'
                    WHEN 3 THEN 'deprecated' ELSE 'rejected' END AS status,
               CASE WHEN p_partkey % 9 = 0 THEN '{}'
                    ELSE '{"accuracy": ' || CASE WHEN p_partkey % 100 = 0 THEN '1.0'
                                                 WHEN p_partkey % 100 < 10 THEN '0.0' || CAST(p_partkey % 100 AS STRING)
                                                 ELSE '0.' || CAST(p_partkey % 100 AS STRING) END
                         || CASE WHEN p_partkey % 8 = 0 THEN ''
                                 WHEN p_partkey % 20 < 10 THEN ', "toxicity_score": 0.0' || CAST(p_partkey % 20 AS STRING)
                                 ELSE ', "toxicity_score": 0.' || CAST(p_partkey % 20 AS STRING) END
                         || CASE WHEN p_partkey % 6 = 0 THEN ''
                                 ELSE ', "latency_ms": ' || CAST(p_partkey % 70 * 100 AS STRING) END || '}'
               END AS performance_metrics,
               CASE p_partkey % 4 WHEN 0 THEN '{"consent_verified": true}' WHEN 1 THEN '{"consent_verified": false}'
                    WHEN 2 THEN '{"consent_verified": true, "rows": 10}' END AS training_metadata,
               CAST(NULL AS STRING) AS vetted_by, CAST(NULL AS TIMESTAMP) AS vetted_at,
               CASE WHEN p_partkey % 5 IN (2, 3)
                    THEN TIMESTAMP '2024-02-01 00:00:00' + CAST(p_partkey % 97 AS INT) * INTERVAL 1 HOUR END AS deployed_at,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(p_partkey % 1000 AS INT) * INTERVAL 1 MINUTE AS created_at
        FROM {part}""",
    "deploy_requests": """
        SELECT CAST(p_partkey AS STRING) AS model_version_id,
               CASE WHEN p_partkey % 11 = 0 THEN 'canary' ELSE 'production' END AS target,
               TIMESTAMP '2024-03-01 00:00:00' + CAST(p_partkey % 61 AS INT) * INTERVAL 1 HOUR AS requested_at
        FROM {part} WHERE p_partkey % 3 = 0""",
    "human_reviews": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
                 || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS id,
               CAST(l_partkey AS STRING) AS model_version_id, CAST(l_suppkey AS STRING) AS reviewer_id,
               CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS status,
               CASE WHEN l_linenumber % 2 = 0 THEN '  see notes' END AS comments,
               CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) % 11 END AS safety_score,
               CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber AS BIGINT) END AS quality_score,
               CASE WHEN l_returnflag <> 'N' AND CAST(l_quantity AS INT) % 7 <> 0
                    THEN l_shipdate + CAST(l_quantity AS INT) * INTERVAL 1 HOUR END AS reviewed_at,
               l_shipdate AS created_at
        FROM {lineitem}""",
    "review_decisions": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
                 || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS review_id,
               CASE WHEN l_orderkey % 13 = 0 THEN 'maybe' WHEN l_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS decision,
               CASE WHEN l_orderkey % 17 = 0 THEN 'someone' ELSE CAST(l_suppkey AS STRING) END AS reviewer_id,
               CAST(l_orderkey % 10 AS BIGINT) AS safety_score, CAST(l_linenumber AS BIGINT) AS quality_score,
               'done' AS comments,
               TIMESTAMP '2024-04-01 00:00:00' + CAST(l_orderkey AS INT) * INTERVAL 1 SECOND AS decided_at
        FROM {lineitem} WHERE l_returnflag = 'N'""",
    "review_submissions": """
        SELECT CAST(p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 1000000 ELSE 0 END AS STRING) AS model_version_id,
               CAST(p_size AS STRING) AS reviewer_id
        FROM {part}""",
    "ab_tests": """
        SELECT 'exp' || CAST(p_partkey AS STRING) AS id, 'Test ' || CAST(p_partkey AS STRING) AS name,
               CAST(p_partkey AS STRING) AS model_a_version, CAST(p_partkey + 25 AS STRING) AS model_b_version,
               p_partkey % 11 / CAST(10 AS DOUBLE) AS traffic_split,
               CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' ELSE 'stopped' END AS status,
               CAST(NULL AS STRING) AS winner, CAST(NULL AS TIMESTAMP) AS end_date
        FROM {part}""",
    "ab_assignments": """
        SELECT DISTINCT CAST(user_id AS STRING) AS user_id, 'exp' || CAST(user_id % 9 AS STRING) AS experiment_id
        FROM {events}""",
    "ab_observations": """
        SELECT CASE WHEN event_id % 1000 = 7 THEN 'small' ELSE 'exp' || CAST(event_id % 5 AS STRING) END AS experiment_id,
               CAST(user_id AS STRING) AS user_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant,
               value + CASE WHEN event_id % 5 = 1 AND user_id % 2 = 1 THEN 12.5 ELSE 0 END AS metric_value,
               ts AS timestamp
        FROM {events}""",
    "chat_messages": """
        SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, CAST(conv_id % 97 AS STRING) AS user_id,
               text || CASE (conv_id + turn) % 13
                 WHEN 0 THEN ' they ATTACK some people' WHEN 1 THEN ' a knife to use' WHEN 2 THEN ' a racist joke'
                 WHEN 3 THEN ' an offensive term' WHEN 4 THEN ' fraud to sell' WHEN 5 THEN ' phishing for a Password'
                 WHEN 6 THEN ' a fake document' WHEN 7 THEN ' graphic material' WHEN 8 THEN ' SPAM here'
                 WHEN 9 THEN ' explain the math of this chart' WHEN 10 THEN ' abuse and violence' ELSE '' END AS message,
               CAST(10 + conv_id % 20 AS INT) AS user_age,
               CASE turn % 4 WHEN 1 THEN '["' || CAST(conv_id AS STRING) || '"]'
                    WHEN 2 THEN '["' || CAST(conv_id * 3 AS STRING) || '", "999999999", "' || CAST(turn AS STRING) || '"]'
                    WHEN 3 THEN '[]' END AS attachments,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id AS INT) * INTERVAL 1 MINUTE
                 + CAST(turn AS INT) * INTERVAL 10 SECOND AS created_at
        FROM {conversations}""",
    "interactions": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id,
               CASE WHEN user_id % 5 = 0 THEN 'same question' WHEN user_id % 5 = 1 THEN 'q' || CAST(event_id % 7 AS STRING)
                    ELSE 'q' || CAST(event_id AS STRING) END AS query,
               user_id % 3 = 0 OR event_type = 'error' AS flagged,
               CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + CAST(event_id AS INT) * INTERVAL 20 MILLISECOND
                    ELSE ts END AS ts
        FROM {events}""",
    "actions": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id % 15 AS STRING) AS user_id,
               CASE event_type WHEN 'signup' THEN 'session_start' ELSE 'query' END AS action,
               TIMESTAMP '2024-01-01 00:00:00'
                 + CAST(event_id % 10000 * CASE user_id % 3 WHEN 0 THEN 26 WHEN 1 THEN 900 ELSE 12000 END AS INT)
                   * INTERVAL 1 MILLISECOND AS ts
        FROM {events}""",
    "clients": """
        SELECT CAST(event_id AS STRING) AS id, '10.0.' || CAST(user_id % 7 AS STRING) || '.1' AS client,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(event_id % 10000 * 700 AS INT) * INTERVAL 1 MILLISECOND AS ts
        FROM {events}""",
    "coin_events": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id,
               CASE event_type WHEN 'purchase' THEN CAST(round(value / 10) AS BIGINT) WHEN 'signup' THEN CAST(4 AS BIGINT)
                    ELSE -(CAST(round(value / 8) AS BIGINT) + 1) END AS amount, ts
        FROM {events}""",
    "session_events": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id,
               CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'start' WHEN 'error' THEN 'extend'
                    ELSE 'credit' END AS kind,
               CASE event_type WHEN 'purchase' THEN CAST(event_id % 9 AS BIGINT) WHEN 'signup' THEN CAST(4 AS BIGINT)
                    ELSE CAST(0 AS BIGINT) END AS amount,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(event_id AS INT) * INTERVAL 3 SECOND AS ts
        FROM {events}""",
    "coins": """
        SELECT CAST(c_custkey AS STRING) AS user_id, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) AS balance,
               CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '2024-01-31 05:00:00'
                    WHEN 1 THEN TIMESTAMP '2024-01-30 05:00:00' END AS free_daily_coins_last_grant_date
        FROM {customer} WHERE c_custkey % 10 <> 7""",
    "gateway_settings": """
        SELECT 'gateway' || CAST(s_suppkey % 40 AS STRING) AS gateway, 'mid' || CAST(s_suppkey AS STRING) AS merchant_id,
               'salt' || CAST(s_suppkey AS STRING) AS salt_key, '1' AS salt_index,
               'https://qr.example/' || CAST(s_suppkey AS STRING) AS qr_code_url, s_acctbal > 0 AS is_active,
               'admin' AS updated_by,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(s_suppkey AS INT) * INTERVAL 1 MINUTE AS updated_at
        FROM {supplier}""",
    "files": """
        SELECT CAST(doc_id AS STRING) AS id, CAST(doc_id % 150 AS STRING) AS user_id,
               CASE doc_id % 4 WHEN 0 THEN 'Notes.TXT' WHEN 1 THEN 'read.me.md' WHEN 2 THEN 'data.csv' ELSE 'plain' END AS filename,
               n_chars AS file_size, 'text/plain' AS mime_type, text AS extracted_text
        FROM {documents}""",
    "pii_text": """
        SELECT CAST(doc_id AS STRING) AS id, CAST(doc_id % 150 AS STRING) AS user_id,
               text || CASE doc_id % 10 WHEN 0 THEN ' call 555-123-4567 now' WHEN 1 THEN ' id 123-45-6789 ok'
                       WHEN 2 THEN ' card 1234567812345678 end' WHEN 3 THEN ' tel 5551234567' ELSE '' END AS text,
               CASE doc_id % 5 WHEN 0 THEN 'ann' || CAST(doc_id AS STRING) || '@uni' || CAST(doc_id % 3 AS STRING) || '.example'
                    WHEN 1 THEN 'a@b@last.example' WHEN 2 THEN 'nomail' WHEN 3 THEN '' END AS email,
               CASE doc_id % 4 WHEN 0 THEN '10.2.' || CAST(doc_id % 200 AS STRING) || '.9' WHEN 1 THEN '10.2.3'
                    WHEN 2 THEN 'a.b.c.d' END AS ip_address,
               CASE doc_id % 6 WHEN 0 THEN 'correction' WHEN 1 THEN 'training_suggestion' WHEN 2 THEN 'rating'
                    WHEN 3 THEN 'flag_bad_response' WHEN 4 THEN 'general' END AS type,
               doc_id % 4 <> 0 AS consent_given,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 8 END AS rating
        FROM {documents}""",
    "pages_html": "SELECT page_id, url, html FROM {pages}",
    "vectors": """
        SELECT CAST(vec_id AS STRING) AS id, embedding, 'text ' || CAST(vec_id AS STRING) AS text,
               'source_' || CAST(label AS STRING) AS source
        FROM {embeddings}""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False, files: int = 0) -> DataFrame:
    """One view as a DataFrame, or as a stream of its table's files; only the columns a query uses are read.

    With ``files`` the table is dealt out first, in no order, over so many files, each of which is a batch.
    """
    (table,) = set(_TABLE.findall(VIEWS[name]))
    text = VIEWS[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    text = text.replace("{", "{{").replace("}", "}}").replace("{{" + table + "}}", "{source}")
    path = f"{sf_dir}/{table}.parquet"
    rows = spark.read.parquet(path)
    if stream and files:
        dealt = scratch_path(spark, f"stream-{table}")
        rows.repartition(files).write.parquet(dealt)
        rows = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(dealt)
    elif stream:
        # As a pattern the path may be one file as well as a folder of files; a batch is bounded by its bytes.
        rows = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", 1 << 30).parquet(path[:-1] + "[t]")
    return spark.sql(text, source=rows)


def with_views(names: str, body: str) -> str:
    """DuckDB text of ``body`` with the named views in front."""
    parts = [f"{name} AS ({_TABLE.sub(lambda m: m.group(1), VIEWS[name])})" for name in names.split()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def appended(rows: DataFrame, name: str, table: str | None = None) -> DataFrame:
    """The rows after they were appended as a batch, twice as by a job that runs again, and read back."""
    path = scratch_path(rows.sparkSession, name)
    for _ in range(2):
        commits.append(rows, path, "one", table)
    return commits.read(rows.sparkSession, path)
