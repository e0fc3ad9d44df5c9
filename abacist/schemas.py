"""Declared schemas of the assistant's tables.

Ids are strings, money and counters are BIGINT (sums must not overflow), JSON
objects stay STRING and are parsed where they are used.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "users": "id STRING, email STRING, public_profile STRING, metadata_json STRING, is_admin BOOLEAN, "
             "upi_id STRING, created_at TIMESTAMP, last_login_at TIMESTAMP",
    "sessions": "id STRING, user_id STRING, token STRING, expires_at TIMESTAMP, created_at TIMESTAMP",
    "coins": "id STRING, user_id STRING, balance BIGINT, free_daily_coins_last_grant_date TIMESTAMP, "
             "purchased_coins BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "transactions": "id STRING, user_id STRING, type STRING, amount BIGINT, description STRING, "
                    "gateway_transaction_id STRING, created_at TIMESTAMP",
    "ai_sessions": "id STRING, user_id STRING, started_at TIMESTAMP, expires_at TIMESTAMP, is_active BOOLEAN, "
                   "minutes_used DOUBLE, total_duration_minutes BIGINT",
    "ai_chats": "id STRING, session_id STRING, user_message STRING, ai_response STRING, "
                "attachments ARRAY<STRING>, created_at TIMESTAMP",
    "files": "id STRING, user_id STRING, filename STRING, file_path STRING, file_size BIGINT, mime_type STRING, "
             "extracted_text STRING, embedding_id STRING, created_at TIMESTAMP",
    "global_chat_messages": "id STRING, user_id STRING, message STRING, attachments ARRAY<STRING>, "
                            "is_moderated BOOLEAN, moderated_by STRING, created_at TIMESTAMP",
    "admin_user_chats": "id STRING, user_id STRING, admin_id STRING, message STRING, is_from_admin BOOLEAN, "
                        "attachments ARRAY<STRING>, created_at TIMESTAMP",
    "embeddings_index": "id STRING, file_id STRING, chat_id STRING, embedding_vector ARRAY<FLOAT>, "
                        "metadata_json STRING, created_at TIMESTAMP",
    "model_versions": "id STRING, model_name STRING, version STRING, model_type STRING, status STRING, "
                      "s3_path STRING, performance_metrics STRING, training_metadata STRING, vetted_by STRING, "
                      "vetted_at TIMESTAMP, deployed_at TIMESTAMP, created_at TIMESTAMP",
    "ab_tests": "id STRING, name STRING, description STRING, model_a_version STRING, model_b_version STRING, "
                "traffic_split DOUBLE, status STRING, start_date TIMESTAMP, end_date TIMESTAMP, "
                "target_metric STRING, results STRING, winner STRING, created_by STRING, created_at TIMESTAMP",
    "human_reviews": "id STRING, model_version_id STRING, reviewer_id STRING, status STRING, "
                     "review_criteria STRING, comments STRING, safety_score BIGINT, quality_score BIGINT, "
                     "reviewed_at TIMESTAMP, created_at TIMESTAMP",
    "user_feedback": "id STRING, user_id STRING, session_id STRING, chat_id STRING, model_version_id STRING, "
                     "feedback_type STRING, rating BIGINT, flagged_content STRING, user_correction STRING, "
                     "consent_given BOOLEAN, pii_sanitized BOOLEAN, metadata_json STRING, created_at TIMESTAMP",
    "safety_incidents": "id STRING, incident_type STRING, severity STRING, description STRING, user_id STRING, "
                        "session_id STRING, model_version_id STRING, content_snippet STRING, actions_taken STRING, "
                        "resolved BOOLEAN, resolved_by STRING, resolved_at TIMESTAMP, created_at TIMESTAMP",
    "model_metrics": "id STRING, model_version_id STRING, metric_type STRING, value DOUBLE, metadata_json STRING, "
                     "collected_at TIMESTAMP",
    "support_tickets": "id STRING, user_id STRING, subject STRING, category STRING, description STRING, "
                       "status STRING, priority STRING, assigned_to STRING, created_at TIMESTAMP, "
                       "last_updated TIMESTAMP, resolution_notes STRING",
    "payment_orders": "id STRING, user_id STRING, gateway STRING, gateway_order_id STRING, "
                      "merchant_order_id STRING, amount BIGINT, currency STRING, status STRING, package_id BIGINT, "
                      "coins_to_credit BIGINT, gateway_response STRING, payment_instrument STRING, "
                      "created_at TIMESTAMP, updated_at TIMESTAMP",
    "payment_gateway_settings": "id STRING, gateway STRING, merchant_id STRING, salt_key STRING, salt_index STRING, "
                                "qr_code_url STRING, is_active BOOLEAN, updated_by STRING, updated_at TIMESTAMP, "
                                "created_at TIMESTAMP",
}

# Values a column takes when a row arrives without one.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"is_admin": False},
    "coins": {"balance": 0, "purchased_coins": 0},
    "ai_sessions": {"is_active": True, "minutes_used": 0.0, "total_duration_minutes": 60},
    "global_chat_messages": {"is_moderated": False},
    "admin_user_chats": {"is_from_admin": False},
    "model_versions": {"status": "staging"},
    "ab_tests": {"traffic_split": 0.5, "status": "active"},
    "human_reviews": {"status": "pending"},
    "user_feedback": {"consent_given": False, "pii_sanitized": True},
    "safety_incidents": {"resolved": False},
    "support_tickets": {"status": "open", "priority": "medium"},
    "payment_orders": {"gateway": "phonepe", "currency": "INR", "status": "created"},
    "payment_gateway_settings": {"gateway": "phonepe", "is_active": False},
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
