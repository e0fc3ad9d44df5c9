"""Queries on coins, sessions, upserts and scheduled jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from abacist.functions.timing import iso
from abacist.operators import jobs, wallet
from abacist.operators.settings import public_settings
from abacist.plans.views import AS_OF, appended, view, with_views
from abacist.sources import sinks

_MIDDAY = AS_OF.replace(hour=12)
_CHATS_AS_OF = datetime(2024, 1, 8, 0, 30)
_LIVE_AT = datetime(2024, 1, 30, 23, 30)


def _active_session(spark, d):
    out = wallet.active_session(view(spark, d, "ai_sessions"), _LIVE_AT)
    return out.select("user_id", "session_id", iso("expires_at").alias("expires_at"),
                      F.round("remaining_minutes", 6).alias("remaining_minutes"))


def _session_status(spark, d):
    out = wallet.session_status(view(spark, d, "users"), view(spark, d, "ai_sessions"), _LIVE_AT)
    return out.withColumn("remaining_minutes", F.round("remaining_minutes", 6))


def _active_sessions_gauge(spark, d):
    return wallet.active_sessions_gauge(view(spark, d, "ai_sessions"), _LIVE_AT)


def _valid_login_links(spark, d):
    out = wallet.valid_login_links(view(spark, d, "login_links"), AS_OF.replace(day=15))
    return out.select("id", "user_id", "token", iso("expires_at").alias("expires_at"))


def _package_lookup(spark, d):
    return wallet.package_lookup(view(spark, d, "purchases"))


def _wallet_recent(spark, d):
    out = wallet.wallet_recent(view(spark, d, "users"), view(spark, d, "coins"), view(spark, d, "transactions"))
    return out.select("user_id", "balance", F.col("rn").cast("bigint").alias("rn"), "id", "type", "amount", "description",
                      iso("created_at").alias("created_at"))


def _ledger_replay(spark, d):
    return wallet.ledger_replay(view(spark, d, "coin_events")).withColumn("ts", iso("ts"))


def _ledger_balance(spark, d):
    out = wallet.ledger_balance(view(spark, d, "transactions"))
    return out.select("user_id", "id", "amount", "balance", iso("created_at").alias("created_at"))


def _ledger_reconcile(spark, d):
    return wallet.reconcile(view(spark, d, "coins"), view(spark, d, "transactions"))


def _session_replay(spark, d):
    out = wallet.session_replay(view(spark, d, "session_events"))
    return out.select("id", "user_id", "kind", "outcome", "session_id", "balance_after", iso("expires_at").alias("expires_at"))


def _users_without_grant(spark, d):
    return jobs.users_without_grant(view(spark, d, "users"), view(spark, d, "coins"), _MIDDAY)


def _granted(spark, d):
    return jobs.daily_grant(view(spark, d, "users"), view(spark, d, "coins"), _MIDDAY)


def _job_daily_grant(spark, d):
    return _granted(spark, d).withColumn(jobs.GRANT_COLUMN, iso(jobs.GRANT_COLUMN))


def _job_daily_grant_ledger(spark, d):
    return jobs.grant_ledger(_granted(spark, d), _MIDDAY).withColumn("created_at", iso("created_at"))


def _grant_on_read(spark, d):
    return _read_wallets(spark, d).withColumn(jobs.GRANT_COLUMN, iso(jobs.GRANT_COLUMN))


def _read_wallets(spark, d):
    """Every wallet is read, those of users without a record too."""
    people = view(spark, d, "users").select("id").unionByName(view(spark, d, "coins").select(F.concat(F.lit("new-"), "user_id").alias("id")))
    return jobs.grant_on_read(people, view(spark, d, "coins"), _MIDDAY)


def _grant_on_read_ledger(spark, d):
    rows = jobs.grant_ledger(_read_wallets(spark, d), _MIDDAY, jobs.ON_READ)
    return appended(rows, "grants", "transactions").select("id", "user_id", "type", "amount", "description", iso("created_at").alias("created_at"))


def _job_delete_old_chats(spark, d):
    kept = jobs.delete_old_chats(view(spark, d, "chat_messages"), _CHATS_AS_OF)
    return kept.select("id", "user_id", "message", iso("created_at").alias("created_at"))


def _deleted_chats(spark, d):
    return jobs.count_old_chats(view(spark, d, "chat_messages"), _CHATS_AS_OF)


def _settings(spark, d):
    """Settings after all changes: every row of the view is one change of its gateway."""
    changes = view(spark, d, "gateway_settings")
    first = changes.filter(F.col("merchant_id") == F.concat(F.lit("mid"), F.regexp_extract("gateway", r"\d+$", 0)))
    return sinks.upsert(first, changes.filter(F.col("updated_at") > F.lit(datetime(2024, 1, 1, 0, 20)).cast("timestamp_ntz")),
                        ["gateway"], "updated_at")


def _sink_upsert(spark, d):
    return _settings(spark, d).withColumn("updated_at", iso("updated_at"))


def _upsert_upi(spark, d):
    """Users after the identifiers sent with purchases, and the refused ones of ids that no user has."""
    users = view(spark, d, "users").withColumn("upi_id", F.lit(None).cast("string"))
    changes = view(spark, d, "transactions").filter(F.col("type") == "purchase").select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("gone-"), "user_id")).otherwise(F.col("user_id")).alias("id"),
        F.concat(F.lit("upi-"), "id").alias("upi_id"), "created_at")
    after, refused = sinks.update(users, changes, ["id"], "created_at")
    return after.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(refused.select("id", "upi_id", "reject_reason"),
                                                                                      allowMissingColumns=True)


def _settings_public(spark, d):
    return public_settings(_settings(spark, d)).withColumn("updated_at", iso("updated_at"))


QUERIES = {
    "active_session": _active_session,
    "session_status": _session_status,
    "active_sessions_gauge": _active_sessions_gauge,
    "valid_login_links": _valid_login_links,
    "package_lookup": _package_lookup,
    "wallet_recent": _wallet_recent,
    "ledger_replay": _ledger_replay,
    "ledger_balance": _ledger_balance,
    "ledger_reconcile": _ledger_reconcile,
    "session_replay": _session_replay,
    "users_without_grant": _users_without_grant,
    "job_daily_grant": _job_daily_grant,
    "job_daily_grant_ledger": _job_daily_grant_ledger,
    "job_grant_on_read": _grant_on_read,
    "job_grant_on_read_ledger": _grant_on_read_ledger,
    "job_delete_old_chats": _job_delete_old_chats,
    "job_delete_old_chats_count": _deleted_chats,
    "sink_upsert": _sink_upsert,
    "sink_upsert_upi": _upsert_upi,
    "settings_public": _settings_public,
}

_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"
_READ = """, people AS (SELECT id FROM users UNION SELECT 'new-' || user_id FROM coins),
  wallets AS (SELECT coalesce(user_id, p.id) AS user_id, coalesce(balance, 0)::BIGINT AS balance, free_daily_coins_last_grant_date,
      p.id IS NOT NULL AND (free_daily_coins_last_grant_date IS NULL
        OR CAST(free_daily_coins_last_grant_date AS DATE) < DATE '2024-01-31') AS due FROM people p FULL JOIN coins ON user_id = p.id) """
_LIVE = """, live AS (SELECT user_id, id AS session_id, expires_at,
    round(greatest(0, (epoch_us(expires_at) - epoch_us(TIMESTAMP '2024-01-30 23:30:00')) / 60000000), 6) AS remaining_minutes
  FROM ai_sessions WHERE is_active AND expires_at > TIMESTAMP '2024-01-30 23:30:00'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY expires_at DESC, id DESC) = 1) """
_GRANTS = """, g AS (
    SELECT coalesce(u.id, c.user_id) AS user_id, coalesce(balance, 0) AS balance, free_daily_coins_last_grant_date AS last,
           u.id IS NOT NULL AND coalesce(CAST(free_daily_coins_last_grant_date AS DATE) <> DATE '2024-01-31', true) AS granted
    FROM users u FULL JOIN coins c ON u.id = c.user_id) """
_SETTINGS = """, merged AS (
    SELECT *, 1 AS priority FROM gateway_settings WHERE updated_at > TIMESTAMP '2024-01-01 00:20:00'
    UNION ALL
    SELECT *, 0 FROM gateway_settings WHERE merchant_id = 'mid' || replace(gateway, 'gateway', '')),
  settings AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY gateway ORDER BY priority DESC, updated_at DESC) = 1) """

ORACLES = {
    "active_session": with_views("ai_sessions", _LIVE + f"""
        SELECT user_id, session_id, {_AT.format('expires_at')} AS expires_at, remaining_minutes FROM live"""),
    "session_status": with_views("users ai_sessions", _LIVE + """
        SELECT u.id AS user_id, session_id, CAST(coalesce(remaining_minutes, 0) AS DOUBLE) AS remaining_minutes
        FROM users u LEFT JOIN live ON live.user_id = u.id"""),
    "active_sessions_gauge": with_views("ai_sessions", """
        SELECT count(*) AS active_sessions FROM ai_sessions WHERE is_active AND expires_at > TIMESTAMP '2024-01-30 23:30:00'"""),
    "valid_login_links": with_views("login_links", f"""
        SELECT id, user_id, token, {_AT.format('expires_at')} AS expires_at FROM login_links
        WHERE expires_at > TIMESTAMP '2024-01-15 00:00:00'"""),
    "package_lookup": with_views("purchases", """
        SELECT p.*, CAST(price AS BIGINT) AS price, CAST(coins AS BIGINT) AS coins,
               CASE WHEN price IS NULL THEN 'unknown package' END AS reject_reason
        FROM purchases p LEFT JOIN (VALUES (1, 7, 15), (2, 14, 35), (3, 21, 75)) k(k, price, coins) ON k = package_id"""),
    "wallet_recent": with_views("users coins transactions", f"""
        , last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn FROM transactions QUALIFY rn <= 10)
        SELECT u.id AS user_id, coalesce(balance, 0) AS balance, rn, last.id, type, amount, description,
               {_AT.format('created_at')} AS created_at
        FROM users u LEFT JOIN coins c ON c.user_id = u.id LEFT JOIN last ON last.user_id = u.id"""),
    "ledger_replay": with_views("coin_events", f"""
        , ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM coin_events),
        replay AS (
          SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, CAST(0 AS BIGINT) AS amount,
                 CAST(NULL AS TIMESTAMP) AS ts, true AS accepted, CAST(0 AS BIGINT) AS balance_after
          FROM (SELECT DISTINCT user_id FROM coin_events)
          UNION ALL
          SELECT o.user_id, o.n, o.id, o.amount, o.ts, o.amount >= 0 OR balance_after + o.amount >= 0,
                 CASE WHEN o.amount >= 0 OR balance_after + o.amount >= 0 THEN balance_after + o.amount ELSE balance_after END
          FROM replay r JOIN ordered o ON o.user_id = r.user_id AND o.n = r.n + 1)
        SELECT user_id, id, amount, {_AT.format('ts')} AS ts, accepted, balance_after FROM replay WHERE n > 0"""),
    "ledger_balance": with_views("transactions", f"""
        SELECT user_id, id, amount, {_AT.format('created_at')} AS created_at,
               CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
        FROM transactions"""),
    "ledger_reconcile": with_views("coins transactions", """
        , l AS (SELECT user_id, CAST(sum(amount) AS BIGINT) AS s FROM transactions GROUP BY 1)
        SELECT coalesce(c.user_id, l.user_id) AS user_id, coalesce(balance, 0) AS recorded_balance, coalesce(s, 0) AS ledger_balance,
               coalesce(balance, 0) - coalesce(s, 0) AS difference
        FROM coins c FULL JOIN l ON c.user_id = l.user_id WHERE coalesce(balance, 0) <> coalesce(s, 0)"""),
    "session_replay": with_views("session_events", f"""
        , ordered AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM session_events),
        replay AS (
          SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS kind,
                 CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS live_id, CAST(0 AS BIGINT) AS expiry, CAST(0 AS BIGINT) AS balance
          FROM (SELECT DISTINCT user_id FROM session_events)
          UNION ALL
          SELECT user_id, n, id, kind, outcome, CASE WHEN outcome = 'opened' THEN id ELSE live_id END,
                 CASE outcome WHEN 'opened' THEN t + 3600000000 WHEN 'extended' THEN expiry + 3600000000 ELSE expiry END,
                 CASE outcome WHEN 'credited' THEN balance + amount WHEN 'opened' THEN balance - 4 WHEN 'extended' THEN balance - 4 ELSE balance END
          FROM (SELECT o.user_id, o.n, o.id, o.kind, o.amount, o.t, r.live_id, r.expiry, r.balance,
                       CASE WHEN o.kind = 'credit' THEN 'credited' WHEN o.kind = 'start' AND r.expiry > o.t THEN 'live'
                            WHEN r.balance < 4 THEN 'rejected' WHEN o.kind = 'extend' AND r.expiry > o.t THEN 'extended'
                            ELSE 'opened' END AS outcome
                FROM replay r JOIN ordered o ON o.user_id = r.user_id AND o.n = r.n + 1))
        SELECT id, user_id, kind, outcome, CASE WHEN outcome IN ('live', 'opened', 'extended') THEN live_id END AS session_id,
               balance AS balance_after,
               CASE WHEN outcome IN ('live', 'opened', 'extended') THEN {_AT.format('make_timestamp(expiry)')} END AS expires_at
        FROM replay WHERE n > 0"""),
    "users_without_grant": with_views("users coins", """
        SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM coins WHERE CAST(free_daily_coins_last_grant_date AS DATE) = DATE '2024-01-31')"""),
    "job_daily_grant": with_views("users coins", _GRANTS + f"""
        SELECT user_id, balance + CASE WHEN granted THEN 4 ELSE 0 END AS balance,
               CASE WHEN granted THEN '2024-01-31T12:00:00.000000' ELSE {_AT.format('last')} END AS free_daily_coins_last_grant_date,
               granted FROM g"""),
    "job_daily_grant_ledger": with_views("users coins", _GRANTS + """
        SELECT 'grant-2024-01-31-' || user_id AS id, user_id, 'free_grant' AS type, CAST(4 AS BIGINT) AS amount,
               'Daily free coins' AS description, '2024-01-31T12:00:00.000000' AS created_at FROM g WHERE granted"""),
    "job_grant_on_read": with_views("coins users", _READ + f"""
        SELECT user_id, CASE WHEN due THEN balance + 4 ELSE balance END AS balance,
               CASE WHEN due THEN '2024-01-31T12:00:00.000000' ELSE {_AT.format('free_daily_coins_last_grant_date')} END
                 AS free_daily_coins_last_grant_date, due AS granted FROM wallets"""),
    "job_grant_on_read_ledger": with_views("coins users", _READ + """
        SELECT 'grant-2024-01-31-' || user_id AS id, user_id, 'free_grant' AS type, CAST(4 AS BIGINT) AS amount,
               'Daily free coins granted' AS description, '2024-01-31T12:00:00.000000' AS created_at FROM wallets WHERE due"""),
    "job_delete_old_chats": with_views("chat_messages", f"""
        SELECT id, user_id, message, {_AT.format('created_at')} AS created_at FROM chat_messages
        WHERE created_at >= TIMESTAMP '2024-01-01 00:30:00'"""),
    "job_delete_old_chats_count": with_views("chat_messages", """
        SELECT count(*) AS deleted_chats FROM chat_messages WHERE created_at < TIMESTAMP '2024-01-01 00:30:00'"""),
    "sink_upsert": with_views("gateway_settings", _SETTINGS + f"""
        SELECT gateway, merchant_id, salt_key, salt_index, qr_code_url, is_active, updated_by,
               {_AT.format('updated_at')} AS updated_at FROM settings"""),
    "sink_upsert_upi": with_views("users transactions", """
        , sent AS (SELECT CASE WHEN CAST(id AS BIGINT) % 50 = 0 THEN 'gone-' || user_id ELSE user_id END AS id,
                          'upi-' || id AS upi, created_at FROM transactions WHERE type = 'purchase'),
        changes AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, upi DESC) = 1)
        SELECT u.id, email, upi AS upi_id, NULL AS reject_reason FROM users u LEFT JOIN changes USING (id)
        UNION ALL SELECT id, NULL, upi, 'not found' FROM sent WHERE id NOT IN (SELECT id FROM users)"""),
    "settings_public": with_views("gateway_settings", _SETTINGS + f"""
        SELECT gateway, merchant_id, qr_code_url, is_active, {_AT.format('updated_at')} AS updated_at FROM settings"""),
}
