"""Queries on content safety, abuse and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions import harm
from abacist.functions.timing import iso
from abacist.operators import limits, safety
from abacist.plans.views import AS_OF_ORDERS, view, with_views
from abacist.sources.tables import spread


def _content_safety(spark, d):
    out = safety.content_safety(spread(view(spark, d, "chat_messages")), "message", "user_age")
    found = F.transform("violations", lambda v: F.concat_ws("|", v.category, v.pattern, v.severity.cast("string")))
    return out.select("id", F.array_join(found, ";").alias("violations"), F.round("severity_score", 6).alias("severity_score"),
                      "is_safe", F.array_join("recommendations", ";").alias("recommendations"))


def _chat_moderation(spark, d):
    return safety.moderate(spread(view(spark, d, "chat_messages"))).select("id", "user_id", "approved", "verdict")


def _moderation_incidents(spark, d):
    out = safety.incidents_of(safety.moderate(spread(view(spark, d, "chat_messages"))))
    return out.withColumn("created_at", iso("created_at"))


def _keyword_moderation(spark, d):
    return safety.keyword_moderation(view(spark, d, "chat_messages")).select("id", "allowed")


def _query_intent(spark, d):
    out = safety.query_intent(view(spark, d, "chat_messages"), "message")
    return out.select("id", F.array_join("intents", ",").alias("intents"))


def _rapid_fire_gaps(spark, d):
    out = safety.rapid_fire_gaps(view(spark, d, "interactions"))
    return out.withColumn("ts", iso("ts"))


def _abuse_patterns(spark, d):
    out = safety.abuse_patterns(view(spark, d, "interactions"))
    return out.select("user_id", "interactions", F.array_join("patterns_detected", ",").alias("patterns_detected"),
                      F.round("risk_score", 6).alias("risk_score"), "suspicious_activity",
                      F.array_join("recommendations", ";").alias("recommendations"))


def _safety_stats(spark, d):
    out = safety.safety_stats(view(spark, d, "safety_incidents"), AS_OF_ORDERS, days=700)
    return out.withColumn("average_resolution_time_hours", F.round("average_resolution_time_hours", 6))


def _fixed_window_limit(spark, d):
    out = limits.fixed_window_limit(view(spark, d, "clients"))
    return out.select("id", "client", iso("window_start").alias("window_start"), "allowed")


def _rate_limit_admission(spark, d):
    out = limits.rate_limit_admission(view(spark, d, "actions"))
    return out.select("id", "user_id", "action", "allowed", "violations", "retry_after_seconds")


QUERIES = {
    "content_safety": _content_safety,
    "chat_moderation": _chat_moderation,
    "chat_moderation_incidents": _moderation_incidents,
    "keyword_moderation": _keyword_moderation,
    "query_intent": _query_intent,
    "rapid_fire_gaps": _rapid_fire_gaps,
    "abuse_patterns": _abuse_patterns,
    "safety_stats": _safety_stats,
    "fixed_window_limit": _fixed_window_limit,
    "rate_limit_admission": _rate_limit_admission,
}

_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"

# Rules as one row per pattern. "\b" only matters next to letters here, and the other engine's is ASCII only,
# so the neighbours are spelt out.
_EDGE = r"(?:^|$|[^\pL\pN_])"
_FLAT = [(c, p) for c, patterns in harm.PATTERNS.items() for p in patterns]


def _spelt(pattern: str) -> str:
    return pattern.replace(r"\b.*\b", rf"(?:{_EDGE}.*{_EDGE}|{_EDGE})").replace(r"\b", _EDGE)


_RULES = "rules(pos, category, pattern, spelt, severity) AS (VALUES " + ", ".join(
    f"({i}, '{c}', '{p}', '{_spelt(p)}', {harm.SEVERITY[c]})" for i, (c, p) in enumerate(_FLAT)) + ")"
_ADVICE = "advice(category, lines) AS (VALUES " + ", ".join(
    f"('{c}', '{';'.join(lines)}')" for c, lines in harm.ADVICE.items()) + ")"
CHECKED = f""", {_RULES}, {_ADVICE},
  hits AS (SELECT m.id, r.pos, r.category, r.pattern, r.severity FROM chat_messages m, rules r
           -- the ASCII form holds wherever the exact one does, and is cheap
           WHERE CASE WHEN regexp_matches(lower(message), pattern) THEN regexp_matches(lower(message), spelt) ELSE false END),
  found AS (SELECT id, string_agg(category || '|' || pattern || '|' || CAST(severity AS VARCHAR), ';' ORDER BY pos) AS violations,
                   string_agg(category, ', ' ORDER BY pos) AS categories, CAST(max(severity) AS DOUBLE) AS top,
                   bool_or(category = 'explicit_content') AS explicit
            FROM hits GROUP BY id),
  advised AS (SELECT id, string_agg(lines, ';' ORDER BY pos) AS recommendations
              FROM (SELECT id, category, min(pos) AS pos FROM hits GROUP BY 1, 2) JOIN advice USING (category) GROUP BY id) """


def _sql_intents(text: str) -> str:
    tags = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{tag}' END"
                     for tag, words in harm.INTENTS.items())
    return f"concat_ws(',', {tags})"


ORACLES = {
    "content_safety": with_views("chat_messages", CHECKED + """
        , s AS (SELECT m.id, coalesce(violations, '') AS violations,
                  coalesce(top, 0) + CASE WHEN user_age < 18 AND explicit THEN 0.5 ELSE 0 END AS score, recommendations
                FROM chat_messages m LEFT JOIN found USING (id) LEFT JOIN advised USING (id))
        SELECT id, violations, round(score, 6) AS severity_score, score < 0.7 AS is_safe,
               CASE WHEN score < 0.7 THEN '' ELSE recommendations END AS recommendations FROM s"""),
    "chat_moderation": with_views("chat_messages", CHECKED + """
        SELECT m.id, user_id, coalesce(top, 0) < 0.7 AS approved,
               CASE WHEN coalesce(top, 0) < 0.7 THEN 'Message approved'
                    ELSE 'Message blocked due to safety concerns: ' || categories END AS verdict
        FROM chat_messages m LEFT JOIN found USING (id)"""),
    "chat_moderation_incidents": with_views("chat_messages", CHECKED + f"""
        SELECT m.id, 'harmful_content' AS incident_type, CASE WHEN top > 0.8 THEN 'medium' ELSE 'low' END AS severity,
               'Harmful content detected in global chat' AS description, user_id,
               CASE WHEN length(message) > 200 THEN substr(message, 1, 200) || '...' ELSE message END AS content_snippet,
               false AS resolved, {_AT.format('created_at')} AS created_at
        FROM chat_messages m JOIN found USING (id) WHERE top >= 0.7"""),
    "keyword_moderation": with_views("chat_messages", "SELECT id, NOT (" + " OR ".join(
        f"contains(lower(message), '{w}')" for w in harm.BLOCKED_WORDS) + ") AS allowed FROM chat_messages"),
    "query_intent": with_views("chat_messages", f"SELECT id, {_sql_intents('message')} AS intents FROM chat_messages"),
    "rapid_fire_gaps": with_views("interactions", f"""
        , last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM interactions QUALIFY rn <= 10),
        g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY rn DESC) AS prev FROM last)
        SELECT user_id, id, {_AT.format('ts')} AS ts, (epoch_us(ts) - epoch_us(prev)) // 1000000 % 86400 AS gap_seconds
        FROM g WHERE prev IS NOT NULL"""),
    "abuse_patterns": with_views("interactions", """
        , last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM interactions QUALIFY rn <= 10),
        g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY rn DESC))) // 1000000 % 86400 AS gap
              FROM last),
        gaps AS (SELECT user_id, avg(gap) AS gap FROM g GROUP BY 1),
        u AS (SELECT user_id, count(*) AS n, count(DISTINCT query) AS d, count(*) FILTER (flagged) AS f FROM interactions GROUP BY 1),
        r AS (SELECT user_id, n, n > 5 AND d / n < 0.3 AS a, n > 10 AND gap < 5 AS b, f / n > 0.5 AS c FROM u LEFT JOIN gaps USING (user_id)),
        s AS (SELECT *, CASE WHEN a THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN b THEN CAST(0.4 AS DOUBLE) ELSE 0 END
                + CASE WHEN c THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS risk FROM r)
        SELECT user_id, n AS interactions,
               concat_ws(',', CASE WHEN a THEN 'repetitive_queries' END, CASE WHEN b THEN 'rapid_fire_queries' END,
                         CASE WHEN c THEN 'consistently_flagged' END) AS patterns_detected,
               round(risk, 6) AS risk_score, risk > 0.5 AS suspicious_activity,
               CASE WHEN risk > 0.5 THEN '""" + ";".join(safety.ABUSE_ADVICE) + """' ELSE '' END AS recommendations FROM s"""),
    "safety_stats": with_views("safety_incidents", """
        , recent AS (SELECT *, CASE WHEN resolved AND resolved_at IS NOT NULL
                            THEN (epoch_us(resolved_at) - epoch_us(created_at)) / 3600000000 END AS hours
                     FROM safety_incidents WHERE created_at >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 700 DAY),
        a AS (SELECT 'type' AS breakdown, incident_type AS value, resolved, hours FROM recent
              UNION ALL SELECT 'severity', severity, resolved, hours FROM recent
              UNION ALL SELECT 'total', NULL, resolved, hours FROM recent)
        SELECT breakdown, value, count(*) AS incidents, count(*) FILTER (resolved) AS resolved_incidents,
               round(coalesce(avg(hours), 0), 6) AS average_resolution_time_hours FROM a GROUP BY 1, 2"""),
    "fixed_window_limit": with_views("clients", f"""
        SELECT id, client, {_AT.format("date_trunc('minute', ts)")} AS window_start,
               row_number() OVER (PARTITION BY client, date_trunc('minute', ts) ORDER BY ts, id) <= 10 AS allowed FROM clients"""),
    "rate_limit_admission": with_views("actions", """
        , ordered AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM actions),
        replay AS (
          SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS action,
                 CAST([] AS BIGINT[]) AS q, CAST([] AS BIGINT[]) AS s, CAST(NULL AS BOOLEAN) AS allowed,
                 CAST(NULL AS VARCHAR) AS violations, CAST(0 AS BIGINT) AS wait
          FROM (SELECT DISTINCT user_id FROM actions)
          UNION ALL
          SELECT user_id, n, id, action,
                 CASE WHEN v = '' AND action = 'query' THEN list_append(q, t) ELSE q END,
                 CASE WHEN v = '' AND action = 'session_start' THEN list_append(s, t) ELSE s END, v = '', v,
                 CASE WHEN contains(v, 'sessions_per_day') THEN 86400 - (t - s[1]) // 1000000
                      WHEN contains(v, 'queries_per_hour') THEN 3600 WHEN v <> '' THEN 60 ELSE 0 END
          FROM (SELECT *, concat_ws(',', CASE WHEN len(list_filter(q, lambda x: t - x < 60000000)) >= 10 THEN 'queries_per_minute' END,
                                    CASE WHEN len(q) >= 100 THEN 'queries_per_hour' END,
                                    CASE WHEN action = 'session_start' AND len(s) >= 5 THEN 'sessions_per_day' END) AS v
                FROM (SELECT o.user_id, o.n, o.id, o.action, o.t, list_filter(r.q, lambda x: o.t - x < 3600000000) AS q,
                             list_filter(r.s, lambda x: o.t - x < 86400000000) AS s
                      FROM replay r JOIN ordered o ON o.user_id = r.user_id AND o.n = r.n + 1)))
        SELECT id, user_id, action, allowed, violations, wait AS retry_after_seconds FROM replay WHERE n > 0"""),
}
