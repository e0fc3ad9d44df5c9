"""Queries on files, pages, retrieval and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from abacist.functions.timing import iso
from abacist.operators import chat, retrieval
from abacist.plans.views import AS_OF, appended, view, with_views
from abacist.session import scratch_path
from abacist.sources import commits, documents, tables


def _src_tables(spark, d):
    """Written without some columns and values, read with the declared schema and defaults."""
    path = scratch_path(spark, "user-feedback")
    view(spark, d, "user_feedback").withColumns({
        "consent_given": F.when(F.col("rating") != 3, F.col("consent_given")), "created_at": F.col("created_at").cast("timestamp")}).write.parquet(path)
    return tables.read(spark, "user_feedback", path).select(
        "id", "user_id", "session_id", "feedback_type", "rating", "consent_given", "pii_sanitized")


def _uploads(spark, d):
    """Every document as uploaded bytes, some with bytes that are not UTF-8; beside them files of a format without decoder and empty ones."""
    content = F.encode("extracted_text", "UTF-8")
    stray = F.when(F.col("id") % 5 == 0, F.concat(content, F.unhex(F.lit("FFFE")))).otherwise(content)
    own = F.struct(F.col("filename").alias("name"), stray.alias("content"))
    scan = F.when(F.col("id") % 7 == 0, F.struct(F.lit("scan.PDF").alias("name"), content.alias("content")))
    empty = F.when(F.col("id") % 11 == 0, F.struct(F.col("filename").alias("name"), F.lit(b"").alias("content")))
    return view(spark, d, "files").select("id", F.inline(F.array_compact(F.array(own, scan, empty))))


def _src_files_text(spark, d):
    return documents.indexable(documents.extract_text(_uploads(spark, d))).select("id", "name", "ext", "text")


def _src_html_extract(spark, d):
    return documents.extract_pages(view(spark, d, "pages_html"), AS_OF)


def _vector_topk(spark, d):
    vectors = view(spark, d, "vectors")
    out = retrieval.vector_topk(vectors.filter(F.col("id") % 100 == 0), vectors)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "text", "source",
                      F.round("score", 6).alias("score"))


def _rag_context(spark, d):
    vectors = view(spark, d, "vectors")
    asked = vectors.filter(F.col("id") % 100 == 0)
    queries = asked.select(F.col("id").alias("query_id"), F.concat(F.lit("what is "), "text", F.lit("?")).alias("query"),
                             F.when(F.col("id") % 3 == 1, "direct").otherwise("rag").alias("mode"))
    return retrieval.rag_context(queries, retrieval.vector_topk(asked, vectors))


def _vowels(text: Column) -> Column:
    """Stands in for the caller's embedding: how often each vowel occurs."""
    return F.transform(F.array(*(F.lit(v) for v in "aeiou")),
                       lambda v: (F.char_length(text) - F.char_length(F.replace(text, v, F.lit("")))).cast("double"))


def _as_text(vector: str) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("bigint").cast("string")), ",")


def _interaction_index(spark, d):
    turns = view(spark, d, "chat_messages").select(
        "id", F.split("id", "-")[0].alias("session_id"), "user_id", F.col("message").alias("query"),
        F.concat(F.lit("Answer to "), "id").alias("response"),
        F.when(F.col("user_age") % 5 == 0, F.concat(F.lit("timeout in "), "id")).alias("error"),
        F.from_json("attachments", "array<string>").alias("attachments"), "created_at")
    out = retrieval.interaction_rows(turns, _vowels)
    return out.withColumns({"embedding": _as_text("embedding"), "attachments": F.array_join("attachments", ","), "created_at": iso("created_at")})


def _embedding_index(spark, d):
    out = retrieval.file_rows(view(spark, d, "files"), _vowels)
    return out.withColumn("embedding", _as_text("embedding"))


def _attachment_resolve(spark, d):
    messages = view(spark, d, "chat_messages").select("id", "user_id", F.from_json("attachments", "array<string>").alias("attachments"))
    out = retrieval.resolve_attachments(messages, view(spark, d, "files"))
    return out.select("id", "user_id", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f.file_id, f.filename)), ";")
                      .alias("files"))


def _messages(spark, d):
    return view(spark, d, "chat_messages").withColumn("attachments", F.from_json("attachments", "array<string>"))


def _global_chat_rows(spark, d):
    out = chat.public_rows(_messages(spark, d).withColumn("user_id", F.when(F.col("user_age") != 12, F.col("user_id"))))
    return out.select("id", "user_id", "message", F.array_join("attachments", ",").alias("attachments"), "is_moderated",
                      iso("created_at").alias("created_at"))


def _admin_chat(spark, d):
    """Stored encrypted and read back."""
    key = F.lit(b"0123456789abcdef")
    rows = _messages(spark, d).withColumns({
        "admin_id": F.when(F.col("user_age") > 20, F.lit("a1")), "is_from_admin": F.when(F.col("user_age") > 15, F.lit(True))})
    out = chat.read_private(chat.private_rows(rows, key), key)
    return out.select("id", "user_id", "admin_id", "message", "is_from_admin")


def _feedback_queue(spark, d):
    items = view(spark, d, "user_feedback").select(
        F.col("id").alias("interaction_id"), F.col("feedback_type").alias("type"), "rating", "created_at")
    return appended(chat.feedback_queue(items), "queue").withColumn("timestamp", iso("timestamp"))


def _upsert_vectors(spark, d):
    """The whole index written, then every vector twice again, scaled: the later change counts."""
    path, vectors = scratch_path(spark, "vectors"), view(spark, d, "vectors").select("id", "embedding", "source")
    commits.create(vectors, ["id"], path)
    changes = vectors.select("id", "embedding", F.explode(F.array(F.lit(3), F.lit(2))).alias("times"))
    commits.merge(changes.select("id", F.transform("embedding", lambda x: (x * F.col("times")).cast("float")).alias("embedding"),
                                 F.lit("again").alias("source"), (-F.col("times")).alias("at")), ["id"], "at", path)
    out = commits.read(spark, path)
    return out.select("id", "source", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


QUERIES = {
    "global_chat_rows": _global_chat_rows,
    "admin_chat_encrypted": _admin_chat,
    "sink_append_feedback_queue": _feedback_queue,
    "sink_upsert_vectors": _upsert_vectors,
    "src_tables": _src_tables,
    "src_files_text": _src_files_text,
    "src_html_extract": _src_html_extract,
    "vector_topk": _vector_topk,
    "rag_context": _rag_context,
    "interaction_index": _interaction_index,
    "embedding_index": _embedding_index,
    "attachment_resolve": _attachment_resolve,
}

_TOP = """, pairs AS (SELECT q.id AS query_id, v.id, v.text, v.source,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
    FROM vectors q, vectors v WHERE CAST(q.id AS BIGINT) % 100 = 0),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= 5) """
_VOWELS = " || ',' || ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{v}', '')) AS VARCHAR)" for v in "aeiou")

_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"

ORACLES = {
    "global_chat_rows": with_views("chat_messages", f"""
        SELECT id, CASE WHEN user_age <> 12 THEN user_id ELSE 'anonymous' END AS user_id, message,
               coalesce(array_to_string(CAST(CAST(attachments AS JSON) AS VARCHAR[]), ','), '') AS attachments,
               false AS is_moderated, {_AT.format('created_at')} AS created_at
        FROM chat_messages WHERE NOT regexp_matches(lower(message), 'spam|abuse|hate|violence')"""),
    "admin_chat_encrypted": with_views("chat_messages", """
        SELECT id, user_id, CASE WHEN user_age > 20 THEN 'a1' ELSE 'admin' END AS admin_id, message,
               user_age > 15 AS is_from_admin FROM chat_messages"""),
    "sink_append_feedback_queue": with_views("user_feedback", f"""
        SELECT id AS interaction_id, '{{"type":"' || feedback_type || '"' || coalesce(',"rating":' || CAST(rating AS VARCHAR), '') || '}}'
                 AS feedback, {_AT.format('created_at')} AS timestamp FROM user_feedback"""),
    "sink_upsert_vectors": with_views("vectors", """
        SELECT id, 'again' AS source, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 2, 4) AS total FROM vectors"""),
    "src_tables": with_views("user_feedback", """
        SELECT id, user_id, CAST(NULL AS VARCHAR) AS session_id, feedback_type, rating,
               coalesce(CASE WHEN rating <> 3 THEN consent_given END, false) AS consent_given, pii_sanitized FROM user_feedback"""),
    "src_files_text": with_views("files", """
        SELECT id, filename AS name, string_split(lower(filename), '.')[-1] AS ext, extracted_text AS text FROM files
        WHERE extracted_text <> ''"""),
    # Walks each page's tokens with the stack of open elements; enough for the markup these pages use.
    "src_html_extract": with_views("pages_html", """
        , clean AS (SELECT page_id, url, regexp_replace(regexp_replace(html,
                      '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<[^>]*$', '') AS h FROM pages_html),
        lists AS (SELECT page_id, regexp_extract_all(h, '<[^>]*>|[^<]+') AS l FROM clean),
        tokens AS (SELECT page_id, n, l[n] AS tok, regexp_extract(l[n], '^</?([a-z0-9]+)', 1) AS tag, starts_with(l[n], '</') AS ends
                   FROM lists, range(1, 100000) r(n) WHERE n <= len(l)),
        walk AS (
          SELECT page_id, CAST(0 AS BIGINT) AS n, CAST('' AS VARCHAR) AS tok, CAST([] AS VARCHAR[]) AS tags, CAST([] AS BIGINT[]) AS ids
          FROM pages_html
          UNION ALL
          SELECT t.page_id, t.n, t.tok,
                 CASE WHEN t.tag = '' OR t.tag IN ('br', 'meta') THEN tags WHEN NOT ends THEN list_append(tags, t.tag)
                      WHEN NOT list_contains(tags, t.tag) THEN tags
                      ELSE tags[:len(tags) - list_position(list_reverse(tags), t.tag)] END,
                 CASE WHEN t.tag = '' OR t.tag IN ('br', 'meta') THEN ids WHEN NOT ends THEN list_append(ids, t.n)
                      WHEN NOT list_contains(tags, t.tag) THEN ids
                      ELSE ids[:len(tags) - list_position(list_reverse(tags), t.tag)] END
          FROM walk w JOIN tokens t ON t.page_id = w.page_id AND t.n = w.n + 1),
        elements AS (SELECT page_id, n AS element, tag FROM tokens WHERE tag IN ('p', 'title') AND NOT ends),
        open AS (SELECT page_id, n, tok, unnest(ids) AS element FROM walk WHERE NOT starts_with(tok, '<') AND tok <> ''),
        texts AS (SELECT e.page_id, e.element, e.tag, coalesce(string_agg(tok, '' ORDER BY n), '') AS text
                  FROM elements e LEFT JOIN open USING (page_id, element) GROUP BY 1, 2, 3),
        plain AS (SELECT page_id, element, tag, regexp_replace(replace(replace(replace(text, '&quot;', '"'), '&copy;', '©'),
                    '&middot;', '·'), '&amp;?', '&', 'g') AS text FROM texts)
        SELECT url, coalesce((SELECT arg_min(text, element) FROM plain t WHERE t.page_id = p.page_id AND tag = 'title'), '') AS title,
               coalesce((SELECT string_agg(text, ' ' ORDER BY element) FROM plain t WHERE t.page_id = p.page_id AND tag = 'p'), '') AS content,
               '2024-01-31T00:00:00' AS crawled_at
        FROM pages_html p"""),
    "vector_topk": with_views("vectors", _TOP + """
        SELECT query_id, rank, id, text, source, round(score, 6) AS score FROM top"""),
    "rag_context": with_views("vectors", _TOP + """
        , c AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS found FROM top GROUP BY 1),
        q AS (SELECT id AS query_id, 'Question: what is ' || text || '?' || chr(10) || chr(10)
                       || 'Provide an educational, helpful answer:' AS question,
                     CASE WHEN CAST(id AS BIGINT) % 3 = 1 THEN 'direct' ELSE 'rag' END AS mode
              FROM vectors WHERE CAST(id AS BIGINT) % 100 = 0)
        SELECT query_id, mode, CASE WHEN mode = 'rag' THEN found ELSE '' END AS context,
               CASE WHEN mode = 'rag' THEN 'Context: ' || found || chr(10) || chr(10) || question ELSE question END AS prompt
        FROM q JOIN c USING (query_id)"""),
    "interaction_index": with_views("chat_messages", f"""
        , t AS (SELECT *, user_age % 5 = 0 AS failed, 'User: ' || message || chr(10) || 'AI: Answer to ' || id AS x FROM chat_messages)
        SELECT id, string_split(id, '-')[1] AS session_id, user_id, message AS user_message,
               CASE WHEN failed THEN 'Error: timeout in ' || id ELSE 'Answer to ' || id END AS ai_response,
               CASE WHEN failed THEN '' ELSE coalesce(array_to_string(CAST(CAST(attachments AS JSON) AS VARCHAR[]), ','), '') END AS attachments,
               {_AT.format('created_at')} AS created_at,
               CASE WHEN NOT failed THEN x END AS text, CASE WHEN NOT failed THEN 'user_interaction_' || user_id END AS source,
               CASE WHEN NOT failed THEN 'chat_history' END AS type, CASE WHEN NOT failed THEN {_VOWELS.format('x')} END AS embedding
        FROM t"""),
    "embedding_index": with_views("files", f"""
        SELECT id, extracted_text AS text, 'user_upload_' || user_id AS source, user_id, 'file_content' AS type,
               '{{"filename":"' || filename || '","mime_type":"' || mime_type || '","file_size":' || CAST(file_size AS VARCHAR) || '}}'
                 AS metadata_json, {_VOWELS.format('extracted_text')} AS embedding
        FROM files WHERE coalesce(extracted_text, '') <> ''"""),
    "attachment_resolve": with_views("chat_messages files", """
        , a AS (SELECT id, unnest(CAST(CAST(attachments AS JSON) AS VARCHAR[])) AS file_id,
                       generate_subscripts(CAST(CAST(attachments AS JSON) AS VARCHAR[]), 1) AS pos FROM chat_messages),
        r AS (SELECT a.id, string_agg(f.id || ':' || filename, ';' ORDER BY pos) AS files FROM a JOIN files f ON f.id = file_id GROUP BY 1)
        SELECT m.id, user_id, coalesce(r.files, '') AS files FROM chat_messages m LEFT JOIN r ON r.id = m.id"""),
}
