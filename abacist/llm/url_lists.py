"""URL filters: a temporal join of captures with dated lists.

A list is a history of dated entries for keys: a domain (with all hosts below it), a path prefix below a host, or a whole URL. An
entry blocks or allows its key, or removes it from the list; it holds from the beginning of its day until the day of the key's
next entry. An as-of join evaluates every capture against the entries active on the day it was fetched; of several active entries
the most specific one decides (whole URL, then the longest path, then the longest domain).

Captures are reduced to different (URL, day) pairs before any join, and those to different (key, day) pairs before they meet the
intervals, so neither a busy host nor a URL that was fetched often multiplies rows.

Defined results: a capture without URL or fetch day, or one that no active entry names, is not listed and stays; entries
without key, kind, action or day are ignored; of several entries of one key and day the hardest counts (block, allow, remove);
repeated captures are all reported; empty lists list nothing; other columns are kept, and new ones take underscores if their name is
taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.llm.columns import fresh

BLOCK, ALLOW, REMOVE = "block", "allow", "remove"
DOMAIN, PATH, URL = "domain", "path", "url"
_ACTIONS = {REMOVE: 0, ALLOW: 1, BLOCK: 2}
_KINDS = {DOMAIN: 0, PATH: 1, URL: 2}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    """The path without trailing slashes."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, action, valid_from, valid_to (exclusive, null while open) of ``entries`` (kind, key, action, day).

    Entries of one key and day are merged first, so a key has at most one row for each day.
    """
    known = entries.where(F.col("kind").isin(*_KINDS) & F.col("action").isin(*_ACTIONS) & F.col("key").isNotNull() & F.col("day").isNotNull())
    code = F.coalesce(*[F.when(F.col("action") == a, n) for a, n in _ACTIONS.items()])
    daily = known.groupBy("kind", "key", F.col("day").cast("date").alias("valid_from")).agg(F.max(code).alias("code"))
    following = F.lead("valid_from").over(Window.partitionBy("kind", "key").orderBy("valid_from"))
    return daily.withColumn("valid_to", following).where(F.col("code") > 0).select(
        "kind", "key", F.when(F.col("code") == 2, BLOCK).otherwise(ALLOW).alias("action"), "valid_from", "valid_to")


def _keys(url: Column, labels: int, segments: int) -> Column:
    """All keys that may list a URL; domains of up to ``labels`` labels and paths of up to ``segments`` segments, the most that
    any entry has."""
    names = F.split(host(url), r"\.")
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))

    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))),
                          lambda n: F.array_join(F.slice(names, F.size(names) - n + 1, n), "."))
    paths = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(parts), F.lit(segments)))),
        lambda n: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(named(DOMAIN, domains), named(PATH, paths), named(URL, F.array(url)))


def listed(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day", into: str = "listed") -> DataFrame:
    """``captures`` with a struct ``into``: kind, key, action and valid_from of the deciding entry (null where there is none), and
    whether the capture is blocked.

    Reads the entries' greatest numbers of labels and segments first (one row to the driver).
    """
    into = fresh(captures, into)
    held = intervals(entries)
    most = held.agg(F.max(F.when(F.col("kind") == DOMAIN, F.size(F.split("key", r"\.")))).alias("labels"),
                    F.max(F.when(F.col("kind") == PATH, F.size(F.split("key", "/")) - 1)).alias("segments")).first()
    pairs = captures.select(F.col(url).alias("url"), F.col(day).cast("date").alias("day")).where("url is not null and day is not null").distinct()
    asked = pairs.select("url", "day", F.explode(_keys(F.col("url"), max(1, most.labels or 1), max(1, most.segments or 1))).alias("k")) \
        .select("url", "day", "k.kind", "k.key")
    active = asked.select("kind", "key", "day").distinct().join(held, ["kind", "key"]) \
        .where("valid_from <= day and (valid_to is null or day < valid_to)")
    rank = F.struct(F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in _KINDS.items()]).alias("rank"),
                    F.length("key").alias("size"), F.col("key").alias("key"))
    best = asked.join(active, ["kind", "key", "day"]).groupBy("url", "day").agg(
        F.max_by(F.struct("kind", "key", "action", "valid_from"), rank).alias("entry"))
    url_name, day_name = fresh(captures, "list_url"), fresh(captures, "list_day")
    best = best.select(F.col("url").alias(url_name), F.col("day").alias(day_name), "entry")
    out = captures.join(best.withColumnRenamed("entry", f"{into}_entry"),
                        (captures[url] == best[url_name]) & (captures[day].cast("date") == best[day_name]), "left")
    entry = F.col(f"{into}_entry")
    return out.select(*[captures[c] for c in captures.columns], F.struct(
        entry["kind"].alias("kind"), entry["key"].alias("key"), entry["action"].alias("action"), entry["valid_from"].alias("valid_from"),
        F.coalesce(entry["action"] == BLOCK, F.lit(False)).alias("blocked")).alias(into))


def _number(value: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value)), 1, 6), 16, 10).cast("long")


def _histories(pages: DataFrame) -> DataFrame:
    """Dated entries over the pages' own hosts, their parents and first path segments: each listed, dropped and listed again."""
    hosts = pages.select(host(F.col("url")).alias("h"), F.regexp_extract(path(F.col("url")), "^/([^/]+)", 1).alias("s")).where("h <> ''")
    keys = hosts.select(F.lit(DOMAIN).alias("kind"), F.col("h").alias("key")).unionByName(
        hosts.select(F.lit(DOMAIN).alias("kind"), F.regexp_replace("h", r"^[^.]+\.", "").alias("key"))).unionByName(
        hosts.where("s <> ''").select(F.lit(PATH).alias("kind"), F.concat("h", F.lit("/"), "s").alias("key"))).distinct()
    n = _number(F.concat("kind", "key"), "list")
    first = F.lit("2024-01-01").cast("date")
    dated = keys.select("kind", "key", F.explode(F.array(*[
        F.struct(F.when(n % m == r, F.lit(action)).alias("action"), F.date_add(first, (offset + n % spread).cast("int")).alias("day"))
        for m, r, action, offset, spread in ((2, 0, BLOCK, 0, 90), (4, 0, REMOVE, 90, 60), (8, 0, BLOCK, 160, 40), (3, 1, ALLOW, 20, 50),
                                             (9, 1, REMOVE, 75, 80))])).alias("e"))
    return dated.select("kind", "key", "e.action", "e.day").where("action is not null")


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day of the year by its id, against lists over the hosts that the pages have."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod("page_id", F.lit(240))).cast("int")))
    return listed(captures, _histories(pages)).select(
        "page_id", "url", F.col("day").cast("string").alias("day"), "listed.kind", "listed.key", "listed.action",
        F.col("listed.valid_from").cast("string").alias("valid_from"), "listed.blocked")


QUERIES = {"op1_url_lists": op1_url_lists}
ORACLES: dict[str, str] = {"op1_url_lists": r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 240)::INT AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages),
names AS (
  SELECT DISTINCT kind, key FROM (
    SELECT 'domain' AS kind, h AS key FROM captures WHERE h <> ''
    UNION ALL SELECT 'domain', regexp_replace(h, '^[^.]+\.', '') FROM captures WHERE h <> ''
    UNION ALL SELECT 'path', h || '/' || regexp_extract(p, '^/([^/]+)', 1) FROM captures WHERE h <> '' AND regexp_extract(p, '^/([^/]+)', 1) <> '')),
numbered AS (SELECT kind, key, ('0x' || substr(md5('list' || kind || key), 1, 6))::BIGINT AS n FROM names),
entries AS (
  SELECT kind, key, CASE WHEN max(code) = 2 THEN 'block' WHEN max(code) = 1 THEN 'allow' ELSE 'remove' END AS action, day FROM (
    SELECT kind, key, 2 AS code, DATE '2024-01-01' + (n % 90)::INT AS day FROM numbered WHERE n % 2 = 0
    UNION ALL SELECT kind, key, 0, DATE '2024-01-01' + (90 + n % 60)::INT FROM numbered WHERE n % 4 = 0
    UNION ALL SELECT kind, key, 2, DATE '2024-01-01' + (160 + n % 40)::INT FROM numbered WHERE n % 8 = 0
    UNION ALL SELECT kind, key, 1, DATE '2024-01-01' + (20 + n % 50)::INT FROM numbered WHERE n % 3 = 1
    UNION ALL SELECT kind, key, 0, DATE '2024-01-01' + (75 + n % 80)::INT FROM numbered WHERE n % 9 = 1) GROUP BY kind, key, day),
spelt AS (
  SELECT page_id, url, day, h, string_split(h, '.') AS labels, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts FROM captures),
asked AS (
  SELECT page_id, day, 'domain' AS kind, array_to_string(labels[i:], '.') AS key FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM spelt)
  UNION ALL SELECT page_id, day, 'path', h || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM spelt)),
active AS (
  SELECT a.page_id, a.kind, a.key, e.action, e.day AS valid_from FROM asked a ASOF JOIN entries e
  ON a.kind = e.kind AND a.key = e.key AND a.day >= e.day),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY kind DESC, length(key) DESC, key DESC) AS rn FROM active WHERE action <> 'remove')
SELECT c.page_id, c.url, c.day::VARCHAR AS day, kind, key, action, valid_from::VARCHAR AS valid_from, coalesce(action = 'block', false) AS blocked
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.rn = 1
"""}
