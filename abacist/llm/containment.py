"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

A document is contaminated by a test item if it contains at least p / q of the item's distinct shingles. The MinHash sketch of an item
of n shingles is its smallest hashes: a contaminated document lacks at most n - p * n / q of the shingles, so of one sketch value more
it must have one. Items are partitioned by size, n doubling from band to band, and each band has a cut-off of its own, the largest
sketch value in it: a fifth of the hashes' range and a little where items are long, up to all of it where they have a few shingles.
A value of a document carries the bands whose cut-off it does not exceed, and is sent only if there are any: it meets the sketches of
these bands alone. Documents and items that so share a sketch value are candidates, whatever the document's length;
candidates are verified by the whole shingles, as text.

Words are runs of letters and digits of the lower-cased text; shingles have five words (all words, where there are fewer: an item of
one to four words is found in documents that are exactly these words, not within longer ones).
Defined results: null and empty texts have no shingles and contaminate nothing; rows of equal text are searched once and all
reported; several texts of one item_id are items of their own and the best of them is reported; rows without a doc_id are
reported without one; a document is reported once with each of its items; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.columns import fresh, let
from abacist.llm.tables import Tables

WIDTH = 5
#: Contaminated from p / q of an item's shingles on.
P, Q = 4, 5
#: Sides of at most so many rows (of 40 bytes) are sent to all executors; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words: Column, join) -> Column:
    """``join`` of every window of WIDTH words, or of all words where there are fewer; nothing where there are none."""
    whole = F.when(F.size(words) == 0, F.slice(words, 1, 0)).otherwise(F.array(F.array_join(words, " ")))
    return F.when(F.size(words) < WIDTH, F.transform(whole, lambda w: join([w]))).otherwise(
        F.transform(F.slice(words, WIDTH, F.greatest(F.size(words), F.lit(1))),
                    lambda w, i: join([*[F.get(words, i + j) for j in range(WIDTH - 1)], w])))


def shingles(text: Column) -> Column:
    """Distinct shingles as text."""
    return let(_words(text), lambda words: F.array_distinct(_windows(words, lambda w: F.concat_ws(" ", *w))))


def hashes(text: Column) -> Column:
    """Shingles as 64-bit hashes, with repeats."""
    def of(words: Column) -> Column:
        short = F.transform(F.when(F.size(words) == 0, F.slice(words, 1, 0)).otherwise(F.array(F.array_join(words, " "))), lambda w: F.xxhash64(w))
        long = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _windows(h, lambda w: F.xxhash64(*w)))
        return F.when(F.size(words) < WIDTH, short).otherwise(long)

    return let(_words(text), of)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, tables: Tables) -> DataFrame:
    """text_key, item_id, n_shingles, n_found: texts (by the MD5 of their bytes) and the items they contain.

    Runs Spark jobs at once and writes tables below the shared folder.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
    items = benchmark.select("item_id", text.alias("text")).distinct()
    items = items.select("item_id", F.md5(F.col("text").cast("binary")).alias("item_key"), shingles(F.col("text")).alias("item_shingles"),
                         F.array_sort(F.array_distinct(hashes(F.col("text")))).alias("item_hashes"))
    items = tables.save(items.where(F.size("item_shingles") > 0), "items")
    n = F.size("item_hashes")
    needed = n - F.floor((n * P + Q - 1) / Q).cast("int") + 1
    band = F.floor(F.log2(n.cast("double"))).cast("int")
    sketches = tables.save(items.select("item_id", "item_key", band.alias("band"), F.explode(F.slice("item_hashes", F.lit(1), needed)).alias("hash")),
                           "sketches")
    # At most 31 rows: the bands from the highest cut-off down, so that the bands a value serves are the first ones of them.
    cuts = sorted(((r["cut"], r["band"]) for r in sketches.groupBy("band").agg(F.max("hash").alias("cut")).collect()), reverse=True)
    place = F.element_at(F.create_map(*[F.lit(x) for k, (_, b) in enumerate(cuts) for x in (b, k)]), F.col("band")) if cuts else F.lit(0)
    serves = lambda h: sum((F.when(h <= F.lit(cut).cast("long"), 1).otherwise(0) for cut, _ in cuts), F.lit(0))
    sketch = F.filter(hashes(F.col("text")), lambda h: h <= F.lit(cuts[0][0] if cuts else 0).cast("long"))
    values = texts.select("text_key", F.explode(sketch).alias("hash")).withColumn("serves", serves(F.col("hash")))
    candidates = values.join(sketches.withColumn("place", place), "hash").where("place < serves").select("text_key", "item_id", "item_key").distinct()
    candidates = tables.save(candidates, "candidates")
    wanted = _few(tables.save(candidates.select("text_key").distinct(), "wanted"))
    whole = tables.save(texts.join(wanted, "text_key").dropDuplicates(["text_key"])
                        .select("text_key", shingles(F.col("text")).alias("text_shingles")), "whole")
    found = candidates.join(whole, "text_key").join(items, ["item_key", "item_id"]).select(
        "text_key", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("text_shingles", "item_shingles")).cast("long").alias("n_found"))
    best = found.where(Q * F.col("n_found") >= P * F.col("n_shingles")).groupBy("text_key", "item_id").agg(
        F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_found", "n_shingles")).alias("best"))
    out = tables.save(best.select("text_key", "item_id", "best.n_shingles", "best.n_found"), "found")
    tables.drop("items", "sketches", "candidates", "wanted", "whole")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that contain no item, all columns kept."""
    key = fresh(docs, "text_key")
    hits = contaminated(docs, benchmark, Tables(docs.sparkSession, "containment"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bad = _few(hits.select(F.col("text_key").alias(key)).distinct())
    return docs.withColumn(key, F.md5(text.cast("binary"))).join(bad, key, "left_anti").drop(key)


def op8_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Tables(spark, "containment"))
    named = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    return named.join(_few(hits), "text_key").groupBy("doc_id", "item_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))


QUERIES = {"op8_benchmark_overlap": op8_benchmark_overlap}
ORACLES: dict[str, str] = {"op8_benchmark_overlap": r"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, coalesce(text, '') FROM benchmark),
worded AS (
  SELECT kind, r, id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM texts),
shingles AS (
  SELECT DISTINCT kind, r, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
         ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS s
  FROM (SELECT kind, r, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY r),
found AS (
  SELECT d.r AS d, i.r AS i, d.id AS doc_id, i.id AS item_id, count(*) AS n_found
  FROM shingles d JOIN shingles i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, max(n)::BIGINT AS n_shingles, max(n_found)::BIGINT AS n_found
FROM found JOIN sizes ON sizes.r = found.i WHERE 5 * n_found >= 4 * n GROUP BY doc_id, item_id
"""}
