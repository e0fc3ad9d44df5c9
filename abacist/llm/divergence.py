"""Quality rules: distribution divergence of a document from its language, with DataFrame functions only.

A document's histogram over character classes, and the one over its language's common words, are compared with the language's
reference, the mean of the histograms of all documents of that language (each different histogram counts once, so that copies
do not bend it). Every value of the language column is a language of its own. For the languages of COMMON the common words are
fixed; those of any other are the words that the most different documents of it hold. The comparison is the Jensen-Shannon distance (base 2, 0 to 1). A histogram of too few characters or words
says nothing and is not judged. Base rules refuse short documents and those that repeat themselves.

Defined results: a null text is an empty one: no words, base_failed. Documents of a null or blank language have nothing in common
to be compared with, and a language of fewer than MIN_DOCS different histograms has no reference: the base rules alone judge both. Repeated rows are judged alike; an empty table gives no rows; other columns are kept, and the
verdict's column takes underscores if its name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.llm.columns import fresh, let, total
from abacist.llm.tables import Tables

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Character classes, counted one after the other on what the earlier ones left; the rest is a class too.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{N}+", r"[.,;:?'\"()\-]+", r"[#*$%&|<>]+", r"\p{P}+")
#: Frequent words by language.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
#: So many common words are taken from the documents of any other language.
N_COMMON = 12
#: A reference is the mean of at least so many different histograms; a word is common if at least so many documents hold it.
MIN_DOCS = 10
#: References of at most so many languages (of 500 bytes) are sent to all executors; more are shuffled.
BROADCAST_LANGUAGES = 50_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Judged histograms hold at least so many characters or words.
MIN_CLASS_CHARS = 150
MIN_COMMON_WORDS = 120
#: Distances above these are refused. Mild junk that only a classifier can tell apart passes.
MAX_CLASS_DISTANCE = 0.29
MAX_COMMON_DISTANCE = 0.225
#: Shares are whole millionths, so that sums of them are the same in any order.
SCALE = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _language(lang: str) -> Column:
    """The language column's value; null where it is blank."""
    value = F.col(lang).cast("string")
    return F.when(F.trim(value) != "", value)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LANGUAGES else df


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """language, listed: the common words of every language that COMMON does not list, the most frequent one first.

    A document's hash sets one of 64 bits of each of its words; words of more bits come first, so that copies of one document,
    which share their bit, lift no word above those of many documents.
    """
    rows = docs.select(_language(lang).alias("language"), F.col(text).cast("string").alias("text")).where(~F.col("language").isin(*COMMON))
    hashed = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 2), 16, 10).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed, F.lit(64)))
    rows = rows.select("language", bit.alias("bit"), _words(F.col("text")).alias("words")).where(F.size("words") >= MIN_COMMON_WORDS)
    held = rows.select("language", "bit", F.explode(F.array_distinct("words")).alias("word")).groupBy("language", "word").agg(
        F.bit_count(F.bit_or("bit")).alias("bits"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    first = Window.partitionBy("language").orderBy(F.desc("bits"), F.desc("n"), "word")
    top = held.withColumn("at", F.row_number().over(first)).where(F.col("at") <= N_COMMON)
    return top.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("top")) \
        .select("language", F.col("top.word").alias("listed"))


def _histograms(docs: DataFrame, text: str, lang: str, row: str, words: str, taken: Column) -> DataFrame:
    """``docs`` with its words and a struct of class and common-word counts; ``taken`` has the common words of a language that
    COMMON does not list, or null."""
    language = _language(lang)
    listed = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    listed = F.coalesce(F.element_at(listed, language), taken, F.array().cast("array<string>"))
    every = sorted({w for v in COMMON.values() for w in v})
    docs = docs.withColumn(words, _words(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    joined = F.array_join(words, "")

    def classes(rest: Column, left: tuple[str, ...], counts: tuple[Column, ...]) -> Column:
        if not left:
            return F.array(*counts, F.length(rest))
        return let(F.regexp_replace(rest, left[0], ""),
                   lambda less: classes(less, left[1:], (*counts, F.length(rest) - F.length(less))))

    def common(found: Column) -> Column:
        return F.transform(listed, lambda c: F.size(F.filter(found, lambda w: w == c)))

    held = F.when(language.isin(*COMMON), F.filter(words, lambda w: w.isin(*every))) \
        .when(taken.isNotNull(), F.filter(words, lambda w: F.array_contains(taken, w))).otherwise(F.array().cast("array<string>"))

    return docs.withColumn(row, F.struct(
        language.alias("language"), F.size(words).alias("n_words"),
        let(joined, lambda x: classes(x, CLASSES, ())).alias("classes"),
        let(held, common).alias("common")))


def _shares(counts: Column, whole: Column) -> Column:
    return F.transform(counts, lambda c: F.floor(c.cast("long") * F.lit(SCALE) / F.greatest(whole, F.lit(1))))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """language, listed, classes, common: mean shares over all documents with enough text, for each language that has enough of
    them; ``listed`` has the common words that were taken from the documents, or null.

    Runs Spark jobs at once and writes tables below the shared folder.
    """
    tables = Tables(docs.sparkSession, "divergence")
    bins = [len(CLASSES) + 1, max(N_COMMON, *map(len, COMMON.values()))]
    taken = tables.save(common_words(docs, text, lang), "words")
    rows = docs.select(F.col(text).alias("text"), _language(lang).alias("language")).where("language is not null") \
        .join(_few(taken), "language", "left")
    rows = _histograms(rows, "text", "language", "row", "words", F.col("listed")).select("row.*")
    rows = rows.withColumn("chars", total(F.col("classes")))
    judged = rows.where((F.col("chars") >= MIN_CLASS_CHARS) & (F.col("n_words") >= MIN_COMMON_WORDS))
    judged = judged.select("language", _shares(F.col("classes"), F.col("chars")).alias("classes"),
                           _shares(F.col("common"), F.col("n_words")).alias("common")).distinct()
    sums = [F.sum(F.coalesce(F.get(name, F.lit(i)), F.lit(0))).alias(f"{name}{i}")
            for name, n in zip(("classes", "common"), bins) for i in range(n)]
    means = judged.groupBy("language").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= MIN_DOCS)
    means = means.select("language", *[F.array(*[F.col(f"{name}{i}") / (F.col("n") * SCALE) for i in range(n)]).alias(name)
                                       for name, n in zip(("classes", "common"), bins)])
    out = tables.save(means.join(taken, "language", "left"), "references")
    tables.drop("words")
    return out


def _distance(counts: Column, whole: Column, reference: Column, rest: bool) -> Column:
    """Jensen-Shannon distance of counts (of ``whole``) from reference shares; with ``rest``, what is in no bin is a bin too."""
    def halves(pairs: Column) -> Column:
        def part(x: Column, m: Column) -> Column:
            return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

        return total(F.transform(pairs, lambda z: let((z["p"] + z["q"]) / 2, lambda m: (part(z["p"], m) + part(z["q"], m)) / 2)),
                     "double")

    p = F.transform(counts, lambda c: c / whole)
    q = F.slice(reference, 1, F.greatest(F.size(counts), F.lit(1)))
    if rest:
        p, q = (F.concat(x, F.array(F.greatest(F.lit(1.0) - total(x, "double"), F.lit(0.0)))) for x in (p, q))
    pairs = F.zip_with(p, q, lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    return F.sqrt(F.greatest(halves(pairs), F.lit(0.0)))


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of three words found twice or more.

    Windows are compared by their 64-bit hash: among n windows of one text two differing ones agree with odds of n² / 2⁶⁵.
    """
    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))))

    def repeated(rows: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce(x["h"] == y["h"], F.lit(False))

        return F.transform(F.filter(rows, lambda x, j: same(F.get(rows, j - 1), x) | same(F.get(rows, j + 1), x)), lambda x: x["i"])

    def of_windows(windows: Column) -> Column:
        sorted_rows = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(let(sorted_rows, lambda rows: F.array_sort(repeated(rows))), covered))

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.slice(hashes, 3, F.size(hashes)),
                              lambda h, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h))
        return let(windows, of_windows)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, common_distance (null where not judged) and kept.

    Reads ``docs`` three times: for the common words of languages that COMMON does not list, for the references, and for the
    verdicts. The first two run at once and write tables below the shared folder.
    """
    into = fresh(docs, into)
    names = {name: fresh(docs, f"{into}_{name}") for name in ("row", "words", "measures", "reference")}
    row, measures, reference = (F.col(names[n]) for n in ("row", "measures", "reference"))
    means = references(docs, text, lang)
    means = means.select(F.col("language").alias(f"{names['reference']}_of"), F.struct("listed", "classes", "common").alias(names["reference"]))
    out = docs.join(_few(means), _language(lang) == F.col(f"{names['reference']}_of"), "left")
    out = _histograms(out, text, lang, names["row"], names["words"], reference["listed"])
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    chars = total(row["classes"])
    symbols = F.get(row["classes"], F.lit(CLASSES.index(SYMBOLS + "+"))).cast("long")
    n_words = row["n_words"].cast("long")
    # A generator of one row: a filter on the verdict is not pushed through it, so that nothing is evaluated again for each use.
    out = out.withColumn(names["measures"], F.explode(F.array(F.struct(
        n_words.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeat_words(F.col(names["words"])).alias("n_repeat_words"),
        F.when(reference.isNotNull() & (chars >= MIN_CLASS_CHARS), _distance(row["classes"], chars, reference["classes"], False)).alias("class_distance"),
        F.when(reference.isNotNull() & (n_words >= MIN_COMMON_WORDS) & (F.size(row["common"]) > 0),
               _distance(row["common"], n_words, reference["common"], True)).alias("common_distance")))))
    failed = (measures["n_words"] < MIN_WORDS) | (100 * measures["n_repeat_words"] > MAX_REPEAT_PERCENT * measures["n_words"])
    near = F.coalesce(measures["class_distance"] <= MAX_CLASS_DISTANCE, F.lit(True)) \
        & F.coalesce(measures["common_distance"] <= MAX_COMMON_DISTANCE, F.lit(True))
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        *[measures[c].alias(c) for c in first], failed.alias("base_failed"),
        *[measures[c].alias(c) for c in ("class_distance", "common_distance")], (~failed & near).alias("kept")).alias(into))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
                                      "quality.n_repeat_words", "quality.base_failed", "quality.kept")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {"op6_quality_rules": r"""
WITH common_words(language, common_list) AS (VALUES
  ('de', ['der', 'die', 'und', 'in', 'den', 'von', 'zu', 'das', 'mit', 'sich', 'des', 'auf']),
  ('en', ['the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'it', 'as', 'with']),
  ('es', ['de', 'la', 'que', 'el', 'en', 'y', 'a', 'los', 'se', 'del', 'las', 'un']),
  ('fr', ['de', 'la', 'le', 'et', 'les', 'des', 'en', 'un', 'du', 'une', 'que', 'est'])),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, text, CASE WHEN trim(lang, ' ') <> '' THEN lang END AS language FROM documents),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM texts),
held AS (
  SELECT language, word, count(DISTINCT bit) AS bits, count(*) AS n FROM (
    SELECT language, ('0x' || md5(t)[1:2])::INT % 64 AS bit, unnest(list_distinct(words)) AS word
    FROM worded WHERE text IS NOT NULL AND len(words) >= 120 AND language NOT IN ('de', 'en', 'es', 'fr')) GROUP BY language, word HAVING count(*) >= 10),
listed AS (
  SELECT * FROM common_words UNION ALL
  SELECT language, list(word ORDER BY bits DESC, n DESC, word) FROM (
    SELECT *, row_number() OVER (PARTITION BY language ORDER BY bits DESC, n DESC, word) AS place FROM held) WHERE place <= 12 GROUP BY language),
c0 AS (SELECT *, coalesce(array_to_string(words, ''), '') AS s0 FROM worded),
c1 AS (SELECT *, regexp_replace(s0, '\p{Ll}+', '', 'g') AS s1 FROM c0),
c2 AS (SELECT *, regexp_replace(s1, '\p{Lu}+', '', 'g') AS s2 FROM c1),
c3 AS (SELECT *, regexp_replace(s2, '\p{N}+', '', 'g') AS s3 FROM c2),
c4 AS (SELECT *, regexp_replace(s3, '[.,;:?''"()\-]+', '', 'g') AS s4 FROM c3),
c5 AS (SELECT *, regexp_replace(s4, '[#*$%&|<>]+', '', 'g') AS s5 FROM c4),
c6 AS (SELECT *, regexp_replace(s5, '\p{P}+', '', 'g') AS s6 FROM c5),
counted AS (
  SELECT r, doc_id, t, c.language, words, len(words) AS n_words, length(s0) AS word_chars, length(s4) - length(s5) AS n_symbols,
         [length(s0) - length(s1), length(s1) - length(s2), length(s2) - length(s3), length(s3) - length(s4),
          length(s4) - length(s5), length(s5) - length(s6), length(s6)] AS classes,
         list_transform(coalesce(common_list, []), lambda c: len(list_filter(words, lambda x: x = c))) AS common
  FROM c6 c LEFT JOIN listed k ON c.language = k.language),
shares AS (
  SELECT DISTINCT language, list_transform(classes, lambda c: c * 1000000 // greatest(word_chars, 1)) AS a,
         list_transform(common, lambda c: c * 1000000 // greatest(n_words, 1)) AS b
  FROM counted WHERE word_chars >= 150 AND n_words >= 120 AND language IS NOT NULL),
enough AS (SELECT language FROM shares GROUP BY language HAVING count(*) >= 10),
ref_a AS (
  SELECT language, list(m ORDER BY i) AS ref_classes FROM (
    SELECT language, i, sum(a[i]) / (count(*) * 1000000.0) AS m FROM shares, range(1, 8) g(i) GROUP BY language, i) GROUP BY language),
ref_b AS (
  SELECT language, list(m ORDER BY i) AS ref_common FROM (
    SELECT language, i, sum(coalesce(b[i], 0)) / (count(*) * 1000000.0) AS m FROM shares, range(1, 13) g(i) GROUP BY language, i)
  GROUP BY language),
pairs AS (
  SELECT r, 'a' AS kind, classes[i] / word_chars::DOUBLE AS p, ref_classes[i] AS q
  FROM counted JOIN ref_a USING (language) JOIN enough USING (language), range(1, 8) g(i) WHERE word_chars >= 150
  UNION ALL
  SELECT r, 'b', CASE WHEN i <= 12 THEN coalesce(common[i], 0) / n_words::DOUBLE ELSE 1 - list_sum(common) / n_words::DOUBLE END,
         CASE WHEN i <= 12 THEN ref_common[i] ELSE 1 - list_sum(ref_common) END
  FROM counted JOIN ref_b USING (language) JOIN enough USING (language), range(1, 14) g(i) WHERE n_words >= 120 AND len(common) > 0),
distances AS (
  SELECT r, sqrt(greatest(0, sum(CASE WHEN kind = 'a' THEN h ELSE 0 END))) AS class_distance,
         sqrt(greatest(0, sum(CASE WHEN kind = 'b' THEN h ELSE 0 END))) AS common_distance
  FROM (SELECT r, kind, (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                         + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS h FROM pairs) GROUP BY r),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, n_words - 1)) AS i FROM counted)),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows), range(0, 3) g(k) WHERE n >= 2 GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM counted) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
         coalesce(class_distance, 0) <= 0.29 AND coalesce(common_distance, 0) <= 0.225 AS near
  FROM counted LEFT JOIN distances USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM measured
"""}
