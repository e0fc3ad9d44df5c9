"""Quotation linking: replies that quote earlier messages become reply-ordered conversations without quotes.

Lines that begin with ``>`` are quotes, nested as deep as they have such marks. A passage is a run of lines of one level; it and
its single lines are hashed after normalising (case and white space). The same is done with what messages say themselves.
A quoted passage comes from the message of its conversation that said it first; if its whole text was never said, its longest
line decides, and of equally long ones the later message. Passages of every level are looked up. The lowest level of which one
was said before decides: the message that its longest passage comes from is replied to. Following replies upwards gives each message a thread (its topmost message) and a depth; conversations read in the
order of conversation, thread and turn, so that no reply comes before what it answers.

First appearances are aggregated before the join, so each quoted passage meets one row, however often it was said, and no
conversation is collected anywhere. Threads are found by doubling the steps upwards, one join for each doubling.

Defined results: a null text is empty; a quote of nothing earlier in the conversation links nothing; passages of white space are
not looked up; rows without conv_id or turn link nothing; of rows that repeat conv_id and turn each is cleaned, and the longest
link (then the later message) of any holds for all; empty tables give no rows; other columns are kept, and new ones take
underscores if their name is taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.columns import fresh
from abacist.llm.tables import Tables

MARKS = re.compile(r"[ \t]*(?:>[ \t]*)+")
#: A line that only announces a quote: ends so, and a quoted line follows.
ANNOUNCES = re.compile(r"(?:wrote|writes|schrieb|a écrit|escribió) ?:$")
PASSAGE = "level int, size int, hash binary"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str) -> tuple[str, list[tuple[int, int, bytes]]]:
    """What a message says itself, and level, size and hash of its passages and of their single lines."""
    levels, lines = [], []
    for line in text.split("\n"):
        marks = MARKS.match(line)
        levels.append(line[:marks.end()].count(">") if marks else 0)
        lines.append(line[marks.end():] if marks else line)
    for i in range(len(lines) - 1):
        if not levels[i] and levels[i + 1] and ANNOUNCES.search(normal(lines[i])):
            lines[i] = ""
    units, at = set(), 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or levels[i] != levels[at]:
            units.add((levels[at], normal("\n".join(lines[at:i]))))
            at = i
    units.update((level, normal(line)) for level, line in zip(levels, lines))
    units.add((0, normal("\n".join(x for level, x in zip(levels, lines) if not level))))
    own = "\n".join(x for level, x in zip(levels, lines) if not level)
    own = re.sub(r"\n{3,}", "\n\n", own).strip()
    return own, [(level, len(said), hashlib.md5(said.encode("utf-8", "replace")).digest()) for level, said in sorted(units) if said]


def _parsed(messages: DataFrame, text: str, own: str, passages: str) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("size", T.IntegerType()),
                                     T.StructField("hash", T.BinaryType())]))
    schema = T.StructType([*messages.schema.fields, T.StructField(own, T.StringType()), T.StructField(passages, kind)])
    arrow = pa.list_(pa.struct([("level", pa.int32()), ("size", pa.int32()), ("hash", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x or "") for x in batch.column(text).to_pylist()]
            units = [[{"level": a, "size": b, "hash": c} for a, b, c in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array(units, arrow)],
                                             names=[*batch.schema.names, own, passages])

    return messages.mapInArrow(run, schema)


def _quoted(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, size, hash, source: quoted passages of ``parsed`` (conv_id, turn, passages), with the earlier turn that
    said them first."""
    units = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    said = units.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    return units.where("level > 0").distinct().join(said, ["conv_id", "hash"]).where("source < turn") \
        .select("conv_id", "turn", "level", "size", "hash", "source")


def _links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent of the messages of ``parsed`` (conv_id, turn, passages) that quote an earlier one."""
    return _quoted(parsed).groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "size", "source")).alias("best")) \
        .select("conv_id", "turn", F.col("best.source").alias("parent"))


def _keyed(messages: DataFrame, text: str) -> DataFrame:
    keys = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col(text).alias("text"))
    return _parsed(keys.where("conv_id is not null and turn is not null"), "text", "own", "passages").select("conv_id", "turn", "passages")


def sources(messages: DataFrame, text: str = "text") -> DataFrame:
    """conv_id, turn, level, size, hash, source of every passage and line of ``messages`` that quotes an earlier one, at any level."""
    return _quoted(_keyed(messages, text))


def _threads(links: DataFrame, tables: Tables) -> DataFrame:
    """conv_id, turn, thread, depth of the messages of ``links``; each round doubles the steps that are known."""
    now, step = tables.save(links.select("conv_id", "turn", F.col("parent").alias("above"), F.lit(1).cast("long").alias("depth")), "steps-0"), 0
    while True:
        step += 1
        further = now.select("conv_id", F.col("turn").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        after = tables.save(now.join(further, ["conv_id", "above"], "left").select(
            "conv_id", "turn", F.coalesce("next", "above").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved")), f"steps-{step}")
        if after.where("moved").isEmpty():
            return after.select("conv_id", "turn", F.col("above").alias("thread"), "depth")
        now = after.drop("moved")


def linked(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` (conv_id, turn, text) with a struct ``reply``: own_text, reply_to, thread, depth.

    Runs Spark jobs at once and writes tables below the shared folder.
    """
    into = fresh(messages, "reply")
    own, passages = f"{into}_own", f"{into}_passages"
    tables = Tables(messages.sparkSession, "quotations")
    links = tables.save(_links(_keyed(messages, text)), "links")
    threads = tables.save(links.join(_threads(links, tables), ["conv_id", "turn"]), "threads")
    conv, turn = f"{into}_conv", f"{into}_turn"
    named = threads.select(F.col("conv_id").alias(conv), F.col("turn").alias(turn), F.col("parent").alias(f"{into}_to"),
                           F.col("thread").alias(f"{into}_thread"), F.col("depth").alias(f"{into}_depth"))
    out = _parsed(messages, text, own, passages).drop(passages)
    out = out.join(named, (out["conv_id"].cast("long") == named[conv]) & (out["turn"].cast("long") == named[turn]), "left")
    return out.select(*[out[c] for c in messages.columns], F.struct(
        F.col(own).alias("own_text"), F.col(f"{into}_to").alias("reply_to"),
        F.coalesce(F.col(f"{into}_thread"), out["turn"].cast("long")).alias("thread"),
        F.coalesce(F.col(f"{into}_depth"), F.lit(0).cast("long")).alias("depth")).alias(into))


def _marked(said: Column, marks: str) -> Column:
    return F.concat(F.lit(marks), F.regexp_replace(said, "\n", "\n" + marks))


def _mails(conversations: DataFrame) -> DataFrame:
    """The conversations as mails: every second message quotes the one before whole, every fourth the two before (nested), some
    only a message's first line, some the message before the last one with two marks and nothing else."""
    said = conversations.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("text").alias("said"))
    one = said.select("c", (F.col("t") + 1).alias("t"), F.col("said").alias("one"))
    two = said.select("c", (F.col("t") + 2).alias("t"), F.col("said").alias("two"))
    joined = conversations.join(one, (F.col("conv_id") == one["c"]) & (F.col("turn") == one["t"]), "left").drop("c", "t") \
        .join(two, (F.col("conv_id") == two["c"]) & (F.col("turn") == two["t"]), "left").drop("c", "t")
    n = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(8))
    quote = F.when(n.isin(1, 5), _marked(F.col("one"), "> ")) \
        .when(n == 3, F.concat(_marked(F.col("two"), ">> "), F.lit("\n"), _marked(F.col("one"), "> "))) \
        .when(n == 7, _marked(F.col("two"), ">> ")) \
        .when(n == 6, F.concat(F.lit(">  "), F.translate(F.split("two", "\n")[0], "aeiou", "AEIOU")))
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n", F.when(quote.isNotNull(), F.lit("They wrote:")), quote, "text").alias("text"))


def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = _mails(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return linked(mails).select("conv_id", "turn", "role", "reply.reply_to", "reply.thread", "reply.depth", F.col("reply.own_text").alias("text"))


QUERIES = {"op2_quotations": op2_quotations}
ORACLES: dict[str, str] = {"op2_quotations": r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY conv_id, turn),
mails AS (
  SELECT c.conv_id, c.turn, c.role, row_number() OVER () AS r,
         CASE WHEN q IS NULL THEN c.text ELSE 'They wrote:' || chr(10) || q || chr(10) || c.text END AS text
  FROM (SELECT c.*, CASE
          WHEN (c.conv_id * 3 + c.turn) % 8 IN (1, 5) THEN '> ' || replace(a.said, chr(10), chr(10) || '> ')
          WHEN (c.conv_id * 3 + c.turn) % 8 = 3
            THEN '>> ' || replace(b.said, chr(10), chr(10) || '>> ') || chr(10) || '> ' || replace(a.said, chr(10), chr(10) || '> ')
          WHEN (c.conv_id * 3 + c.turn) % 8 = 7 THEN '>> ' || replace(b.said, chr(10), chr(10) || '>> ')
          WHEN (c.conv_id * 3 + c.turn) % 8 = 6 THEN '>  ' || translate(string_split(b.said, chr(10))[1], 'aeiou', 'AEIOU') END AS q
        FROM conversations c LEFT JOIN said a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
        LEFT JOIN said b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2) c),
lines AS (
  SELECT conv_id, turn, r, i, regexp_replace(line, '^[ \t]*(>[ \t]*)+', '') AS line,
         length(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+')) - length(replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '>', '')) AS level
  FROM (SELECT conv_id, turn, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM mails)),
cleaned AS (
  SELECT conv_id, turn, r, i, level,
         CASE WHEN level = 0 AND lead(level) OVER w > 0
                   AND regexp_matches(lower(trim(line)), '(wrote|writes|schrieb|a écrit|escribió) ?:$') THEN '' ELSE line END AS line,
         CASE WHEN lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS fresh
  FROM lines WINDOW w AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM cleaned),
pieces AS (
  SELECT conv_id, turn, level, line AS piece FROM runs
  UNION ALL SELECT any_value(conv_id), any_value(turn), any_value(level), string_agg(line, ' ' ORDER BY i) FROM runs GROUP BY r, run
  UNION ALL SELECT any_value(conv_id), any_value(turn), 0, string_agg(line, ' ' ORDER BY i) FROM runs WHERE level = 0 GROUP BY r),
units AS (
  SELECT DISTINCT conv_id, turn, level, piece FROM (
    SELECT conv_id, turn, level, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS piece FROM pieces) WHERE piece <> ''),
firsts AS (SELECT conv_id, piece, min(turn) AS first FROM units WHERE level = 0 GROUP BY conv_id, piece),
links AS (
  SELECT conv_id, turn, arg_max(first, length(piece) * 1000000 + first - level * 1000000000000) AS parent
  FROM units JOIN firsts USING (conv_id, piece) WHERE level > 0 AND first < turn GROUP BY conv_id, turn),
up AS (
  SELECT conv_id, turn, parent, parent AS thread, 1 AS depth FROM links
  UNION ALL SELECT up.conv_id, up.turn, up.parent, links.parent, up.depth + 1 FROM up JOIN links ON links.conv_id = up.conv_id AND links.turn = up.thread),
tops AS (SELECT conv_id, turn, any_value(parent) AS reply_to, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY conv_id, turn),
owned AS (SELECT r, trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS own
          FROM runs WHERE level = 0 GROUP BY r)
SELECT m.conv_id, m.turn, m.role, t.reply_to, coalesce(t.thread, m.turn)::BIGINT AS thread, coalesce(t.depth, 0)::BIGINT AS depth, coalesce(o.own, '') AS text
FROM mails m LEFT JOIN tops t USING (conv_id, turn) LEFT JOIN owned o USING (r)
"""}
