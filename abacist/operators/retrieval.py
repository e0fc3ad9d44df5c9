"""Vector search, prompt building, indexing rows and attachment lookup."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.session import shared_dir

MAX_CELLS = 4096  # pivots are sent to all tasks: at most so many
BLOCK_FLOATS = 1 << 23  # of a block of the index: what a task holds while the queries that reach the block pass by
BLOCKS_PER_TASK = 4  # blocks are small enough for every task slot to get some
SLICE = 256  # queries per matrix product
SLACK = 1e-7  # of a score: more than rounding to 9 digits and the angles' own errors can move it


@dataclass
class Cells:
    """What is known of each cell: small arrays that travel with the tasks."""

    pivots: np.ndarray  # the last cell has no pivot: it holds vectors of length 0
    near: np.ndarray  # smallest and
    far: np.ndarray  # largest angle between a cell's vectors and its pivot
    size: np.ndarray
    first: np.ndarray  # the first block that a cell's vectors are in, and
    blocks: np.ndarray  # their number; small neighbouring cells share a block


@dataclass
class Index:
    """The vectors as given, with their cell and block."""

    rows: DataFrame  # id, v, cell, block
    cells: Cells


def _units(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _in_blocks(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: cells in a row share a block of ``most`` vectors, larger ones have several."""
    first, blocks, at, held = np.zeros(len(size), np.int64), np.maximum(1, -(-size // most)), 0, 0
    for cell, n in enumerate(size.tolist()):
        if held and held + n > most:
            at, held = at + 1, 0
        first[cell] = at
        held += n
        if blocks[cell] > 1:
            at, held = at + int(blocks[cell]), 0
    return first, blocks


def build_index(vectors: DataFrame, id_column: str = "id", vector: str = "embedding", cells: int | None = None) -> Index:
    """Assign every vector to its nearest pivot; pivots are a hash-ordered pick of the vectors themselves.

    Unless given, there are as many cells as the square root of the number of vectors, MAX_CELLS at most. The rows are a reliable
    checkpoint, as an index is built once and searched many times.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    number = rows.count()
    wanted = cells or max(1, min(MAX_CELLS, math.isqrt(number)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = _units(np.array([r["v"] for r in picked], np.float64)) if picked else np.zeros((1, 1))
    empty = len(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(_matrix(batch.column("v")))
            angles = _angles(units, pivots)
            cell = angles.argmin(axis=1)
            angle = angles[np.arange(len(cell)), cell]
            cell[~units.any(axis=1)] = empty
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "v", "cell", "angle"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    shared_dir(spark)
    assigned = rows.mapInArrow(assign, f"{kinds}, cell INT, angle DOUBLE").checkpoint()
    near, far = np.zeros(empty + 1), np.full(empty + 1, math.pi)
    size = np.zeros(empty + 1, dtype=np.int64)
    stats = assigned.groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count(F.lit(1)).alias("n"))
    for r in stats.collect():  # one row for each cell
        size[r["cell"]] = r["n"]
        if r["cell"] != empty:
            near[r["cell"]], far[r["cell"]] = r["near"], r["far"]
    shared = max(1, number // (BLOCKS_PER_TASK * spark.sparkContext.defaultParallelism))
    first, blocks = _in_blocks(size, max(1, min(BLOCK_FLOATS // pivots.shape[1], shared)))
    start, parts = (F.element_at(F.array(*[F.lit(int(x)) for x in some]), F.col("cell") + 1) for some in (first, blocks))
    rows = assigned.select("id", "v", "cell", (start + F.pmod(F.xxhash64("id"), parts)).cast("int").alias("block"))
    return Index(rows, Cells(pivots, near, far, size, first, blocks))


def _reach(units: np.ndarray, about: Cells, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every query: a bound on its k-th best angle, and which cells may hold something within it.

    With the cells nearest to a query holding ``k`` vectors, the farthest of those is such a bound. Bounds are compared as scores,
    where rounding decides, so near copies in other cells are not lost. A query of length 0 reaches all cells.
    """
    cells = np.flatnonzero(about.size)
    if not len(cells):
        return np.full(len(units), math.pi), np.zeros((len(units), len(about.size)), bool)
    reach = np.full((len(units), len(about.size)), math.pi)
    angles = _angles(units, about.pivots)
    reach[:, :-1] = np.minimum(angles + about.far[:-1], math.pi)
    nearest = cells[np.argsort(reach[:, cells], axis=1)]
    enough = np.minimum((np.cumsum(about.size[nearest], axis=1) < k).sum(axis=1), len(cells) - 1)
    each, some = np.arange(len(units)), units.any(axis=1)
    worst = np.where(some, reach[each, nearest[each, enough]], math.pi)
    low = np.zeros_like(reach)
    low[:, :-1] = np.maximum(angles - about.far[:-1], about.near[:-1] - angles)
    may = np.cos(np.clip(low, 0.0, math.pi)) >= np.cos(worst)[:, None] - SLACK
    may[~some] = True
    may[:, about.size == 0] = False
    return worst, may


def _ask(index: Index, k: int, kind: str) -> Callable:
    """Every query with its unit vector, its bound, and the blocks that hold a cell it reaches."""
    about = index.cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                units = _units(_matrix(some.column("v")))
                worst, may = _reach(units, about, k)
                blocks = [np.unique(np.concatenate([np.arange(about.first[c], about.first[c] + about.blocks[c]) for c in np.flatnonzero(row)] or [[]]))
                          .astype(np.int32) for row in may]
                yield pa.RecordBatch.from_arrays([some.column("query_id"), pa.array(list(units), pa.list_(pa.float64())), pa.array(worst),
                                                  pa.array(blocks, pa.list_(pa.int32()))], names=["query_id", "v", "worst", "blocks"])
    return run


def _match(about: Cells, k: int) -> Callable:
    """Rows come by block, its vectors in order of (cell, id) first, then the queries that reach it; the best ``k`` of each query go on."""

    def best(queries: pa.RecordBatch, ids: pa.Array, order: np.ndarray, cells: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        ends = np.append(starts[1:], len(cells))
        for s in range(0, queries.num_rows, SLICE):
            some = queries.slice(s, SLICE)
            units, limit = _matrix(some.column("v")), np.cos(some.column("worst").to_numpy()) - SLACK
            scores, at = np.full((len(units), k), -np.inf), np.zeros((len(units), k), np.int64)
            nothing = ~units.any(axis=1)
            for a, b in zip(starts, ends):
                part, cell = np.arange(len(units)), cells[a]
                if cell < len(about.pivots):
                    angle = _angles(units, about.pivots[cell:cell + 1])[:, 0]
                    low = np.maximum(angle - about.far[cell], about.near[cell] - angle)
                    part = np.flatnonzero((np.cos(np.clip(low, 0.0, math.pi)) >= limit) | nothing)
                if not len(part):
                    continue
                found = np.round(units[part] @ matrix[a:b].T, 9)
                top = np.argsort(-found, axis=1, kind="stable")[:, :k]
                both = np.hstack([scores[part], np.take_along_axis(found, top, axis=1)])
                place = np.hstack([at[part], top + a])
                chosen = np.lexsort((order[place], -both), axis=1)[:, :k]
                scores[part] = np.take_along_axis(both, chosen, axis=1)
                at[part] = np.take_along_axis(place, chosen, axis=1)
            row, column = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(row)), ids.take(pa.array(at[row, column])),
                                              pa.array(scores[row, column])], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            key = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy()
            for a, b in itertools.pairwise([*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]):
                rows = batch.slice(a, b - a)
                if block != key[a] // 2:
                    block, held, ready = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    held.append((rows.column("id"), rows.column("cell").to_numpy(), _units(_matrix(rows.column("v")))))
                elif held:
                    if ready is None:
                        ids = pa.concat_arrays([x for x, _, _ in held])
                        order = np.empty(len(ids), np.int64)
                        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                        ready = ids, order, np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
                    yield from best(rows, *ready)
    return run


def topk(queries: DataFrame, index: Index, k: int = 5, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` index vectors of highest cosine for every query, exactly.

    The index lies in blocks of bounded size. A pass over the queries finds each one's bound and the blocks that it reaches; queries
    meet blocks by the block's number, so the index moves once, and the best of each block are merged. Nothing of the queries or of
    the index goes through the driver. Scores are rounded to 9 digits before ranking and ties go to the smaller id.
    """
    asked = queries.select(F.col(id_column).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    kinds = (asked.schema["query_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString())
    reached = asked.mapInArrow(_ask(index, k, kinds[0]), f"query_id {kinds[0]}, v ARRAY<DOUBLE>, worst DOUBLE, blocks ARRAY<INT>")
    reached = reached.select("query_id", "v", "worst", F.explode("blocks").alias("block"), F.lit(1).alias("asks"))
    met = index.rows.withColumn("asks", F.lit(0)).unionByName(reached, allowMissingColumns=True)
    met = met.repartition("block").sortWithinPartitions("block", "asks", "cell", "id")
    found = met.mapInArrow(_match(index.cells, k), f"query_id {kinds[0]}, id {kinds[1]}, score DOUBLE")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The matches with their text and source; ``vectors`` has id, embedding, text, source."""
    found = topk(queries, build_index(vectors), k)
    return found.join(vectors.select("id", "text", "source"), "id").select("query_id", "rank", "id", "text", "source", "score")


def rag_context(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """(query_id, mode, context, prompt): the matches' texts in rank order, and the prompt for the question.

    Mode ``direct`` has no context; nor has a query without matches.
    """
    texts = matches.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("found"))
    joined = queries.join(texts, "query_id", "left")
    context = F.when(F.col("mode") == "rag", F.array_join(F.col("found.text"), "\n"))
    question = F.concat(F.lit("Question: "), "query", F.lit("\n\nProvide an educational, helpful answer:"))
    return joined.withColumn("context", F.coalesce(context, F.lit(""))).withColumn(
        "prompt", F.when(F.col("context") != "", F.concat(F.lit("Context: "), "context", F.lit("\n\n"), question)).otherwise(question)
    ).select("query_id", "mode", "context", "prompt")


def interaction_rows(chats: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Index rows of stored interactions (id, session_id, user_id, query, response, error, attachments, created_at).

    A failed interaction is stored as "Error: ..." without attachments and not indexed. ``embed`` turns the text into a vector.
    """
    failed = F.col("error").isNotNull()
    text = F.concat(F.lit("User: "), "query", F.lit("\nAI: "), "response")
    rows = chats.select(
        "id", "session_id", "user_id", F.col("query").alias("user_message"),
        F.when(failed, F.concat(F.lit("Error: "), "error")).otherwise(F.col("response")).alias("ai_response"),
        F.when(failed | F.col("attachments").isNull(), F.array().cast("array<string>")).otherwise(F.col("attachments")).alias("attachments"),
        "created_at", F.when(~failed, text).alias("text"),
        F.when(~failed, F.concat(F.lit("user_interaction_"), "user_id")).alias("source"),
        F.when(~failed, F.lit("chat_history")).alias("type"))
    return rows if embed is None else rows.withColumn("embedding", F.when(F.col("text").isNotNull(), embed(F.col("text"))))


def file_rows(files: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Index rows of files with text: text, source and the file's metadata; ``embed`` turns the text into a vector."""
    rows = files.filter(F.coalesce("extracted_text", F.lit("")) != "").select(
        "id", F.col("extracted_text").alias("text"), F.concat(F.lit("user_upload_"), "user_id").alias("source"), "user_id",
        F.lit("file_content").alias("type"),
        F.to_json(F.struct("filename", "mime_type", "file_size")).alias("metadata_json"))
    return rows if embed is None else rows.withColumn("embedding", embed(F.col("text")))


def resolve_attachments(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``files``: (file_id, filename) of each attachment in list order; unknown ids drop out, and a message
    without attachments keeps an empty list. ``attachments`` is an array of ids.
    """
    wanted = messages.select(F.col("id").alias("message_id"), F.posexplode("attachments").alias("pos", "file_id"))
    named = wanted.join(files.select(F.col("id").alias("file_id"), "filename"), "file_id")
    lists = named.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("pos", "file_id", "filename"))).alias("found"))
    resolved = F.transform("found", lambda f: F.struct(f.file_id.alias("file_id"), f.filename.alias("filename")))
    none = F.array().cast("array<struct<file_id: string, filename: string>>")
    joined = messages.join(lists.withColumnRenamed("message_id", "id"), "id", "left")
    return joined.withColumn("files", F.coalesce(resolved, none)).drop("found")
