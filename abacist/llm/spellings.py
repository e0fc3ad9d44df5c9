"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors.

One replaced letter moves two counts of a word by one, up and down; an inserted one adds one to a count. So the words near a word of
length L are found by a range search round its vector: within L1 distance two among the words of its own length, and within one
among those with a letter more (those with a letter less find it). Each length has a tree. Its upper part cuts the words into
cells by thresholds on single counts, which are fitted to a bounded sample (they decide how evenly cells are filled, not what is
found); every word goes to its cell, and to search to each cell whose box its ball reaches. A task builds the rest of the tree
for its cell and searches it with all of the cell's queries together; boxes are those of the words below a node. In the leaves,
vectors are compared by a product of threshold indicators (the sum over letters of the smaller count), and what is at the right
distance is verified by the letters' order. One edit leaves the first or the second half of a word as it is, which is looked at first.

Defined results: a null or empty text has no words; a null doc_id counts as an empty one in the hash of an occurrence; repeated rows count again. A word
without near words has form and form_n null, n_near 0, and is its own root. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.arrow import slices
from abacist.llm.merkle import _CRC, _crc32
from abacist.llm.tables import Tables

#: Code points of words: a to z, and U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Words that the cut points are fitted to, at most about so many (drawn by hash, 90 bytes each).
SAMPLE = 32_768
#: Words of a cell, and letters of all its words together. Beyond SAMPLE / 16 cells, cells grow instead.
CELL, CELL_LETTERS = 2048, 4 << 20
#: Words of a leaf of the tree within a cell.
LEAF = 128
#: Distinct words that a counting task holds before it passes their counts on.
HELD = 500_000


def word_counts(docs: DataFrame, shortest: int, every: int) -> DataFrame:
    """word, n of the words of all ``docs`` (doc_id, text) with ``shortest`` letters or more. Of an occurrence whose hash ``every``
    divides, one letter is taken away first."""
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
            totals.clear()
            return found

        for batch in slices(batches):
            texts = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                runs = Counter(pattern.findall(text))
                for run in [r for r in runs if zlib.crc32(r.encode(), start) % every == 0]:
                    at = zlib.crc32(run.encode(), start) % len(run)
                    n, short = runs.pop(run), run[:at] + run[at + 1:]
                    if len(short) >= shortest:
                        totals[short] += n
                totals.update(runs)
                if len(totals) > HELD:
                    yield out()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts of words of one length, a row each."""
    codes = letters(words)
    slot = np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26).astype(np.int64)
    return np.bincount((slot + LETTERS * np.arange(len(words))[:, None]).ravel(), minlength=len(words) * LETTERS) \
        .reshape(-1, LETTERS).astype(np.int32)


def cut(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that halve the points best (those of at most this count against the others), or none."""
    best, found = len(points) + 1, None
    for letter in np.flatnonzero(points.min(0) < points.max(0)):
        numbers = np.bincount(points[:, letter])
        below = np.cumsum(numbers)[:-1]
        uneven = np.where((below > 0) & (below < len(points)), np.abs(2 * below - len(points)), len(points) + 1)
        at = int(uneven.argmin())
        if uneven[at] < best:
            best, found = int(uneven[at]), (int(letter), at)
    return found


def upper_tree(points: np.ndarray, most: float) -> tuple | int:
    """Cuts of one length: (letter, count, lower, higher) down to cells of at most ``most`` sample points, numbered from 0."""
    numbers = iter(range(1 << 30))

    def grow(points: np.ndarray):
        at = cut(points) if len(points) > most else None
        if at is None:
            return next(numbers)
        low = points[:, at[0]] <= at[1]
        return (*at, grow(points[low]), grow(points[~low]))

    return grow(points)


def reached(tree: tuple | int, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cells and the rows of ``points`` whose ball reaches their box: a word there has at most ``up`` letters more, ``down`` fewer."""
    none = np.zeros(len(points), np.int32)
    stack = [(tree, np.arange(len(points)), none, none, {})]
    while stack:
        node, rows, more, less, box = stack.pop()
        if not len(rows):
            continue
        if not isinstance(node, tuple):
            yield node, rows
            continue
        letter, count, low, high = node
        floor, ceiling = box.get(letter, (0, 1 << 30))
        x = points[rows, letter]
        # Below the cut a word has at most ``count`` of the letter, above it more: what that asks beyond the box so far is added.
        fewer = less + np.maximum(x - count, 0) - np.maximum(x - ceiling, 0)
        keep = fewer <= down
        stack.append((low, rows[keep], more[keep], fewer[keep], {**box, letter: (floor, count)}))
        greater = more + np.maximum(count + 1 - x, 0) - np.maximum(floor - x, 0)
        keep = greater <= up
        stack.append((high, rows[keep], greater[keep], less[keep], {**box, letter: (count + 1, ceiling)}))


def leaves(points: np.ndarray) -> Iterator[tuple]:
    """A k-d tree in preorder: (depth, rows) of every node; rows of inner nodes serve for their boxes."""
    stack = [(0, np.arange(len(points)))]
    while stack:
        depth, rows = stack.pop()
        at = cut(points[rows]) if len(rows) > LEAF else None
        yield depth, rows, at is None
        if at:
            low = points[rows, at[0]] <= at[1]
            stack += [(depth + 1, rows[~low]), (depth + 1, rows[low])]


def search(points: np.ndarray, queries: np.ndarray, more: int, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate (query, point) row numbers: points that have ``more`` letters a query lacks, which lack ``less`` of its letters."""
    used = np.flatnonzero(points.any(0))
    rest = queries.sum(1) - queries[:, used].sum(1)  # letters that no point has
    points, size = points[:, used], queries.sum(1)
    alive = np.flatnonzero(rest <= less)
    queries = queries[:, used]
    paths: list[np.ndarray] = [alive]
    for depth, rows, leaf in leaves(points):
        del paths[depth + 1:]
        open_ = paths[depth]
        if len(open_):
            low, high = points[rows].min(0), points[rows].max(0)
            x = queries[open_]
            ok = (np.maximum(low - x, 0).sum(1) <= more) & (np.maximum(x - high, 0).sum(1) + rest[open_] <= less)
            open_ = open_[ok]
        paths.append(open_)
        if leaf and len(open_):
            p, low, high = points[rows], points[rows].min(0), points[rows].max(0)
            # The smaller of two counts is the sum over thresholds t of [x >= t] * [y >= t] * (t - the threshold before).
            marks, q_marks, base = [], [], np.minimum(queries[open_], low).sum(1)
            for letter in np.flatnonzero(low < high):
                steps = np.unique(p[:, letter])
                marks.append((p[:, letter, None] >= steps[1:]).astype(np.float32))
                q_marks.append(np.clip(queries[open_, letter, None] - steps[:-1], 0, np.diff(steps)).astype(np.float32))
            common = base[:, None] + (np.concatenate(q_marks, 1) @ np.concatenate(marks, 1).T if marks else np.zeros((1, len(rows)), np.float32))
            at, of = np.nonzero(common == (size[open_] - less)[:, None])
            yield open_[at], rows[of]


def one_edit(queries: list[str], points: list[str]) -> np.ndarray:
    """Whether each point is its query with one letter replaced, or inserted where it is longer. All queries have one length, all points too."""
    q, p = letters(queries), letters(points)
    if q.shape == p.shape:
        return (q != p).sum(1) == 1
    same, moved = q == p[:, :-1], q == p[:, 1:]
    head = np.where(same.all(1), q.shape[1], same.argmin(1))
    tail = np.where(moved.all(1), q.shape[1], moved[:, ::-1].argmin(1))
    return head + tail >= q.shape[1]


def _halves(words: list[str], at: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([hash(w[:at]) for w in words], np.int64), np.array([hash(w[len(w) - back:]) for w in words], np.int64))


def near_in_cell(points: list[str], queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) row numbers of words one edit apart. All points have one length; queries have it too, or one letter less."""
    length, size = len(points[0]), len(queries[0])
    at, back = size // 2, size - size // 2
    q_head, q_tail = _halves(queries, at, back)
    p_head, p_tail = _halves(points, at, back)
    step = max(1, CELL_LETTERS // length)
    for a, b in search(vectors(points), vectors(queries), 1, 1 if size == length else 0):
        half = (q_head[a] == p_head[b]) | (q_tail[a] == p_tail[b])
        a, b = a[half], b[half]
        for k in range(0, len(a), step):
            i, j = a[k:k + step], b[k:k + step]
            ok = one_edit([queries[x] for x in i], [points[x] for x in j])
            yield i[ok], j[ok]


def _route(trees: dict, lengths: set) -> object:
    """Every word to its own cell (as point), and to the cells that its balls reach (as query)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", 1 << 20):
            words = batch.column("word").to_pylist()
            sizes = np.array([len(w) for w in words], np.int64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                points = vectors([words[i] for i in own])
                for target, query, up, down in ((size, 0, 0, 0), (size, 1, 1, 1), (size + 1, 1, 1, 0)):
                    if target not in lengths:
                        continue
                    for cell, rows in reached(trees.get(target, 0), points, up, down):
                        some = pa.array(own[rows])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), target)), pa.array(np.full(len(rows), cell)), pa.array(np.full(len(rows), query, np.int32)),
                             pa.array(np.full(len(rows), size)), batch.column("word").take(some), batch.column("n").take(some)],
                            names=["length", "cell", "query", "size", "word", "n"])
    return run


#: Queries that a cell is searched with at once.
TOGETHER = 16_384


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell: its points, then its queries by their length."""
    cell, points, point_n, size, held, held_n = None, [], [], None, [], []

    def search_held() -> Iterator[pa.RecordBatch]:
        if not held or not points:
            return
        n, of = np.array(held_n, np.int64), np.array(point_n, np.int64)
        for i, j in near_in_cell(points, held):
            sides = [(held, i, points, j, of)] + ([(points, j, held, i, n)] if size != cell[0] else [])
            for one, a, two, b, number in sides:
                yield pa.RecordBatch.from_arrays([pa.array([one[x] for x in a], pa.string()), pa.array([two[x] for x in b], pa.string()),
                                                  pa.array(number[b])], names=["word", "near", "near_n"])

    for batch in batches:
        for length, number, query, own, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if cell != (length, number) or (query and own != size) or len(held) >= TOGETHER or len(held) * length >= CELL_LETTERS:
                yield from search_held()
                held, held_n = [], []
                if cell != (length, number):
                    cell, points, point_n = (length, number), [], []
                size = own
            if query:
                held.append(word)
                held_n.append(n)
            else:
                points.append(word)
                point_n.append(n)
    yield from search_held()


def near_words(words: DataFrame, tables: Tables) -> DataFrame:
    """word, near, near_n of all words one edit apart, in both directions. ``words`` (word, n) has no word twice."""
    lengths = {r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}
    total = sum(lengths.values())
    scale = 1 << 20
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(scale)) < int(scale * min(1.0, SAMPLE / max(1, total))))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("word").to_pylist()
            counts = [np.minimum(vectors([w])[0], 255).astype(np.uint8).tobytes() for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in found], pa.int64()), pa.array(counts, pa.binary())], names=["length", "counts"])

    sample = drawn.select("word").mapInArrow(shapes, "length long, counts binary").toArrow()
    sizes = sample.column("length").to_numpy()
    counts = np.frombuffer(b"".join(sample.column("counts").to_pylist()), np.uint8).reshape(-1, LETTERS).astype(np.int32)
    trees = {}
    for length in np.unique(sizes).tolist():
        points = counts[sizes == length]
        share = len(points) / lengths[length]
        tree = upper_tree(points, max(16.0, share * min(CELL, max(16, CELL_LETTERS // length))))
        if isinstance(tree, tuple):
            trees[length] = tree
    routed = words.mapInArrow(_route(trees, set(lengths)), "length long, cell long, query int, size long, word string, n long")
    dealt = routed.repartition("length", "cell").sortWithinPartitions("length", "cell", "query", "size")
    return dealt.mapInArrow(_search_cells, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` that has ``shortest`` letters and ``least`` occurrences or more.

    A word's form is its near word of largest n (of those the smallest), if that is ``factor`` times its own or more; its root is
    where forms lead. Runs Spark jobs at once and writes tables below the shared folder.
    """
    tables = Tables(docs.sparkSession, "spellings")
    words = tables.save(word_counts(docs, shortest, every).where(F.col("n") >= least), "words")
    pairs = near_words(words, tables)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    taken = -F.col("best.n") >= factor * F.col("n")
    formed = tables.save(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"),
            F.when(taken, -F.col("best.n")).alias("form_n")), "formed")

    # Forms lead to larger counts, so they end; each round doubles the steps taken. Only words with a form travel.
    ways = formed.where("form is not null").select("word", F.col("form").alias("root"))
    step = 0
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = tables.save(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                            f"ways-{step}")
        if step:
            tables.drop(f"ways-{step - 1}")
        ways, step = after.drop("moved"), step + 1
        if after.where("moved").isEmpty():
            break
    return formed.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_spellings": op13_spellings}
ORACLES: dict[str, str] = {"op13_spellings": rf"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, k, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, k, left(word, k - 1) || substr(word, k + 1) AS rest
         FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS k FROM words)),
near AS (
  SELECT DISTINCT * FROM (
    SELECT x.word, y.word AS near FROM less x JOIN less y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word
    UNION ALL SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
    UNION ALL SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest)),
best AS (SELECT a.word, count(*) AS n_near, first(b.word ORDER BY b.n DESC, b.word) AS top, max(b.n) AS top_n
         FROM near a JOIN words b ON b.word = a.near GROUP BY a.word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
           FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, form, word AS here FROM formed UNION ALL SELECT w.word, f.form, w.form FROM walk w JOIN formed f ON f.word = w.form WHERE w.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.form IS NULL
"""}
