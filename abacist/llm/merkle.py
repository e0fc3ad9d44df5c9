"""Merkle dataset manifest by time-forward processing.

Leaves are the rows' digests, in order within their group; every FAN consecutive nodes become one, level by level, until one is left;
the groups' last nodes, in order of group, are the leaves of a tree that ends in the root.

A node's label is the last leaf below it and its level, so children come before their parents and siblings in a row. A sweep over the
nodes by label keeps a priority queue: each node takes its children's digests from it and puts its own in for its parent. A task
sweeps a block, the FAN ** LEVELS leaves below one node, and its queue never holds more than FAN - 1 digests a level; what is due
after the block is written as a table (the external part of the queue), which Spark deals out and sorts by label for the next round.
Rounds are as many as the logarithm of the leaves to the base FAN ** LEVELS. Then blocks are swept the other way, from the root
down: each node takes from the queue its proof suffix, the siblings on its way to the root, and puts in those of its children, and
leaves fold theirs. A suffix leaves its block once for each block below, not once for each leaf.

A group may hold any part of the rows: rows are dealt out by ranges of (group, order), numbered with prefix sums over the ranges'
counts, and blocks of a group are independent of each other. Only counts of rounds reach the driver.

Defined results: a null group comes before all others and the empty one; rows without order value come first in their group; equal
rows are leaves of their own, in any order among them, as they have equal digests. A single leaf is its group's last node, a single
group's last node is the root, and a proof without siblings is the digest of nothing. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.llm.tables import Tables

#: Children of a node.
FAN = 16
#: Levels that a task climbs at once.
LEVELS = 2
BLOCK = FAN ** LEVELS

_STEPS = "array<struct<left string, right string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
GROUP = ("named", "grouped")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def record(*columns: Column) -> Column:
    """The digest of values: each as its UTF-8 length, a colon and itself, a null one as a dash."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def numbered(rows: DataFrame, order: list[str], tables: Tables, name: str) -> DataFrame:
    """``rows`` with i, their place in their group in the order of ``order``, and n, the group's rows."""
    tie = F.monotonically_increasing_id()  # equal rows of a busy order value are dealt out too
    by = [*GROUP, *order, "tie"]
    placed = tables.save(
        rows.withColumn("tie", tie).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    key = [*GROUP, "part"]
    of_group = Window.partitionBy(*GROUP)
    parts = placed.groupBy(*key).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    parts = parts.select(*key, "first", F.sum("rows").over(of_group).alias("n"),
                         (F.sum("rows").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    return placed.join(parts, key).withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


class Queue:
    """Messages by the label of the node that they are for."""

    def __init__(self, size: int, levels: int) -> None:
        self.size, self.levels, self.heap = size, levels, []

    def label(self, level: int, place: int) -> tuple[int, int]:
        """The last leaf below a node of the block, and its level."""
        return min((place + 1) * FAN ** level, self.size) - 1, level


def sweep_up(leaves: list[str], levels: int) -> tuple[str, dict]:
    """The digest of the node ``levels`` above a block's leaves, and every inner node's children's digests by its label."""
    queue, children = Queue(len(leaves), levels), {}
    heap = queue.heap
    for i, leaf in enumerate(leaves):
        if not levels:
            return leaf, children
        heapq.heappush(heap, (queue.label(1, i // FAN), i, leaf))
        while heap and heap[0][0][0] == i:
            label = heap[0][0]
            below = []
            while heap and heap[0][0] == label:
                _, place, value = heapq.heappop(heap)
                below.append(value)
            children[label] = below
            own = digest("".join(below))
            if label[1] == levels:
                return own, children
            place //= FAN
            heapq.heappush(heap, (queue.label(label[1] + 1, place // FAN), place, own))
    raise ValueError("a block without leaves")


def sweep_down(size: int, levels: int, children: dict, steps: list[tuple[str, str]], arrive: Callable[[int, list], None]) -> None:
    """Calls ``arrive`` with every leaf's place and its way to the root, the siblings left and right of each node on it."""
    queue = Queue(size, levels)
    heap = [(_last_first(queue.label(levels, 0)), 0, steps)]
    while heap:
        label, place, way = heapq.heappop(heap)
        level = -label[1]
        if level == 0:
            arrive(place, way)
            continue
        below = children[-label[0], level]
        for k in range(len(below)):
            child = place * FAN + k
            step = ("".join(below[:k]), "".join(below[k + 1:]))
            heapq.heappush(heap, (_last_first(queue.label(level - 1, child)), child, [step, *way]))


def _last_first(label: tuple[int, int]) -> tuple[int, int]:
    return -label[0], -label[1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            yield from batch.slice(at, 2048).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _by_block(rows: Iterator[dict]) -> Iterator[tuple[tuple, list[dict]]]:
    for key, block in groupby(rows, key=lambda r: (r["named"], r["grouped"], r["block"])):
        yield key, list(block)


def _levels(n: int) -> int:
    return min(LEVELS, height(n))


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes in order of their labels, each block in one task."""
    return nodes.repartition(*GROUP, "block").sortWithinPartitions(*GROUP, "block", "i")


def _climb(nodes: DataFrame, tables: Tables, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and the last node of every group (``round`` says when it was reached)."""
    schema = pa.schema([("named", pa.bool_()), ("grouped", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(({"named": k[0], "grouped": k[1], "i": k[2], "n": -(-block[0]["n"] // BLOCK),
                              "digest": sweep_up([r["digest"] for r in block], _levels(block[0]["n"]))[0]}
                             for k, block in _by_block(_rows(batches))), schema)

    rounds, tops = [], []
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))
        rounds.append(nodes)
        above = tables.save(_dealt(nodes.select(*GROUP, "block", "i", "n", "digest"))
                            .mapInArrow(up, "named boolean, grouped string, i long, n long, digest string"), f"{name}-{len(rounds)}")
        tops.append(above.where("n = 1").withColumn("round", F.lit(len(rounds) - 1)))
        nodes = above.where("n > 1")
        if nodes.isEmpty():
            last = tops[0]
            for more in tops[1:]:
                last = last.unionByName(more)
            return rounds, last


_TOP = f"named boolean, grouped string, block long, steps {_STEPS}, subroot string, root string"


def _descend(rounds: list[DataFrame], arrivals: DataFrame, tables: Tables, name: str, leaf: Callable, leaf_type: str, leaf_schema: pa.Schema) -> DataFrame:
    """Sends what arrives at the groups' last nodes (named, grouped, round, steps, subroot, root) down to the leaves of the first round."""
    inner = pa.schema([("named", pa.bool_()), ("grouped", pa.string()), ("block", pa.int64()), ("steps", pa.list_(_STEP)), ("subroot", pa.string()),
                       ("root", pa.string())])

    def node(row: dict, way: list, top: dict) -> dict:
        return {"named": row["named"], "grouped": row["grouped"], "block": row["i"], "steps": [{"left": a, "right": b} for a, b in way],
                "subroot": top["subroot"], "root": top["root"]}

    def down(make: Callable, schema: pa.Schema) -> Callable:
        def blocks(rows: Iterator[dict]) -> Iterator[dict]:
            for _, (top, *block) in _by_block(rows):
                out: list = [None] * len(block)
                levels = _levels(block[0]["n"])
                _, children = sweep_up([r["digest"] for r in block], levels)

                def arrive(place: int, way: list) -> None:
                    out[place] = make(block[place], way, top)

                sweep_down(len(block), levels, children, [(s["left"], s["right"]) for s in top["steps"]], arrive)
                yield from out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(blocks(_rows(batches)), schema)
        return run

    below = None
    for k in range(len(rounds) - 1, -1, -1):
        messages = arrivals.where(F.col("round") == k).select(*GROUP, F.lit(0).cast("long").alias("block"), "steps", "subroot", "root")
        messages = messages if below is None else messages.unionByName(below)
        rows = rounds[k].unionByName(messages.withColumn("i", F.lit(-1).cast("long")), allowMissingColumns=True)
        if k:
            below = tables.save(_dealt(rows).mapInArrow(down(node, inner), _TOP), f"{name}-{k}")
    return _dealt(rows).mapInArrow(down(leaf, leaf_schema), leaf_type)


PROVED = ("id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
_PROVED = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def manifest(rows: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``rows`` (id, group, digest, shown).

    ``digest`` makes the tree; ``shown`` is the digest of what is held against it now, and ``verified`` says whether it leads to the
    root by the row's proof. Runs Spark jobs at once and writes tables below the shared folder.
    """
    tables = Tables(rows.sparkSession, "merkle")
    leaves = tables.save(rows.select(F.col("id").cast("long").alias("id"), F.col("group").isNotNull().alias("named"),
                                     F.coalesce(F.col("group").cast("string"), F.lit("")).alias("grouped"), "digest", "shown"), "leaves")
    leaves = numbered(leaves, ["id", "digest"], tables, "placed")
    rounds, tops = _climb(leaves, tables, "up")

    # The groups' last nodes are the leaves of one more tree.
    ends = tops.select(F.lit(True).alias("named"), F.lit("").alias("grouped"), "digest", "round", F.struct(F.col("named").alias("a"), F.col("grouped").alias("b")).alias("of"))
    ends = numbered(ends, ["of"], tables, "ends")
    upper, root = _climb(ends, tables, "root")

    def subroot(row: dict, way: list, top: dict) -> dict:
        return {"named": row["of"]["a"], "grouped": row["of"]["b"], "round": row["round"],
                "steps": [{"left": a, "right": b} for a, b in way], "subroot": row["digest"], "root": top["root"]}

    start = root.select(*GROUP, "round", F.array().cast(_STEPS).alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    arrivals = tables.save(_descend(
        upper, start, tables, "root-down", subroot, f"named boolean, grouped string, round int, steps {_STEPS}, subroot string, root string",
        pa.schema([("named", pa.bool_()), ("grouped", pa.string()), ("round", pa.int32()), ("steps", pa.list_(_STEP)), ("subroot", pa.string()),
                   ("root", pa.string())])), "arrivals")

    def leaf(row: dict, way: list, top: dict) -> dict:
        folded = row["shown"]
        for a, b in way:
            folded = digest(f"{a}{folded}{b}")
        return {"id": row["id"], "leaf": row["digest"], "subroot": top["subroot"], "root": top["root"],
                "proof_sha256": digest("".join(a + b for a, b in way)), "folded_root": folded, "verified": folded == top["root"]}

    return _descend(rounds, arrivals, tables, "down", leaf, PROVED, _PROVED)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    read = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    own, changed = record(*read, docs["text"]), record(*read, F.translate(docs["text"], upper, upper.lower()))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), own.alias("digest"), F.when(tampered, changed).alias("changed"))
    return manifest(rows.select("id", "group", "digest", F.coalesce("changed", "digest").alias("shown"))) \
        .withColumnRenamed("id", "doc_id")


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII or UTF-8 text; ``crc`` has its table."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode({text})) + 1), "
            f"lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)), "
            "lambda c, d: xor(c >> 8, crc.entries[((xor(c, d) & 255) + 1)::INT])))")


_CRC = """crc AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS entries
        FROM range(256) t(b))"""

_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))


def _twin(levels: int = 6, upper: int = 3) -> str:
    """DuckDB's form, one step a level: 16 ** levels rows a source and 16 ** upper sources at most."""
    ctes = [_CRC, f"""rows AS (SELECT doc_id, source, sha256({_FIELDS} || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS d,
            CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN sha256({_FIELDS} || coalesce(strlen(text)::VARCHAR || ':' ||
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM documents, crc)""",
            """leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM rows)""",
            "s0 AS (SELECT g, i, d FROM leaves)"]

    def climb(name: str, steps: int) -> None:
        for k in range(steps):
            ctes.append(f"{name}n{k} AS (SELECT g, count(*) AS n FROM {name}{k} GROUP BY g)")
            ctes.append(f"""{name}w{k} AS (SELECT x.g, x.i, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS a,
                coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS b, any_value(n) > 1 AS up
                FROM {name}{k} x JOIN {name}{k} y ON x.g = y.g AND x.i // 16 = y.i // 16 JOIN {name}n{k} c ON c.g = x.g GROUP BY x.g, x.i)""")
            ctes.append(f"""{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
                FROM {name}{k} JOIN {name}n{k} USING (g) GROUP BY g, i // 16)""")

    climb("s", levels)
    ctes.append(f"r0 AS (SELECT 0 AS g, g - 1 AS i, d FROM s{levels})")
    climb("r", upper)
    ctes.append("f0 AS (SELECT g, i, doc_id, d AS leaf, coalesce(changed, d) AS x, '' AS proof FROM leaves)")
    step = 0
    for name, steps, g, i in (("s", levels, "f.g", "f.i"), ("r", upper, "0", "(f.g - 1)")):
        for k in range(steps):
            ctes.append(f"""f{step + 1} AS (SELECT f.g, f.i, doc_id, leaf, CASE WHEN up THEN sha256(a || x || b) ELSE x END AS x,
                CASE WHEN up THEN proof || a || b ELSE proof END AS proof
                FROM f{step} f JOIN {name}w{k} w ON w.g = {g} AND w.i = {i} // {16 ** k})""")
            step += 1
    body = ",\n".join(ctes)
    return f"""WITH {body}
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.d AS verified
FROM f{step} f JOIN s{levels} s ON s.g = f.g CROSS JOIN r{upper} r"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES: dict[str, str] = {"op11_merkle_manifest": _twin()}
