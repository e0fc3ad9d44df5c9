"""Replays: decisions that depend on every earlier decision of the same key.

A window cannot express them, and one task per key would break on a busy key. Rows are range-partitioned
by (key, time), so a busy key spans many partitions, and each partition is read as a stream with a small
state. Only the state crosses a partition boundary: partitions first run from a guessed start, then those
whose true start turned out different run again, until nothing changes. The fixpoint is the sequential
result: the first partition of a key is right at once, and each round settles at least one more.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abacist.session import scratch_path, shared_dir


class Fold:
    """What a replay does with one row. States are small JSON values."""

    columns: Sequence[str] = ()  # row columns ``step`` receives
    output = ""  # DDL of the columns it adds

    def start(self):
        """State of a key before its first row."""
        raise NotImplementedError

    def step(self, state, row):
        """(next state, output values)"""
        raise NotImplementedError

    def advance(self, state, columns):
        """State after all rows of ``columns`` (one array each); a fold that can skip rows overrides this."""
        for row in zip(*(column.tolist() for column in columns)):
            state, _ = self.step(state, row)
        return state

    def drift(self) -> Column | None:
        """Column whose sum helps to guess the state after some rows."""
        return None

    def guess(self, start, total):
        return self.start()

    def carry(self, end):
        """The part of an end state the next partition starts from."""
        return end

    def reuse(self, old_start, end, new_start):
        """End state for ``new_start`` if it follows from the old run without reading rows, else None."""
        return None


def range_chunks(rows: DataFrame, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``rows`` sorted by (key, order) over range partitions, with their number as ``chunk``.

    A key with many rows spans several chunks. The checkpoint fixes which rows a chunk holds (a second run
    could draw other bounds) and is where the work restarts if executors are lost. Unless given, the number of
    partitions is the session's number of shuffle partitions, whatever the rows are.
    """
    spark = rows.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(spark)
    ranged = rows.repartitionByRange(partitions, key, *order).sortWithinPartitions(key, *order)
    return ranged.withColumn("chunk", F.spark_partition_id()).checkpoint()


def replay(rows: DataFrame, fold: Fold, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with the fold's output columns; rows of a key are taken in ``order``, which must be unique.

    Rows without a key belong to no sequence: their output columns are null. Runs Spark jobs at once: the chunks are written and
    the states between them found before the frame is returned.
    """
    columns = rows.columns
    nameless = rows.filter(F.col(key).isNull()).select(
        *columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(fold.output).fields])
    chunks = range_chunks(rows.filter(F.col(key).isNotNull()), key, order, partitions)
    starts = _boundary_states(chunks, fold, key, order)
    schema = StructType(chunks.drop("chunk").schema.fields + StructType.fromDDL(fold.output).fields)
    decided = chunks.mapInPandas(_decider(fold, key, starts), schema)
    return decided.select(*columns, *StructType.fromDDL(fold.output).names).unionByName(nameless)


def _boundary_states(chunks: DataFrame, fold: Fold, key: str, order: Sequence[str]) -> dict[int, tuple[object, object]]:
    """chunk -> (key, state) for chunks that begin in the middle of a key.

    The driver sees one row per partition here, never the keys' rows.
    """
    edges = chunks.groupBy("chunk").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("chunk").collect()
    runs: dict[object, list[int]] = {}
    for left, right in zip(edges, edges[1:]):
        if left["last"] == right["first"]:
            runs.setdefault(left["last"], [left["chunk"]]).append(right["chunk"])
    if not runs:
        return {}

    # Only keys that span chunks are looked at again, and only the columns that matter: one folder per chunk, so
    # that a round reads no more than the chunks it tries.
    spark, path = chunks.sparkSession, scratch_path(chunks.sparkSession, "replay")
    needed = dict.fromkeys([*order, *fold.columns])
    cut = chunks.filter(F.col(key).isin(list(runs))).select("chunk", F.col(key).alias("k"), *needed)
    cut.write.partitionBy("chunk").parquet(path)
    cut = spark.read.schema(cut.schema).parquet(path)
    begin: dict[tuple[int, object], object] = {}  # (chunk, key) -> start to try
    drift = {}
    if fold.drift() is not None:
        sums = chunks.filter(F.col(key).isin(list(runs))).groupBy("chunk", F.col(key).alias("k")).agg(F.sum(fold.drift()).alias("s"))
        drift = {(r["chunk"], r["k"]): r["s"] for r in sums.collect()}
    for k, run in runs.items():
        guess = fold.start()
        for chunk in run[:-1]:
            begin[chunk, k] = guess
            guess = fold.guess(guess, drift[chunk, k]) if drift else fold.start()

    ends: dict[tuple[int, object], tuple[object, object]] = {}  # (chunk, key) -> (start used, end)
    done = dict.fromkeys(runs, 0)  # leading chunks of a run whose start is known to be right
    starts: dict[int, tuple[object, object]] = {}
    todo, first = begin, True
    while todo:
        wanted = cut.filter(F.col("chunk").isin(sorted({chunk for chunk, _ in todo}))).repartition("chunk")
        for r in wanted.sortWithinPartitions("chunk", "k", *order).mapInPandas(_ender(fold, todo), f"chunk INT, k {_type(chunks, key)}, state STRING").collect():
            ends[r["chunk"], r["k"]] = (todo[r["chunk"], r["k"]], json.loads(r["state"]))
        todo = {}
        for k, run in runs.items():
            state, settled, wrong = fold.start(), 0, []
            for chunk, following in zip(run, run[1:]):
                used, end = ends[chunk, k]
                if used != state:
                    moved = fold.reuse(used, end, state)
                    if moved is None:
                        wrong.append((chunk, state))
                    else:
                        end = moved
                        ends[chunk, k] = (state, end)
                settled += not wrong
                state = fold.carry(end)
                starts[following] = (k, state)
            # Starts behind the first wrong chunk are hopes. As many are tried as the last round's success
            # suggests, so a state that never settles costs no more than reading its chunks in turn.
            hopes = len(wrong) if first else 1 + 2 * (settled - done[k])
            done[k] = settled
            todo.update({(chunk, k): state for chunk, state in wrong[:hopes]})
        first = False
    return starts


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _copy(state):
    return json.loads(json.dumps(state))


def _decider(fold: Fold, key: str, starts: dict[int, tuple[object, object]]):
    names = StructType.fromDDL(fold.output).names

    def run(batches):
        current, state, fresh = None, None, True
        for pdf in batches:
            if not len(pdf):
                continue
            chunk, results = int(pdf["chunk"].iat[0]), []
            given = starts.get(chunk)
            for k, *row in zip(pdf[key].tolist(), *(pdf[c].tolist() for c in fold.columns)):
                if fresh or k != current:
                    state = _copy(given[1]) if fresh and given and given[0] == k else fold.start()
                    current, fresh = k, False
                state, result = fold.step(state, row)
                results.append(result)
            yield pdf.drop(columns="chunk").assign(**dict(zip(names, map(list, zip(*results)))))

    return run


def _ender(fold: Fold, begin: dict[tuple[int, object], object]):
    def run(batches):
        import pandas as pd

        states: dict[tuple[int, object], object] = {}
        for pdf in batches:
            # Sorted rows of one chunk: few keys, each in one piece.
            for (chunk, k), rows in pdf.groupby(["chunk", "k"], sort=False):
                place = (int(chunk), k)
                if place in begin:
                    state = states[place] if place in states else _copy(begin[place])
                    states[place] = fold.advance(state, [rows[c].to_numpy() for c in fold.columns])
        if states:
            yield pd.DataFrame([(c, k, json.dumps(s)) for (c, k), s in states.items()], columns=["chunk", "k", "state"])

    return run
