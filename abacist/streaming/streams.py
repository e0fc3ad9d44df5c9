"""Live forms: chat moderation, admission, tokens per minute and daily active users.

Builders take a streaming DataFrame and return one; writers start a query whose sinks can be rewritten
batch by batch, so a batch that runs again after a failure leaves the same files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from abacist.operators import safety
from abacist.operators.limits import Admission


def start(stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Start ``stream`` into ``write_batch``; ``once`` takes what is there now, in as many batches as needed, and stops."""
    writer = stream.writeStream.foreachBatch(write_batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def batch_folder(path: str, reduce: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per batch, of the batch or what ``reduce`` makes of it: a repeated batch overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        (reduce(batch) if reduce else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def moderation_sink(approved: str, incidents: str) -> Callable[[DataFrame, int], None]:
    """Approved messages and incidents of one moderated batch, from one pass over it."""
    def write(batch: DataFrame, number: int) -> None:
        # Judged once and kept for both sinks; the batch's rows are spilled, not recomputed.
        judged = safety.moderate(batch).persist()
        try:
            judged.filter("approved").drop("violations", "severity_score", "is_safe", "recommendations", "approved", "verdict") \
                .write.mode("overwrite").parquet(f"{approved}/batch={number}")
            safety.incidents_of(judged).write.mode("overwrite").parquet(f"{incidents}/batch={number}")
        finally:
            judged.unpersist()

    return write


#: Rows of a user that are judged at once.
PIECE = 10_000


def in_time_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A user's rows (id, action, ts_us) sorted, a piece at a time; until then they stay in Arrow, a few dozen bytes each."""
    types = {"id": pa.large_string(), "action": pa.large_string(), "ts_us": pa.int64()}
    parts = {name: [] for name in types}
    for pdf in batches:
        for name, kind in types.items():
            parts[name].append(pa.Array.from_pandas(pdf[name], type=kind))
    rows = pa.table({name: pa.concat_arrays(parts.pop(name)) for name in types})
    order = pc.sort_indices(rows, sort_keys=[("ts_us", "ascending"), ("id", "ascending")])
    for at in range(0, len(order), PIECE):
        yield rows.take(order[at:at + PIECE]).to_pandas()


def admission(actions: DataFrame) -> DataFrame:
    """Decisions for a stream of actions (user_id, id, action, ts) with the batch operator's rules.

    Every action gets a decision, however late: there is no watermark behind which rows are dropped. State per user: the
    accepted times of the last hour and day, of which the rules allow a fixed number; it is kept, as a state that is dropped by
    event time needs a watermark. Actions are taken in time order within a batch; one that arrives behind an accepted action is
    judged on arrival.
    """
    fold = Admission()

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = json.loads(state.get[0]) if state.exists else fold.start()
        for rows in in_time_order(batches):
            results = []
            for row in zip(rows["action"], rows["ts_us"].tolist()):
                current, result = fold.step(current, row)
                results.append(result)
            allowed, violations, wait = zip(*results)
            yield pd.DataFrame({"user_id": key[0], "id": rows["id"].to_numpy(), "action": rows["action"].to_numpy(),
                                "allowed": allowed, "violations": violations, "retry_after_seconds": wait})
        state.update((json.dumps(current),))

    timed = actions.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return timed.groupBy("user_id").applyInPandasWithState(
        judge, "user_id STRING, id STRING, action STRING, " + Admission.output, "state STRING", "append",
        GroupStateTimeout.NoTimeout)


def tokens_per_minute(model_metrics: DataFrame) -> DataFrame:
    """minute, user_id, value of the token metrics; ``partial_tokens`` sums a batch, ``sum_tokens`` what all batches wrote."""
    used = model_metrics.filter(F.col("metric_type") == "token_usage")
    return used.select(F.date_trunc("MINUTE", F.col("collected_at").cast("timestamp")).alias("minute"),
                       F.get_json_object("metadata_json", "$.user_id").alias("user_id"), "value")


def partial_tokens(batch: DataFrame) -> DataFrame:
    """Sums of one batch. Added up when read, so a row counts however late it comes, and no state is kept."""
    return batch.groupBy("minute", "user_id").agg(F.sum("value").alias("tokens"))


def sum_tokens(written: DataFrame) -> DataFrame:
    return written.groupBy("minute", "user_id").agg(F.sum("tokens").alias("tokens"))


def daily_users(ai_sessions: DataFrame) -> DataFrame:
    """date, user_id of every session; ``sightings`` keeps one of each in a batch, ``count_daily_users`` counts over all."""
    return ai_sessions.select(F.date_format(F.col("started_at").cast("timestamp"), "yyyy-MM-dd").alias("date"), "user_id")


def sightings(batch: DataFrame) -> DataFrame:
    return batch.distinct()


def count_daily_users(written: DataFrame) -> DataFrame:
    return written.groupBy("date").agg(F.countDistinct("user_id").alias("active_users"))
