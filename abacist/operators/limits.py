"""Request limits: fixed windows and per-user admission."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.operators.folds import Fold, replay

PER_WINDOW = 10


def fixed_window_limit(requests: DataFrame, client: str = "client", limit: int = PER_WINDOW,
                       width: str = "1 minute") -> DataFrame:
    """Adds ``window_start`` and ``allowed``: the first ``limit`` requests of a client per window pass.

    Only the first ``limit`` rows of each window are ranked (the rank filter runs before the shuffle);
    every other row is judged against the last of them, so a crowded window is never sorted as a whole. A row
    without client or time belongs to no window and has no verdict (null).
    """
    nowhere = requests.where(F.col(client).isNull() | F.col("ts").isNull())
    rows = requests.where(F.col(client).isNotNull()).withColumn("window_start", F.window("ts", width).getField("start"))
    first = Window.partitionBy(client, "window_start").orderBy("ts", "id")
    cut = (rows.select(client, "window_start", "ts", "id").withColumn("rn", F.row_number().over(first))
           .filter(F.col("rn") <= limit).groupBy(client, "window_start").agg(F.max(F.struct("ts", "id")).alias("cut")))
    judged = (rows.join(cut, [client, "window_start"])
              .withColumn("allowed", F.struct("ts", "id") <= F.col("cut")).drop("cut"))
    return judged.unionByName(nowhere.withColumns({"window_start": F.lit(None).cast(rows.schema["window_start"].dataType),
                                                   "allowed": F.lit(None).cast("boolean")}).select(*judged.columns))


# Limits per user, and the wait named when one is hit.
QUERIES_PER_MINUTE, QUERIES_PER_HOUR, SESSIONS_PER_DAY = 10, 100, 5
MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000  # microseconds


class Admission(Fold):
    """State: times (microseconds) of the accepted queries of the last hour and sessions of the last day."""

    columns = ("action", "ts_us")
    output = "allowed BOOLEAN, violations STRING, retry_after_seconds BIGINT"

    def start(self):
        return [[], []]

    @staticmethod
    def _forget(state, now):
        queries, sessions = state
        while queries and now - queries[0] >= HOUR:
            queries.pop(0)
        while sessions and now - sessions[0] >= DAY:
            sessions.pop(0)

    def advance(self, state, columns):
        """Refused rows leave no trace, so it is enough to visit those that may be admitted: a few hundred an hour."""
        action, times = columns
        if not len(times):
            return state
        query_at, session_at = np.flatnonzero(action == "query"), np.flatnonzero(action == "session_start")

        def following(places, i):
            j = np.searchsorted(places, i)
            return int(places[j]) if j < len(places) else len(times)

        i = 0
        while i < len(times):
            state, (allowed, _, _) = self.step(state, (action[i], int(times[i])))
            queries, sessions = state
            free = queries[0] + HOUR if len(queries) >= QUERIES_PER_HOUR else 0
            if len(queries) >= QUERIES_PER_MINUTE:
                free = max(free, queries[-QUERIES_PER_MINUTE] + MINUTE)
            if allowed:
                i += 1
            elif free > times[i]:
                i = int(np.searchsorted(times, free))
            else:
                i = min(following(query_at, i + 1), following(session_at, max(i + 1, np.searchsorted(times, sessions[0] + DAY))))
        self._forget(state, int(times[-1]))
        return state

    def step(self, state, row):
        action, now = row
        self._forget(state, now)
        queries, sessions = state
        violations, wait = [], 0
        if len(queries) >= QUERIES_PER_MINUTE and now - queries[-QUERIES_PER_MINUTE] < MINUTE:
            violations.append("queries_per_minute")
            wait = 60
        if len(queries) >= QUERIES_PER_HOUR:
            violations.append("queries_per_hour")
            wait = 3600
        if action == "session_start" and len(sessions) >= SESSIONS_PER_DAY:
            violations.append("sessions_per_day")
            wait = 86_400 - (now - sessions[0]) // 1_000_000
        if not violations:
            if action == "query":
                queries.append(now)
            elif action == "session_start":
                sessions.append(now)
        return state, (not violations, ",".join(violations), wait)


def rate_limit_admission(actions: DataFrame) -> DataFrame:
    """Decision for each action (user_id, id, action, ts) in time order; only admitted actions count later."""
    rows = actions.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return replay(rows, Admission(), key="user_id", order=["ts_us", "id"]).drop("ts_us")
