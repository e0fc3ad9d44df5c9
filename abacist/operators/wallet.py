"""Coins, the ledger and paid sessions."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions.timing import at, seconds_between
from abacist.operators.folds import Fold, range_chunks, replay

# Package id -> (price, coins).
PACKAGES = {1: (7, 15), 2: (14, 35), 3: (21, 75)}
SESSION_COST, SESSION_MINUTES = 4, 60


def package_lookup(purchases: DataFrame) -> DataFrame:
    """Adds ``price`` and ``coins``; an unknown package gets a ``reject_reason``."""
    table = F.create_map(*(F.lit(x) for i, (price, coins) in PACKAGES.items()
                           for x in (i, F.struct(F.lit(price).alias("price"), F.lit(coins).alias("coins")))))
    found = F.try_element_at(table, F.col("package_id").cast("int"))
    return (purchases.withColumn("price", found.getField("price").cast("bigint"))
            .withColumn("coins", found.getField("coins").cast("bigint"))
            .withColumn("reject_reason", F.when(F.col("price").isNull(), "unknown package")))


def live_sessions(ai_sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Sessions that are active and not yet expired."""
    return ai_sessions.filter(F.col("is_active") & (F.col("expires_at") > at(ai_sessions, "expires_at", as_of)))


def active_session(ai_sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Per user the live session that expires last, with the minutes left."""
    best = F.max_by(F.struct("id", "expires_at"), F.struct("expires_at", "id"))
    return (live_sessions(ai_sessions, as_of).groupBy("user_id").agg(best.alias("s"))
            .select("user_id", F.col("s.id").alias("session_id"), F.col("s.expires_at").alias("expires_at"))
            .withColumn("remaining_minutes", F.greatest(
                F.lit(0.0), seconds_between("expires_at", F.lit(as_of)) / 60)))


def session_status(users: DataFrame, ai_sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Minutes left for every user (id), 0 without a live session."""
    live = active_session(ai_sessions, as_of).select("user_id", "session_id", "remaining_minutes")
    return users.select(F.col("id").alias("user_id")).join(live, "user_id", "left").select(
        "user_id", "session_id", F.coalesce("remaining_minutes", F.lit(0.0)).alias("remaining_minutes"))


def active_sessions_gauge(ai_sessions: DataFrame, as_of: datetime) -> DataFrame:
    return live_sessions(ai_sessions, as_of).agg(F.count(F.lit(1)).alias("active_sessions"))


def valid_login_links(sessions: DataFrame, as_of: datetime, token: str | None = None) -> DataFrame:
    """Login links that have not expired, all of them or the one with ``token``."""
    valid = sessions.filter(F.col("expires_at") > at(sessions, "expires_at", as_of))
    return valid if token is None else valid.filter(F.col("token") == token)


def wallet_recent(users: DataFrame, coins: DataFrame, transactions: DataFrame, recent: int = 10) -> DataFrame:
    """Per user the balance (0 without a record) beside each of the latest ``recent`` transactions.

    Long form; a user without transactions keeps one row.
    """
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "id")
    last = (transactions.select("user_id", F.col("id").alias("id"), "type", "amount", "description", "created_at")
            .withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= recent))
    return (users.select(F.col("id").alias("user_id"))
            .join(coins.select("user_id", "balance"), "user_id", "left").join(last, "user_id", "left")
            .withColumn("balance", F.coalesce("balance", F.lit(0).cast("bigint"))))


class _Budget(Fold):
    """State [balance, down, up, ...]: decisions stay the same while the start moves by -down <= shift < up."""

    def drift(self):
        return F.col("drift")

    def start(self):
        return [0, None, None]

    def guess(self, start, total):
        return [max(0, start[0] + int(total)), None, None, *start[3:]]

    def carry(self, end):
        return [end[0], None, None, *end[3:]]

    def reuse(self, old_start, end, new_start):
        shift = new_start[0] - old_start[0]
        if old_start[3:] != new_start[3:] or (end[1] is not None and shift < -end[1]) or (
                end[2] is not None and shift >= end[2]):
            return None
        return [end[0] + shift, None if end[1] is None else end[1] + shift, None if end[2] is None else end[2] - shift, *end[3:]]

    @staticmethod
    def pay(state, amount) -> bool:
        """Take ``amount`` if the balance allows it, noting how close the decision was."""
        left = state[0] - amount
        if left >= 0:
            state[0], state[1] = left, left if state[1] is None else min(state[1], left)
            return True
        state[2] = -left if state[2] is None else min(state[2], -left)
        return False


class Ledger(_Budget):
    columns = ("amount",)
    output = "accepted BOOLEAN, balance_after BIGINT"

    def step(self, state, row):
        amount = int(row[0])
        if amount >= 0:
            state[0] += amount
            accepted = True
        else:
            accepted = self.pay(state, -amount)
        return state, (accepted, state[0])


def ledger_replay(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Credits and debits (user_id, id, amount, ts) in time order from a balance of 0.

    A debit passes only if the balance covers it; a refused one changes nothing. An opening balance is a
    credit dated before the first event.
    """
    rows = events.withColumn("drift", F.col("amount"))
    return replay(rows, Ledger(), key="user_id", order=["ts", "id"], partitions=partitions).drop("drift")


class Sessions(_Budget):
    """Adds to the budget the live session: [.., expiry in microseconds, session id]."""

    columns = ("kind", "amount", "ts_us", "id")
    output = "outcome STRING, session_id STRING, expires_us BIGINT, balance_after BIGINT"
    length = SESSION_MINUTES * 60_000_000

    def start(self):
        return [0, None, None, 0, None]

    def advance(self, state, columns):
        """Starts during a live session and refusals change nothing, so only payments and credits are visited."""
        kind, amount, times, event = columns
        is_credit = kind == "credit"
        earned = np.concatenate([[0], np.cumsum(np.where(is_credit, amount, 0))])
        credit_at, other_at, extend_at = (np.flatnonzero(x) for x in (is_credit, ~is_credit, kind == "extend"))

        def following(places, i):
            j = np.searchsorted(places, i)
            return int(places[j]) if j < len(places) else len(times)

        i = 0
        while i < len(times):
            if is_credit[i]:
                after, stop = i, following(other_at, i)
            else:
                state, (outcome, *_) = self.step(state, (kind[i], int(amount[i]), int(times[i]), event[i]))
                after = stop = i + 1
                if outcome == "live":
                    stop = min(following(extend_at, after), max(after, int(np.searchsorted(times, state[3]))))
                elif outcome == "rejected":
                    stop = following(credit_at, after)
            state[0] += int(earned[stop] - earned[after])
            i = stop
        return state

    def step(self, state, row):
        kind, amount, now, event = row
        live = state[3] > now
        if kind == "credit":
            state[0] += int(amount)
            outcome = "credited"
        elif kind == "start" and live:
            outcome = "live"
        elif not self.pay(state, SESSION_COST):
            outcome = "rejected"
        elif kind == "extend" and live:
            state[3] += self.length
            outcome = "extended"
        else:
            state[3], state[4] = now + self.length, event
            outcome = "opened"
        named = outcome in ("live", "extended", "opened")
        return state, (outcome, state[4] if named else None, state[3] if named else 0, state[0])


def session_replay(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Paid sessions (user_id, id, kind start/extend/credit, amount, ts) in time order from a balance of 0.

    A start returns the live session free of charge, else pays for a new one; an extension always pays and
    opens a session when none is live. Outcomes: live, opened, extended, rejected, credited.
    """
    rows = (events.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
            .withColumn("drift", F.when(F.col("kind") == "credit", F.col("amount")).otherwise(F.lit(0).cast("bigint"))))
    done = replay(rows, Sessions(), key="user_id", order=["ts_us", "id"], partitions=partitions)
    return done.withColumn("expires_at", F.when(F.col("expires_us") > 0, F.timestamp_micros("expires_us"))).drop(
        "ts_us", "drift", "expires_us")


def ledger_balance(transactions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``balance``, the running sum per user in (created_at, id) order.

    Rows are range-partitioned by (user, time), so a busy user fills many chunks. The chunks' totals, a few
    rows per user, are summed first; rows are then summed within their chunk only.
    """
    rows = range_chunks(transactions, "user_id", ["created_at", "id"], partitions)
    totals = rows.groupBy("user_id", "chunk").agg(F.sum("amount").alias("total"))
    earlier = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select("user_id", "chunk", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("opening"))
    within = Window.partitionBy("user_id", "chunk").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(opening, ["user_id", "chunk"])
            .withColumn("balance", F.col("opening") + F.sum("amount").over(within)).drop("chunk", "opening"))


def reconcile(coins: DataFrame, transactions: DataFrame) -> DataFrame:
    """Users whose recorded balance differs from the sum of their ledger rows (either side missing counts as 0)."""
    ledger = transactions.groupBy("user_id").agg(F.sum("amount").alias("ledger_balance"))
    both = coins.select("user_id", F.col("balance").alias("recorded_balance")).join(ledger, "user_id", "full_outer")
    both = both.select("user_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("recorded_balance", "ledger_balance")))
    return both.filter(F.col("recorded_balance") != F.col("ledger_balance")).withColumn(
        "difference", F.col("recorded_balance") - F.col("ledger_balance"))
