"""Scheduled jobs as snapshot-to-snapshot transformations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions.timing import at, on_day
from abacist.sources import sinks

GRANT = 4
#: Description of the ledger rows of grants on reading.
ON_READ = "Daily free coins granted"
GRANT_COLUMN = "free_daily_coins_last_grant_date"


def users_without_grant(users: DataFrame, coins: DataFrame, as_of: datetime) -> DataFrame:
    """Users (id) without a grant on the day of ``as_of``."""
    granted = coins.filter(on_day(coins, GRANT_COLUMN, as_of)).select(F.col("user_id").alias("id"))
    return users.select("id").join(granted, "id", "left_anti")


def daily_grant(users: DataFrame, coins: DataFrame, as_of: datetime) -> DataFrame:
    """The next coins snapshot, with ``granted``: users without today's grant get 4 coins and today's date.

    One full outer join serves both outputs; running it again on its own result grants nothing.
    """
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("is_user"))
    joined = known.join(coins, "user_id", "full_outer")
    has_today = F.coalesce(on_day(coins, GRANT_COLUMN, as_of), F.lit(False))
    granted = F.coalesce(F.col("is_user"), F.lit(False)) & ~has_today
    balance = F.coalesce("balance", F.lit(0).cast("bigint"))
    return joined.withColumn("granted", granted).withColumns({
        "balance": F.when(F.col("granted"), balance + GRANT).otherwise(balance),
        GRANT_COLUMN: F.when(F.col("granted"), at(coins, GRANT_COLUMN, as_of)).otherwise(F.col(GRANT_COLUMN)),
    }).drop("is_user")


def grant_ledger(granted: DataFrame, as_of: datetime, description: str = "Daily free coins") -> DataFrame:
    """Ledger rows of ``daily_grant``; the id follows from user and day, so a rerun writes the same rows."""
    day = as_of.strftime("%Y-%m-%d")
    return granted.filter("granted").select(
        F.concat(F.lit(f"grant-{day}-"), "user_id").alias("id"), "user_id", F.lit("free_grant").alias("type"),
        F.lit(GRANT).cast("bigint").alias("amount"), F.lit(description).alias("description"),
        F.lit(as_of).alias("created_at"))


def run_daily_grant(users: DataFrame, coins: DataFrame, coins_path: str, ledger_path: str, as_of: datetime) -> DataFrame:
    """Write the next coins snapshot and the day's ledger rows; returns the number of grants.

    The ledger is taken from the snapshot just written, so the join runs once and both agree even if the job
    is restarted in between.
    """
    sinks.write_snapshot(daily_grant(users, coins, as_of), coins_path, as_of)
    written = sinks.read_snapshot(users.sparkSession, coins_path, as_of)
    sinks.write_snapshot(grant_ledger(written, as_of), ledger_path, as_of)
    return written.agg(F.count_if("granted").alias("granted_to_users"))


def run_delete_old_chats(chats: DataFrame, path: str, as_of: datetime, days: int = 7) -> DataFrame:
    """Write the chats that stay as the next snapshot; returns the number of deleted ones."""
    sinks.write_snapshot(delete_old_chats(chats, as_of, days), path, as_of)
    return count_old_chats(chats, as_of, days)


def grant_on_read(readers: DataFrame, coins: DataFrame, as_of: datetime) -> DataFrame:
    """The twin that runs when wallets are read: a grant where the last one was before today or never.

    ``readers`` (id) without a record get one, with the grant; records of others stay as they are. ``grant_ledger`` makes
    the ledger rows, with ON_READ as their description.
    """
    start = datetime(as_of.year, as_of.month, as_of.day)
    reads = readers.select(F.col("id").alias("user_id")).distinct().withColumn("reads", F.lit(True))
    due = F.coalesce("reads", F.lit(False)) & F.coalesce(F.col(GRANT_COLUMN) < at(coins, GRANT_COLUMN, start), F.lit(True))
    balance = F.coalesce("balance", F.lit(0).cast("bigint"))
    return coins.join(reads, "user_id", "full_outer").withColumn("granted", due).withColumns({
        "balance": F.when(F.col("granted"), balance + GRANT).otherwise(balance),
        GRANT_COLUMN: F.when(F.col("granted"), at(coins, GRANT_COLUMN, as_of)).otherwise(F.col(GRANT_COLUMN))}).drop("reads")


def delete_old_chats(chats: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """The chats to keep; rows without a time stay."""
    return chats.filter(~_old(chats, as_of, days))


def count_old_chats(chats: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return chats.agg(F.count_if(_old(chats, as_of, days)).alias("deleted_chats"))


def _old(chats: DataFrame, as_of: datetime, days: int):
    return F.coalesce(F.col("created_at") < at(chats, "created_at", as_of - timedelta(days=days)), F.lit(False))
