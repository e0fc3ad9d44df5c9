"""Writers: keyed upsert, snapshots and range export; appends and updates in place are in ``commits``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.schemas import DEFAULTS


def latest(changes: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """Per key the change with the latest ``newest``; of several, the greatest by its columns in order.

    The rank filter runs before the shuffle, so a key changed very often sends one row per input partition.
    """
    ties = [F.col(c).desc() for c, kind in changes.dtypes if c != newest and c not in keys and not kind.startswith("map")]
    order = Window.partitionBy(*keys).orderBy(F.col(newest).desc(), *ties)
    return changes.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == 1).drop("rn")


def update(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], newest: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot after changes of its own rows, and the changes of rows it does not have, with a ``reject_reason``."""
    known = snapshot.select(*keys).distinct()
    accepted = changes.join(known, list(keys), "left_semi")
    refused = changes.join(known, list(keys), "left_anti").withColumn("reject_reason", F.lit("not found"))
    return upsert(snapshot, accepted, keys, newest), refused


def upsert(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], newest: str, table: str | None = None) -> DataFrame:
    """The snapshot after the changes: per key the change with the latest ``newest``, else the old row.

    Changes may lack columns: old rows keep theirs, new ones take the declared defaults of ``table``.
    """
    last = latest(changes, keys, newest)
    kept = [c for c in snapshot.columns if c not in changes.columns]
    defaults = DEFAULTS.get(table, {})
    joined = snapshot.withColumn("old", F.lit(True)).alias("s").join(last.withColumn("new", F.lit(True)).alias("c"), list(keys), "full_outer")
    columns = []
    for c in snapshot.columns:
        if c in kept and c in defaults:
            columns.append(F.when(F.col("old"), F.col(c)).otherwise(F.lit(defaults[c])).alias(c))
        elif c in keys or c in kept:
            columns.append(F.col(c))
        else:
            columns.append(F.when(F.col("new"), F.col(f"c.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return joined.select(*columns)


def write_snapshot(rows: DataFrame, path: str, as_of: datetime) -> None:
    """A whole table as of a time, in a folder of its own: the table it was derived from stays readable, and a
    job that runs again replaces its own result only.
    """
    rows.write.mode("overwrite").parquet(_snapshot(path, as_of))


def read_snapshot(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    return spark.read.parquet(_snapshot(path, as_of))


def _snapshot(path: str, as_of: datetime) -> str:
    return f"{path}/as_of={as_of:%Y-%m-%dT%H-%M-%S}"


def export(rows: DataFrame, path: str, fmt: str = "json", time_column: str = "timestamp") -> None:
    """Write an export partitioned by the date of its ISO time column; dates that the rows do not have stay as they are."""
    dated = rows.withColumn("date", F.substring(time_column, 1, 10)).write.mode("overwrite").partitionBy("date")
    dated.option("partitionOverwriteMode", "dynamic").format(fmt).save(path)
