"""Time helpers that keep filters on bare columns, so parquet can skip row groups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def at(df: DataFrame, column: str, when: datetime) -> Column:
    """``when`` as a literal of the column's own timestamp type; the column itself is never cast."""
    return F.lit(when).cast(df.schema[column].dataType)


def since(df: DataFrame, column: str, as_of: datetime, days: int) -> Column:
    return F.col(column) >= at(df, column, as_of - timedelta(days=days))


def on_day(df: DataFrame, column: str, day: datetime) -> Column:
    """Rows of one calendar day, written as a range rather than ``to_date(column) = day``."""
    start = datetime(day.year, day.month, day.day)
    return (F.col(column) >= at(df, column, start)) & (F.col(column) < at(df, column, start + timedelta(days=1)))


def day_of(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def micros(column) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) if isinstance(column, str) else F.unix_micros(
        column.cast("timestamp"))


def seconds_between(later, earlier) -> Column:
    """Elapsed seconds with the fraction kept."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def iso(column: str) -> Column:
    return F.date_format(column, ISO)
