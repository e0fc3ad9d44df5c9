"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often (or within whichever lambda) ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str, *others: DataFrame) -> str:
    """``name``, or with underscores before it until no column has it."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def total(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)
