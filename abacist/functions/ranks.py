"""Exact order statistics by radix selection: no sort of the values, and none of them leaves its task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the three digits of a 64-bit number, the highest one first; a histogram has at most 2 ** 22 bins.
DIGITS = (22, 21, 21)
_LOW = 0x7FFFFFFFFFFFFFFF


def ordered(value: Column) -> Column:
    """A double (null as 0) as a signed 64-bit number of the same order (-0.0 as 0.0, NaN above all): its bits, those of negative values flipped but for the sign."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOW))).otherwise(bits)


def _chosen(rows: DataFrame, shift: int, bits: int, rank: Column) -> DataFrame:
    """One row ``at``: the digit under which the value of this rank lies, the rank among the values of that digit, and one of them.

    ``rank`` may use ``n``, the number of rows. Counts by digit are merged before they are shuffled; their prefix sums choose.
    """
    digit = F.shiftright("key", shift)
    digit = digit if shift + bits == 64 else digit.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    bins = rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("c"), F.min("v").alias("v"))
    listed = bins.agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("digit", "c", "v"))).alias("bins")) \
        .withColumn("rank", rank.cast("long"))
    start = F.struct(F.col("rank").alias("rank"), F.lit(None).cast("long").alias("digit"), F.lit(None).cast("double").alias("v"))

    def step(state: Column, x: Column) -> Column:
        here = state["digit"].isNull() & (state["rank"] < x["c"])
        passed = F.when(state["digit"].isNull() & ~here, state["rank"] - x["c"]).otherwise(state["rank"])
        return F.struct(passed.alias("rank"), F.when(here, x["digit"]).otherwise(state["digit"]).alias("digit"),
                        F.when(here, x["v"]).otherwise(state["v"]).alias("v"))

    return listed.select(F.aggregate("bins", start, step).alias("at"))


def quantile_element(values: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row ``value`` = ``sorted(column)[int(n * fraction)]``; null when there is no value.

    Three passes, one for each digit: each counts the values that agree in the digits chosen before by their next digit.
    """
    v = F.col(column).cast("double")
    rows = values.select(v.alias("v"), ordered(v).alias("key")).where("v is not null")
    rank, at, shift = F.least(F.floor(F.col("n") * F.lit(fraction)), F.col("n") - 1), None, 64
    for bits in DIGITS:
        shift -= bits
        at = _chosen(rows, shift, bits, rank)
        chosen = at.scalar()
        digit = F.shiftright("key", shift)
        digit = digit if shift + bits == 64 else digit.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        rows, rank = rows.where(digit == chosen["digit"]), chosen["rank"]
    return at.select(F.col("at.v").alias("value"))
