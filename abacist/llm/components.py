"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.tables import Tables


def _print(edges: DataFrame) -> tuple:
    """Tells edge sets apart: their number and a sum over their hashes."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b).

    Each step links nodes to the smallest neighbour and writes the shorter paths as a table; nothing but a count reaches the
    driver. Smallest neighbours are aggregated before the shuffle and written first, so the join with them splits a busy node.
    """
    now = tables.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                      f"{name}-0")
    seen, step = _print(now), 0
    while seen[0]:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-{step}l")
        large = tables.save(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .distinct(), f"{name}-{step}m")
        least = tables.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{step}s")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b")))
        after = tables.save(small.distinct(), f"{name}-{step}")
        tables.drop(f"{name}-{step}l", f"{name}-{step}m", f"{name}-{step}s")
        tables.drop(f"{name}-{step - 1}")
        before, seen, now = seen, _print(after), after
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
