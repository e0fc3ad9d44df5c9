"""Typed readers: every table is loaded with its declared schema and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.schemas import DEFAULTS, schema


def read(spark: SparkSession, table: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table from files (parquet, orc, json, csv) with the declared schema; nothing is inferred."""
    return conform(spark.read.format(fmt).schema(schema(table)).options(**options).load(path), table)


def read_jdbc(spark: SparkSession, table: str, url: str, split_on: str | None = None, lower: str | None = None,
              upper: str | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table from a database; with ``split_on`` the read is cut into ``parts`` ranges, one per task."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on is not None:
        reader = reader.options(partitionColumn=split_on, lowerBound=lower, upperBound=upper, numPartitions=str(parts))
    return conform(reader.load(), table)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; absent ones and nulls take the declared default."""
    defaults = DEFAULTS.get(table, {})
    columns = []
    for field in schema(table).fields:
        column = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            column = F.coalesce(column, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the setting ``spark.abacist.textPartitions`` says; untouched where it is not set.

    For processor-bound work on whole texts of an input with few splits; set it only where such a shuffle pays.
    """
    wanted = df.sparkSession.conf.get("spark.abacist.textPartitions", None)
    return df.repartition(int(wanted)) if wanted else df
