"""Intermediate tables below the shared folder: what one step wrote, the next one reads, whichever executors are lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from abacist.session import scratch_path


class Tables:
    """Written tables of one run; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, scratch_path(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
