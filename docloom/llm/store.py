"""Intermediate tables in the folder that driver and executors share.

Long lineages are cut by writing a Parquet table below ``spark.checkpoint.dir``
and reading it back: a lost executor then costs a re-read, not a recomputation,
and nothing lives on one machine only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.settled import shared_dir


class Workspace:
    """Named intermediate tables of one run, each under a fresh path."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables whose readers have all been materialised."""
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
