"""Intermediate tables of one operator run, in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cuesheet.session import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage; each can be dropped once nothing reads it any more.

    The shuffle files of the job that writes a table are removed with the job's end: the
    table has taken their place, and a lost executor is answered by reading it again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/cuesheet/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        path = self.path(table)
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._kept_at = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables made by ``keep``; nothing may read them afterwards."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._kept_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
