"""Shared-folder tables that cut lineage between iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local session alone may do without and gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Parquet tables below the checkpoint folder, so a lost executor costs only the running step."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._evidex_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._evidex_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
