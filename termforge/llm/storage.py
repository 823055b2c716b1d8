"""Shared scratch tables, used to cut lineage between the steps of a job.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where
that setting is missing (unit tests on one machine) a local folder is set.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "termforge-checkpoints")
    sc.setCheckpointDir(own)
    return own


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from every column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Scratch:
    """Tables written once to the shared folder and read back as plain scans."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/termforge-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count:03d}"
        self.count += 1
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def discard(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let the driver drop the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()
