"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only in local mode, as in tests, a local one is made where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftmark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the program ends."""
    root = f"{shared_dir(spark)}/driftmark-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends here, and what is not deterministic in it is fixed."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Written tables that a loop needs for a while: `with Shelf(spark, name) as shelf`, gone at the end of it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_path(spark, name)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *below: str) -> None:
        """Delete one of the tables, or all of them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *below]))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
