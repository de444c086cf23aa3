"""What the operators share: intermediate tables in the shared folder, reading of tables, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files: Spark deletes them as each execution ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Intermediate tables of one call: written once, so that lineage ends there and a lost executor costs no more than its own tasks.

    A result may read them until the program ends, so the folder is deleted then, or by `release` once results are written.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/driftmark-{name}-{uuid.uuid4().hex}"
        path, fs = self._path()
        fs.deleteOnExit(path)
        Scratch.made.append(self)

    def _path(self, *below: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *below]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it again."""
        path = f"{self.root}/{name}"
        # the table is read from now on, its shuffles are not
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path, fs = self._path(name)
            fs.delete(path, True)

    @staticmethod
    def release(since: int = 0) -> None:
        """Delete the folders made after the first `since` ones; what reads them has to be written by then."""
        for scratch in Scratch.made[since:]:
            path, fs = scratch._path()
            fs.delete(path, True)
        del Scratch.made[since:]


def bounded_sample(df: DataFrame, rows: int, *key: Column | str) -> DataFrame:
    """At most `rows` rows, those with the least hash of the key, ties by the key itself. Hashes that cannot be among them are left out first,
    so that about twice as many rows, and not as many from each partition, meet for the choice."""
    n, place = df.count(), F.shiftrightunsigned(F.xxhash64(F.lit(1), *key), 32)
    if n > 4 * rows:
        df = df.where(place < int(2**32 * (2 * rows + 100) / n))
    return df.orderBy(place, *key).limit(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """Lower-case A-Z only. The built-in lower() does just that for pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without copying, and the offset of each text in them (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has about `most` bytes of text (one longer text makes a slice of its own)."""
    for batch in batches:
        at = utf8_parts(batch.column(column))[1]
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def partitions_for(df: DataFrame, mb: float) -> int:
    """Partitions so that each has about `mb` MB of the tables that df reads, and at least as many as the session shuffles into.

    Rows that the program gave have no known size and count by their partitions.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size, given = 0, 0
    for leaf in map(leaves.apply, range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            given += leaf.rdd().getNumPartitions()
        else:
            size += int(str(leaf.stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // int(mb * 1e6)) + given, 1_000_000))


def binary_rows(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[begins[i]:begins[i + 1]]; the last one goes to the end."""
    width = values.dtype.itemsize
    offsets = np.r_[begins, len(values)].astype(np.int64) * width
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
