"""Shared scratch space for operators of several passes.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which every
executor of a cluster can read; a lost executor therefore costs the tasks that it
ran and nothing that was already written.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one for a session in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loreloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes that go to a Python worker at a time and rows that a scan decodes at a time, and Spark's defaults that they take the place of.
_SMALL = {
    "spark.sql.execution.arrow.maxBytesPerBatch": (2 << 20, (f"{64 << 20}", f"{64 << 20}b", "64m", "64MB")),
    "spark.sql.parquet.columnarReaderBatchSize": (1024, ("4096",)),
}


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python by 2 MB and decode 1,024 at a time, as texts are long; a size that somebody has set stays.

    A larger batch is a larger block of the executor's heap, of its memory outside the heap, and of the worker's.
    """
    for key, (size, defaults) in _SMALL.items():
        if spark.conf.get(key) in defaults:
            spark.conf.set(key, str(size))


class Scratch:
    """Tables of one run of an operator, each written once and read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return what was written."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._loreloom_path = where
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        where = getattr(df, "_loreloom_path", None)
        if where:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(where)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
