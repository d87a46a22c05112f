"""Tables that an operator writes between its steps, in the folder all executors share.

A written table cuts lineage: after the loss of an executor, Spark rereads the table
instead of running every earlier step again.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one, on a local master alone: elsewhere executors don't share it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own[app]


class Spool:
    """The written tables of one call of an operator, below a folder of its own. Results are lazy and read them, so they
    are deleted when the application ends, or by ``discard``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return the frame that reads it back."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        self.keep_until_end()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_until_end(self) -> None:
        """Let the file system delete the folder when the application ends."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(p)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession) -> None:
    """Delete the tables of all calls so far. Their results are lazy and read them: write results first."""
    while _roots:
        _delete(spark, _roots.pop())


def settle(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished steps now, not when the driver's heap happens to fill."""
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of what ``df`` reads; 0 where it has none."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 60 else 0


def parts_for(df: DataFrame, mb_each: int = 8, most: int = 50_000) -> int:
    """How many partitions to deal rows out to, in proportion to the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(least, -(-input_bytes(df) // (mb_each << 20))))
