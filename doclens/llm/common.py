"""What several operators of this subpackage need."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set a local master gets a temporary one (tests); on a cluster
    this raises, as each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Steps:
    """Tables that one operator writes on its way: they cut lineage and outlive executors.

    A table goes once what was made of it is stored, so that the shared folder
    holds what later steps read and no more.  What is lost after that is made
    again from the tables that are left.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The rows of df, written once to the shared folder and read back; `by` keeps the rows of each of its values apart."""
        path = f"{shared_dir(self.spark)}/step-{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            writer = df.write.partitionBy(by) if by else df.write
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, which nothing reads any more."""
        for t in tables:
            _, path = self.paths.pop(id(t))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*[t for t, _ in list(self.paths.values()) if id(t) not in kept])


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a query go when the query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back; the table stays."""
    return Steps(df.sparkSession).written(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int = 1000):
    """The batches of a task in smaller parts, so that what is made of one part is gone before the next.

    Workers outlive their tasks; at a task's end what it has freed goes back to the system.
    """
    try:
        for pdf in batches:
            for begin in range(0, len(pdf), rows):
                yield pdf.iloc[begin : begin + rows].reset_index(drop=True)
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    """Partitions of a wide step: as many as the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
