"""Stored tables: append, replace one document, recategorise, copy, and the folder for work in progress."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session's cluster; where none is set, a temporary one for a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


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


def stored(rows: DataFrame, compression: str = "snappy") -> DataFrame:
    """rows, written once to the shared folder and read back, for a plan that reads them several times."""
    path = f"{scratch(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    with shuffles_dropped(rows.sparkSession):
        rows.write.parquet(path, compression=compression)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def save(rows: DataFrame, path: str, force: bool = False, by: str = "file_name") -> None:
    """Bulk write, a folder for each document; without force an existing store is left alone."""
    rows.write.mode("overwrite" if force else "ignore").partitionBy(by).parquet(path)


def append(rows: DataFrame, path: str, by: str = "file_name") -> None:
    rows.write.mode("append").partitionBy(by).parquet(path)


def replace(rows: DataFrame, path: str, by: str = "file_name") -> None:
    """Replaces the documents that rows hold and leaves all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def update(spark: SparkSession, path: str, document: str, values: dict, by: str = "file_name") -> None:
    """Sets columns of one document where a value is given."""
    rows = spark.read.parquet(path).filter(F.col(by) == document)
    out = rows.withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in values.items() if v is not None and c in rows.columns})
    replace(out.checkpoint() if spark.sparkContext.getCheckpointDir() else out, path, by)


def without(rows: DataFrame, document: str, by: str = "file_name") -> DataFrame:
    return rows.filter(F.col(by) != document)


def recategorised(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Uncategorized rows get the category that is stored for their file."""
    new = categories.select("file_name", F.col("category").alias("__new"))
    out = rows.join(new, "file_name", "left")
    return out.withColumn("category", F.when(F.col("category") == "Uncategorized", F.coalesce("__new", "category")).otherwise(F.col("category"))).drop("__new")


def copy(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
