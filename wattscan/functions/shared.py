"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, which only a session on one machine may have."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wattscan-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/wattscan/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """A table written once in the shared folder and read from there."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, *order, column: str = "n") -> DataFrame:
    """``rows`` in order with consecutive numbers from 0, equal rows too, written once in the shared folder.

    The sort is by ranges, so no task sees all rows: a row's number is its place in its file and the rows of the files
    before. The driver holds one count for each file.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "numbered")
    rows.orderBy(*order).write.parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = sorted(kept.groupBy("_file").agg(F.count(F.lit(1)).alias("size")).collect())  # part files are named by their place
    starts, total = [], 0
    for name, size in sizes:
        starts.append((name, total))
        total += size
    first = F.broadcast(spark.createDataFrame(starts, "_file string, _start long"))
    return kept.join(first, "_file").withColumn(column, F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")
