"""Helpers that the operators share: table access and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.functions.shared import shared_dir
from wattscan.functions.text import once

__all__ = ["SPACE_CLASS", "crc_mod", "cut", "once", "shared_dir", "shared_path", "small_batches", "table", "text_of"]

#: White space of the corpus contracts: space and tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/wattscan/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through the store's own file system."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str = "cut", **options) -> DataFrame:
    """Write a table to the shared folder (with the writer's ``options``) and read it back, so that a lost executor costs no long lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run in here hand rows to Python in Arrow batches of about ``BATCH_BYTES``: for rows of megabytes each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(col: str = "text"):
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, n: int):
    """``crc32`` of an id's decimal text, modulo ``n``: the split that the contracts name."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))
