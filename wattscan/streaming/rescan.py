"""Streaming rescans: changes of files in, a log of findings and of what they replace out.

State is keyed by path: the last version, the digest of its text, and under which version its findings were given. A
change that is older, that is delivered again, or whose text is as before therefore gives nothing, without a look at what
was written. One that counts gives its file to the scan and takes back the findings of the version before it.

Of a version's rows the deletion counts; of several texts of one version the one with the largest digest. Null paths and
versions are left out; a null text that isn't a deletion counts as empty. Deleted paths stay in the state, as a late older
version mustn't bring them back.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wattscan.operators.scan import FINDING, scan
from wattscan.sources.tree import TreeChangeSource

CHANGES = "path string, version long, text string, deleted boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DECIDED = "path string, version long, text string, replaces long"


def last_versions(changes: DataFrame) -> DataFrame:
    """The last version of each path, deleted or not; of rows of one version the deletion counts."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version"), F.coalesce(F.col("deleted"), F.lit(False)).desc()))
    return changes.withColumn("_n", last).where("_n = 1").drop("_n")


def latest(changes: DataFrame) -> DataFrame:
    """The last version of each path; deleted files are dropped."""
    return last_versions(changes).where(~F.coalesce(F.col("deleted"), F.lit(False)))


class LastVersions(StatefulProcessor):
    """For each path: which change counts, and which version's findings it replaces."""

    def init(self, handle) -> None:
        # digest: null once deleted; shown: the version whose findings stand, null for none.
        self.state = handle.getValueState("last", "version long, digest binary, shown long")

    def handleInputRows(self, key, rows, timerValues):
        best = max(rows, key=lambda r: (r.version, r.deleted, r.digest))
        before = self.state.get() if self.state.exists() else None
        version, digest, shown = before or (None, None, None)
        deletes_it = best.deleted and best.version == version and digest is not None
        if version is not None and best.version <= version and not deletes_it:
            return
        if best.deleted:
            self.state.update((best.version, None, None))
            if version is None or digest is not None:
                yield Row(path=key[0], version=best.version, text=None, replaces=shown)
        elif best.digest == digest:
            self.state.update((best.version, digest, shown))
        else:
            self.state.update((best.version, best.digest, best.version))
            yield Row(path=key[0], version=best.version, text=best.text, replaces=shown)

    def close(self) -> None:
        pass


def decided(changes: DataFrame) -> DataFrame:
    """A stream of changes as ``path, version, text, replaces``: only those that count, a deletion with a null text."""
    gone = F.coalesce("deleted", F.lit(False))
    text = F.when(~gone, F.coalesce("text", F.lit("")))
    rows = changes.where("path IS NOT NULL AND version IS NOT NULL").select("path", "version", text.alias("text"), gone.alias("deleted"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"))
    return rows.groupBy("path").transformWithState(LastVersions(), _DECIDED, "Append", "None")


def stream_findings(changes: DataFrame, out_dir: str, checkpoint_dir: str, **options):
    """Scan a stream of changes and append to a log, by micro-batch: ``op, file, version`` and a finding.

    ``op`` is ``seen`` for a scanned file, ``found`` for a finding, ``gone`` where what was found in a version is taken
    back, and ``none`` for a deletion that takes nothing back. Started, to be awaited; a batch that is run again replaces its part of the log.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state is asked once
        try:
            found = scan(batch.where("text IS NOT NULL"), keep=("version",), **options).select(F.lit("found").alias("op"), "version", *FINDING, "emit_rank")
            seen = batch.where("text IS NOT NULL").select(F.lit("seen").alias("op"), F.col("path").alias("file"), "version")
            gone = batch.where("replaces IS NOT NULL").select(F.lit("gone").alias("op"), F.col("path").alias("file"), F.col("replaces").alias("version"))
            none = batch.where("text IS NULL AND replaces IS NULL").select(F.lit("none").alias("op"), F.col("path").alias("file"), "version")
            found.unionByName(seen.union(gone).union(none), allowMissingColumns=True).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")
        finally:
            batch.unpersist()

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)  # keyed state needs it; a query keeps the setting that it starts with
    try:
        return decided(changes).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def stream_scan(spark: SparkSession, changes_dir: str, out_dir: str, checkpoint_dir: str, files_per_batch: int = 8, **options):
    """``stream_findings`` of a folder of tables of changes."""
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(changes_dir)
    return stream_findings(changes, out_dir, checkpoint_dir, **options)


def tree_changes(spark: SparkSession, paths: list[str], state_dir: str, ignore: list[str] = (), kinds: list[str] | None = None) -> DataFrame:
    """A stream of what is made, edited and deleted below the paths."""
    spark.dataSource.register(TreeChangeSource)
    options = {"paths": json.dumps(list(paths)), "ignore": json.dumps(list(ignore)), "state": state_dir, "cwd": os.getcwd()}
    return spark.readStream.format("source_tree_changes").options(**options, **({} if kinds is None else {"kinds": json.dumps(kinds)})).load()


def current(spark: SparkSession, out_dir: str) -> DataFrame:
    """The findings that stand: those of the log whose version of the file hasn't been taken back."""
    rows = spark.read.parquet(out_dir)
    gone = rows.where("op = 'gone'").select("file", "version").distinct()
    return rows.where("op = 'found'").join(gone, ["file", "version"], "left_anti").drop("op", "batch", "version")


def progress(spark: SparkSession, out_dir: str) -> DataFrame:
    """What each micro-batch added: ``batch, files`` (scanned or deleted)``, findings, replaced``. The batches together hold what one scan of all would."""
    rows = spark.read.parquet(out_dir)
    counts = [F.count_if(F.col("op") == op).alias(name) for op, name in (("found", "findings"), ("gone", "replaced"))]
    return rows.groupBy("batch").agg(F.count_distinct("file").alias("files"), *counts).orderBy("batch")
