"""Rescans that reuse what hasn't changed: joins against a manifest, upserts of findings by file."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def config_fingerprint(disable: Iterable[str] = (), ignore: Iterable[str] = ()) -> str:
    """What a manifest keeps of the options: other rules or globs make all its rows stale. A baseline is applied to findings, so it has no part."""
    return hashlib.sha1(json.dumps([sorted(set(disable)), sorted(set(ignore))]).encode()).hexdigest()


def invalidate(before: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """A manifest without ``paths`` (one column, ``path``), or without any row."""
    return before.limit(0) if paths is None else before.join(paths.select("path").distinct(), "path", "left_anti")


def manifest(files: DataFrame, config: str = "") -> DataFrame:
    """``path, mtime_ns, size, content_hash, config`` of files (``path, text, mtime_ns``)."""
    return files.select("path", "mtime_ns", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash"), F.lit(config).alias("config"))


def reuse(now: DataFrame, before: DataFrame) -> DataFrame:
    """``path, how``: ``stat`` where time and size are the same, ``hash`` where the content is, else ``scan``."""
    old = before.select("path", F.col("mtime_ns").alias("old_ns"), F.col("size").alias("old_size"), F.col("content_hash").alias("old_hash"), F.col("config").alias("old_config"))
    same = F.col("config") == F.col("old_config")
    stat = same & (F.col("mtime_ns") == F.col("old_ns")) & (F.col("size") == F.col("old_size"))
    how = F.when(stat, "stat").when(same & (F.col("content_hash") == F.col("old_hash")), "hash").otherwise("scan")
    return now.join(old, "path", "left").select("path", how.alias("how"))


def merge(stored: DataFrame, batch: DataFrame, scanned: DataFrame, dirty: DataFrame) -> DataFrame:
    """Stored findings with those of ``scanned`` files replaced by the batch's; ``dirty`` files are left alone."""
    clean = scanned.select(F.col("path").alias("file")).distinct().join(dirty.select(F.col("path").alias("file")), "file", "left_anti")
    return stored.join(clean, "file", "left_anti").unionByName(batch.join(clean, "file", "left_semi"))


def prune(stored: DataFrame, root: str, keep: DataFrame, dirty: DataFrame) -> DataFrame:
    """Stored findings without those of files under ``root`` that are neither kept nor dirty."""
    safe = keep.select(F.col("path").alias("file")).union(dirty.select(F.col("path").alias("file"))).distinct()
    under = F.col("file").startswith(root.rstrip("/") + "/") | (F.col("file") == root)
    gone = stored.where(under).select("file").distinct().join(safe, "file", "left_anti")
    return stored.join(gone, "file", "left_anti")
