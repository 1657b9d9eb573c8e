"""Accepted findings: fingerprints, the anti-join that hides them, and the files that keep them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.functions.paths import below


def fingerprinted(findings: DataFrame, root: str = "", cwd: str | None = None) -> DataFrame:
    """``findings`` with a line-free ``fingerprint`` over the path relative to ``root``, the rule and the message.

    Both paths are resolved first, from ``cwd`` (by default the driver's folder), so a relative and an absolute scan of a
    file give one fingerprint.
    """
    return findings.withColumn("fingerprint", F.sha1(F.concat_ws("|", below(F.col("file"), root, cwd), "rule", "message")))


def apply_baseline(findings: DataFrame, accepted: DataFrame, root: str = "") -> DataFrame:
    """Findings whose fingerprint isn't among ``accepted`` (one column, ``fingerprint``)."""
    return fingerprinted(findings, root).join(accepted.select("fingerprint").distinct(), "fingerprint", "left_anti")


def accepted_prints(findings: DataFrame, root: str = "") -> DataFrame:
    return fingerprinted(findings, root).select("fingerprint").distinct()


def write_prints(findings: DataFrame, path: str, root: str = "") -> None:
    """Write the distinct fingerprints in order, as a folder of JSON lines."""
    accepted_prints(findings, root).orderBy("fingerprint").write.mode("overwrite").json(path)


def write_baseline(findings: DataFrame, path: str, root: str = "") -> int:
    """Write the distinct fingerprints as a sorted JSON file on the driver; returns how many. Such a file is for people to read and review; ``write_prints`` has no bound."""
    prints = [r[0] for r in accepted_prints(findings, root).orderBy("fingerprint").toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": 1, "fingerprints": prints}, f, indent=2)
        f.write("\n")
    return len(prints)


def read_baseline(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """Fingerprints of a baseline file or folder; none if it is missing or malformed. One that is ``named`` must exist.

    A file, which people review and which is as small, is read on the driver (Spark passes over names that start with a
    dot, as the default one does); a folder is read by Spark.
    """
    if not os.path.exists(path):
        if named:
            raise SystemExit(f"no such baseline: {path}")
        return spark.createDataFrame([], "fingerprint string")
    if os.path.isdir(path):
        return spark.read.schema("fingerprint string").json(os.path.abspath(path)).where("fingerprint IS NOT NULL")
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f).get("fingerprints") or []
    except (ValueError, AttributeError):
        found = []
    return spark.createDataFrame([(x,) for x in found if isinstance(x, str)], "fingerprint string")
