"""A session over one project: what an editor or a service asks for, on a store that remembers the scan before."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan import project
from wattscan.operators import baseline, globs, incremental, summary
from wattscan.operators.rules import languages
from wattscan.operators.scan import scan
from wattscan.operators.store import ScanStore
from wattscan.sources.config import Config, load_config
from wattscan.sources.tree import TreeSource

#: Larger files are skipped.
MAX_BYTES = 1_000_000
#: Changed files that are opened by name, at most; of more, the tree is read again.
NAMED = 10_000


@dataclass
class ProjectScan:
    findings: DataFrame  # all that stand, without accepted ones
    touched: DataFrame  # path, how (scan, hash, gone)
    counts: dict[str, int]  # files, scanned, reused, skipped
    ms: int

    @property
    def cost(self) -> str:
        c = self.counts
        return summary.scan_cost(c["files"], self.ms, c["scanned"], c["reused"], c["skipped"])


class Session:
    """Scans of the tree below ``root``; the store lies in ``folder``. Findings come without those that the baseline accepts.

    Options are read anew for each call, so an edited configuration or baseline counts from the next one on.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, config: str | None = None, max_bytes: int = MAX_BYTES, buckets: int = 16):
        self.spark, self.root, self.max_bytes = spark, root, max_bytes
        self.config_path, self.extra_ignore = config, []
        self.baseline_path = os.path.join(root, project.BASELINE)
        self.tag = f"wattscan-{uuid.uuid4().hex[:12]}"
        self.store = ScanStore(spark, folder, buckets)

    def config(self) -> Config:
        found = load_config(self.config_path)
        return Config(found.disable, globs.union(found.ignore, self.extra_ignore))

    def languages(self) -> list[str]:
        return languages()

    def configure(self, ignore: list[str]) -> list[str]:
        """Globs beside those of the configuration; with others, what was found before is stale."""
        self.extra_ignore = [str(x) for x in ignore]
        return self.extra_ignore

    def scan_text(self, path: str, text: str) -> DataFrame:
        """Findings in a text that need not be on disk; the path says what it is."""
        config = self.config()
        return self._accepted(scan(self.spark.createDataFrame([(path, text)], "path string, text string"), disable=config.disable, ignore=tuple(config.ignore)))

    def scan_file(self, path: str) -> tuple[DataFrame, str]:
        """Findings in one file, and how they came about: ``stat``, ``hash``, ``scan``, or ``skip`` where no rule is for it or it is too large."""
        listing = self._listing([path]).where(self._wanted())
        if listing.isEmpty():
            return self.store.findings().limit(0), "skip"
        touched = {r.how for r in self._refresh(listing, whole=False).collect()}
        name = listing.first().path
        return self._accepted(summary.in_file(self.store.findings(), name)), next(iter(touched), "stat")

    def scan_project(self) -> ProjectScan:
        """Bring the store up to the tree; only what changed is opened and scanned."""
        began = time.monotonic()
        everything = self._listing([self.root])
        sizes = everything.agg(F.count(F.lit(1)).alias("files"), F.count_if(self._wanted()).alias("wanted")).first()
        touched = self._refresh(everything.where(self._wanted()), whole=True)
        scanned = touched.where("how = 'scan'").count()
        counts = {"files": sizes.files, "scanned": scanned, "reused": sizes.wanted - scanned, "skipped": sizes.files - sizes.wanted}
        return ProjectScan(self._accepted(self.store.findings()), touched, counts, round(1000 * (time.monotonic() - began)))

    def write_baseline(self) -> tuple[str, int]:
        """Accept all findings of now."""
        self.scan_project()
        return self.baseline_path, baseline.write_baseline(self.store.findings(), self.baseline_path, self.root)

    def invalidate(self, paths: list[str] | None = None) -> None:
        """Forget what is known of some files, or of all."""
        self.store.invalidate(None if paths is None else self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def cancel(self) -> None:
        """Stop the jobs that this session has running, from another thread."""
        self.spark.interruptTag(self.tag)

    def close(self) -> None:
        self.store.close()

    def _accepted(self, findings: DataFrame) -> DataFrame:
        accepted = baseline.read_baseline(self.spark, self.baseline_path)
        return baseline.apply_baseline(findings, accepted, self.root).drop("fingerprint")

    def _wanted(self):
        return F.col("kind").isin(languages()) & (F.col("size") <= self.max_bytes)

    def _read(self, paths: list[str], most: int) -> DataFrame:
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.spark.dataSource.register(TreeSource)
        options = {"paths": json.dumps(paths), "ignore": json.dumps(self.config().ignore), "cwd": os.getcwd(), "max_bytes": str(most), "pushdown": "true"}
        return self.spark.read.format("source_tree").options(**options).load()

    def _listing(self, paths: list[str]) -> DataFrame:
        """Files with time and size; none is opened."""
        return self._read(paths, -1).drop("text")

    def _refresh(self, listing: DataFrame, whole: bool) -> DataFrame:
        config = self.config()

        def texts(looks: DataFrame) -> DataFrame:
            some = [r.path for r in looks.select("path").limit(NAMED + 1).collect()]
            return self._read(some if len(some) <= NAMED else [self.root], self.max_bytes).where(self._wanted())

        self.spark.addTag(self.tag)
        try:
            return self.store.refresh_listed(listing.select("path", "mtime_ns", "size"), texts, incremental.config_fingerprint(config.disable, config.ignore), whole, disable=config.disable)
        finally:
            self.spark.removeTag(self.tag)
