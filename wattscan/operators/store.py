"""Findings kept from scan to scan, with a manifest of what they were found in.

Two tables, bucketed alike by path, so that what joins them moves no rows: the manifest (``path``, time, size, digest,
options, ``gen`` of the row, ``found_gen`` of the findings, ``deleted``) and the findings (``file``, a finding, ``gen``).
A refresh only appends: rows for what is new, changed or gone, under the next generation. The last row of a path counts;
a file that is gone leaves a tombstone, and findings count while the manifest names their generation. Findings are
appended before the manifest rows that name them, so a refresh that breaks off in between leaves what stood before.
``compact`` writes what counts into a fresh pair of tables and drops the old pair.

A refresh moves the listing of now (path, time, size) once, and texts only of files whose time or size differs; the scan
sees only those whose content does. Null paths are left out; of a path listed twice one row counts (the later time, then the larger size).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.functions.shared import written
from wattscan.operators.scan import FINDING, scan

MANIFEST = "path string, mtime_ns long, size long, content_hash string, config string, gen long, found_gen long, deleted boolean"
FOUND = "file string, rule string, severity string, line int, message string, suggestion string, co2e_estimate string, emit_rank int, gen long"
#: Paths of files to look at that are broadcast at most (about 100 bytes each); of more, the texts are joined by shuffling.
BROADCAST_PATHS = 200_000


class ScanStore:
    """A store below ``folder`` (of the shared file system); it is made where there is none and opened where there is."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.id = uuid.uuid4().hex[:12]
        self.epoch = max(self._epochs(), default=None)
        if self.epoch is None:
            self.epoch = 0
            self._append("found", spark.createDataFrame([], FOUND))
            self._append("manifest", spark.createDataFrame([], MANIFEST))
        else:
            for kind, schema, key in (("manifest", MANIFEST, "path"), ("found", FOUND, "file")):
                spark.sql(f"CREATE TABLE {self._name(kind)} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self._path(kind)}'")

    def _epochs(self) -> list[int]:
        """Pairs of tables that are whole: the manifest is written last, and Spark marks what it has finished."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(fs_path)]
        whole = lambda name: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS"))
        return [int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-") and whole(n)]

    def _name(self, kind: str) -> str:
        return f"wattscan_{kind}_{self.id}_{self.epoch}"

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{self.epoch}"

    def _append(self, kind: str, rows: DataFrame) -> None:
        """Rows of one bucket come from one task, so a refresh adds a file to each bucket at most."""
        key = "path" if kind == "manifest" else "file"
        rows.repartition(self.buckets, key).write.mode("append").option("path", self._path(kind)).bucketBy(self.buckets, key).sortBy(key).format("parquet").saveAsTable(self._name(kind))

    def manifest(self) -> DataFrame:
        """The last row of each path that isn't gone: ``path, mtime_ns, size, content_hash, config, gen, found_gen``."""
        rows = self.spark.table(self._name("manifest"))
        last = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "gen").alias("x"))
        return last.select("path", "x.*").where("NOT deleted").drop("deleted")

    def findings(self) -> DataFrame:
        """The findings that count."""
        live = self.manifest().select("path", "found_gen")
        rows = self.spark.table(self._name("found"))
        # Only paths are keys of the join, as the tables are bucketed by them; generations are compared as it runs.
        return rows.join(live, (F.col("file") == F.col("path")) & F.col("gen").between(F.col("found_gen"), F.col("found_gen"))).drop("path", "found_gen", "gen")

    def _next(self) -> int:
        """A generation that no row has, not even one of a refresh that broke off."""
        last = self.spark.table(self._name("manifest")).select("gen").union(self.spark.table(self._name("found")).select("gen"))
        return (last.agg(F.max("gen")).first()[0] or 0) + 1

    def decided(self, listing: DataFrame, config: str = "") -> DataFrame:
        """``path, how`` and what is known of it: ``stat`` (as it was), ``look`` (new, or another time, size or option) or ``gone``."""
        now = listing.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("mtime_ns", "size")).alias("x")).select("path", "x.*")
        old = self.manifest().select("path", F.col("mtime_ns").alias("old_ns"), F.col("size").alias("old_size"), "content_hash", "config", "found_gen")
        same = (F.col("mtime_ns") == F.col("old_ns")) & (F.col("size") == F.col("old_size")) & F.col("config").eqNullSafe(F.lit(config))
        both = now.withColumn("here", F.lit(True)).repartition(self.buckets, "path").join(old, "path", "full_outer")
        how = F.when(F.col("here").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "stat").otherwise("look")
        return both.select("path", how.alias("how"), "mtime_ns", "size", "content_hash", "config", "found_gen")

    def refresh(self, files: DataFrame, config: str = "", **options) -> DataFrame:
        """Bring the store up to ``files`` (``path, text, mtime_ns, size``), scanned with ``options``, of which ``config`` is the fingerprint.

        Returns ``path, how`` of what was touched: ``scan``, ``hash`` (another time, the same text) or ``gone``.
        """
        return self.refresh_listed(files.select("path", "mtime_ns", "size"), lambda looks: files, config, **options)

    def refresh_listed(self, listing: DataFrame, texts_of: Callable[[DataFrame], DataFrame], config: str = "", whole: bool = True, **options) -> DataFrame:
        """``refresh`` where the listing comes without texts: ``texts_of`` reads those of the paths to look at (it may give more).

        A listing that isn't ``whole`` says nothing about other paths.
        """
        gen, spark = self._next(), self.spark
        work = written(self.decided(listing, config).where("how = 'look'" if not whole else "how <> 'stat'"), "work")
        looks = work.where("how = 'look'").withColumnRenamed("config", "old_config").withColumnRenamed("content_hash", "old_hash")
        few = looks.count() <= BROADCAST_PATHS
        asked = F.broadcast(looks) if few else looks
        texts = texts_of(looks).where("path IS NOT NULL").select("path", F.coalesce("text", F.lit("")).alias("text"), "mtime_ns", "size").join(asked, ["path", "mtime_ns", "size"]).dropDuplicates(["path"])
        digest = F.sha2("text", 256)
        kept = F.coalesce((digest == F.col("old_hash")) & (F.col("old_config") == config), F.lit(False))
        texts = texts.withColumns({"content_hash": digest, "how": F.when(kept, "hash").otherwise("scan")})
        self._append("found", scan(texts.where("how = 'scan'"), **options).select(*FINDING, "emit_rank").withColumn("gen", F.lit(gen)).select(*[c.split()[0] for c in FOUND.split(", ")]))
        seen = texts.select("path", "mtime_ns", "size", "content_hash", F.lit(config).alias("config"), F.lit(gen).alias("gen"), F.when(F.col("how") == "hash", F.col("found_gen")).otherwise(F.lit(gen)).alias("found_gen"), F.lit(False).alias("deleted"))
        gone = work.where("how = 'gone'").select("path", *[F.lit(None).cast(kind).alias(c) for c, kind in (("mtime_ns", "long"), ("size", "long"), ("content_hash", "string"), ("config", "string"))], F.lit(gen).alias("gen"), F.lit(None).cast("long").alias("found_gen"), F.lit(True).alias("deleted"))
        self._append("manifest", seen.union(gone))
        mine = spark.table(self._name("manifest")).where(F.col("gen") == gen)
        return mine.select("path", F.when(F.col("deleted"), "gone").when(F.col("found_gen") == gen, "scan").otherwise("hash").alias("how"))

    def invalidate(self, paths: DataFrame | None = None) -> None:
        """Make the next refresh scan ``paths`` (one column, ``path``), or all there are: their findings stand until then."""
        rows = self.manifest() if paths is None else self.manifest().join(paths.select("path").distinct(), "path", "left_semi")
        stale = rows.select("path", "mtime_ns", "size", "content_hash", F.lit(None).cast("string").alias("config"), F.lit(self._next()).alias("gen"), "found_gen", F.lit(False).alias("deleted"))
        self._append("manifest", written(stale, "stale"))

    def compact(self) -> None:
        """Write what counts into the next pair of tables, then drop this pair."""
        old, names = (self._path("manifest"), self._path("found")), (self._name("manifest"), self._name("found"))
        live, found = self.manifest(), self.findings()
        merged = live.select("path", "mtime_ns", "size", "content_hash", "config", F.lit(1).cast("long").alias("gen"), F.lit(1).cast("long").alias("found_gen"), F.lit(False).alias("deleted"))
        one = found.withColumn("gen", F.lit(1).cast("long")).select(*[c.split()[0] for c in FOUND.split(", ")])
        self.epoch += 1
        self._append("found", one)
        self._append("manifest", merged)
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        for path in old:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Forget the tables' names; what they hold stays."""
        for kind in ("manifest", "found"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(kind)}")
