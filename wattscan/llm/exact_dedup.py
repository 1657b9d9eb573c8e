"""Exact dedup by skew-safe combining.

Copies are first combined inside each task (the partial aggregation of a group-by whose key holds the whole text), then
in salted digest groups, then across the salts of a digest. The whole text is part of every grouping key, so the digest
only spreads rows; two texts with one digest never merge.

Nulls: a null text counts as empty. Null ids form no winner unless a whole group has none; the winner is then null and
the group's rows are kept. Repeated rows (one id, one text) are one document stated twice: each such row gets the same
answer; the stage keeps one of them. Ties of ids can't matter: the rows are then the same text. Very long texts are
compared whole. Rows of one id and text share a salt, but each task has made one row of its own already, so a salt gets a
row from each task at most. Extra columns are ignored and kept by the stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscan.llm.common import cut, table, text_of

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``. The largest id of equal texts stays.

    ``salts`` (at most 62) is the number of groups that the copies of one text are spread over.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts must be 1 to 62")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).select("doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    narrow = cut(groups.select("digest", "keep_id", "group_size", "mask"), "exact")
    collided = narrow.groupBy("digest").count().where("count > 1").select("digest")
    ids = rows.select("doc_id", "digest", "salt")
    if collided.isEmpty():
        # One text per digest: the digest and salt name the group, and no text has to travel again.
        winners = narrow.select("digest", "keep_id", "group_size", F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.call_function("getbit", F.col("mask"), s) == 1)).alias("salt"))
        matched = ids.join(winners, ["digest", "salt"])
    else:
        winners = salted.select("digest", "salt", "text").join(groups.select("digest", "text", "keep_id", "group_size"), ["digest", "text"])
        matched = rows.join(winners, ["digest", "salt", "text"])
    return matched.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each text goes on, of the document with the largest id; which of rows repeated there is left open."""
    kept = exact_dedup(docs).where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    kept = cut(kept.select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"), "times"), "kept")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", sha256(text_of()).alias("_digest"))
    joined = inner.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest")))
    if kept.where("times > 1").isEmpty():
        return joined.select("_doc.*")
    return joined.dropDuplicates(["_kept_id", "_kept_digest"]).select("_doc.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
