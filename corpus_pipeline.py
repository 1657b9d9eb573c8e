"""A training-text pipeline of the llm operators: each stage reads what the one before it wrote.

Documents rejected by the quality rules go, of equal texts one stays, of each near-duplicate class one stays, domains are
thinned to their target weights, and what is left gets its token ids.

Nulls: a null text counts as empty and fails the quality rules; a null id, language or source passes through. Repeated
rows and ids: of equal texts one row stays, whatever its ids. Ties: the stages name theirs. Very long texts are read
whole. Extra columns pass through, but one named ``token_ids`` or ``n_tokens`` gives way to the last stage's. An empty
table gives an empty result with the columns of a full one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattscan.llm import bpe, exact_dedup, mixing, near_dup, quality
from wattscan.llm.common import cut, table

STAGES = [
    ("quality rules", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("near dedup", near_dup.stage),
    ("mixing", mixing.stage),
    ("tokens", bpe.stage),
]

#: Near-duplicate alignment and the fitted mixing model are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in turn; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
