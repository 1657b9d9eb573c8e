"""Ranked lexical search over document-sharded postings with integer scores.

Documents are packed into shards in the tasks that read them. A shard is one row: its documents' ids, its terms, and for
each term a slice (CSR) of document numbers and of impacts, the part of a posting's score that doesn't depend on the
term's weight, worked out once when the index is made. Queries come in blocks of a bounded number of terms; a block and
its terms' weights are broadcast, every task goes through its shards term at a time with a dense numpy accumulator for
each query, and keeps the best documents of each query; these few rows are merged by a window. Selection keeps
all documents that tie with the last place until their ids have decided.

A document's terms are its maximal runs of letters and digits (``TERM`` in SQL), A-Z in lower case. Scores are 64-bit
integers; only a term's weight goes through a logarithm.

Nulls: a null text has no terms, and such a document or query finds nothing. A null document id is in results like any
other and ranks before those of equal score; a null query id is a query. Very long texts are read whole; one alone can be
a shard. Ties rank by ascending id. Repeated rows are documents (or queries) of their own. Extra columns are ignored.
An empty table of documents or of queries gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscan.llm.common import cut, small_batches, table

#: Bytes of text from which a shard is closed.
SHARD_BYTES = 6 << 20
#: Parquet looks at its sizes once in 100 rows by default, and 100 shards in one page are more than a task can hold: look after each row.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Queries and (not distinct) terms of a block.
BLOCK_QUERIES, BLOCK_TERMS = 2_000, 200_000
BEST = 10
#: Fixed values of the score: how much a long document counts, and the scale of a posting.
FLAT, SLOPE, SCALE, PER_TF, PER_LENGTH = 10, 90, 1_000_000_000, 1000, 8
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of terms as they are (A-Z lowered), all others as spaces. Every byte beyond ASCII belongs to a term.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SHARD = "ids array<{}>, terms array<binary>, ends binary, docs binary, impacts binary"


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_LETTERS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer part of each posting: grows with ``tf``, falls with the document's length against the mean."""
    m = FLAT + (SLOPE * lengths * n_docs) // n_terms
    return (SCALE * tf) // (PER_TF * tf + PER_LENGTH * m)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""

    def run(batches):
        n = total = 0
        for batch in batches:
            for text in batch.column(0):
                here = len(terms_of(text.as_py()))
                n, total = n + (here > 0), total + here
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    both = docs.select(F.col(f"`{text_col}`").cast("binary").alias("raw")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return both[0] or 0, both[1] or 0


class Shard:
    """The postings of some documents while they are gathered."""

    def __init__(self):
        self.ids, self.lengths, self.sizes, self.bytes = [], array("q"), array("q"), 0
        self.numbers: dict[bytes, int] = {}
        self.terms, self.tf = array("i"), array("q")

    def add(self, doc_id, raw: bytes) -> None:
        words = terms_of(raw)
        if not words:
            return
        counts, numbers = Counter(words), self.numbers
        self.terms.extend([numbers.setdefault(w, len(numbers)) for w in counts])
        self.tf.extend(counts.values())
        self.sizes.append(len(counts))
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.bytes += len(raw)

    def row(self, n_docs: int, n_terms: int, id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
        terms = np.frombuffer(self.terms, np.int32)
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.frombuffer(self.sizes, np.int64))
        found = impacts(np.frombuffer(self.tf, np.int64), np.frombuffer(self.lengths, np.int64)[docs], n_docs, n_terms).astype(np.int32)
        order = np.argsort(terms, kind="stable")  # by term, then by document
        ends = np.cumsum(np.bincount(terms, minlength=len(self.numbers))).astype(np.int64)
        cells = [pa.array([self.ids], pa.list_(id_type)), pa.array([list(self.numbers)], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays([*cells, *(pa.array([x.tobytes()], pa.binary()) for x in (ends, docs[order], found[order]))], names)


@dataclass
class Index:
    """Shards as a written table, with the sizes that their impacts were made from."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row of ``docs``; ids are integers."""
    n_docs, n_terms = corpus_size(docs, text_col)
    kind = docs.schema[id_col].dataType
    id_type = {"long": pa.int64(), "integer": pa.int32()}[kind.typeName()]
    names = ["ids", "terms", "ends", "docs", "impacts"]

    def run(batches):
        shard = Shard()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, raw.as_py() or b"")
                if shard.bytes >= shard_bytes:
                    yield shard.row(n_docs, n_terms, id_type, names)
                    shard = Shard()
        if shard.ids:
            yield shard.row(n_docs, n_terms, id_type, names)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary"))
    with small_batches(docs.sparkSession):
        return Index(cut(rows.mapInArrow(run, _SHARD.format(kind.simpleString())), "postings", **LARGE_ROWS), n_docs, n_terms)


def blocks(queries: DataFrame, id_col: str, text_col: str):
    """Lists of ``(query id, distinct terms)`` of a bounded size each."""
    block, size = [], 0
    for row in queries.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        terms = sorted(set(terms_of(row[1])))
        if block and (len(block) == BLOCK_QUERIES or size + len(terms) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row[0], terms))
        size += len(terms)
    if block:
        yield block


def frequencies(index: Index, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of a block's terms is."""
    asked = index.shards.sparkSession.sparkContext.broadcast(terms)  # one block's

    def run(batches):
        wanted, df = pa.array(asked.value, pa.binary()), np.zeros(len(asked.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at = places(wanted, batch.column("terms")[row].values)
                ends = np.frombuffer(batch.column("ends")[row].as_buffer(), np.int64)
                hit = at >= 0
                df[hit] += np.diff(ends, prepend=0)[at[hit]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    counted = index.shards.select("terms", "ends").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    with small_batches(index.shards.sparkSession):
        return {terms[r.term]: r.df for r in counted.toLocalIterator()}


def places(wanted: pa.Array, terms: pa.Array) -> np.ndarray:
    """Where each wanted term is among a shard's terms, or -1."""
    return pc.fill_null(pc.index_in(wanted, value_set=terms), -1).to_numpy()


def best(scores: np.ndarray, ids: list, k: int) -> list[int]:
    """Positions of the ``k`` largest scores above 0, equal ones by ascending id (null first)."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        least = scores[found[np.argpartition(scores[found], len(found) - k)[len(found) - k]]]
        found = found[scores[found] >= least]  # with all that tie with the last place
    key = lambda i: (-scores[i], ids[i] is not None, ids[i] if ids[i] is not None else 0)
    return sorted(found.tolist(), key=key)[:k]


def _ranked(index: Index, block: list, number: int, k: int, id_kind: str) -> DataFrame:
    """``block, query, doc_id, score``: the best documents of a block's queries in each task."""
    terms = sorted({t for _, ts in block for t in ts})
    df = frequencies(index, terms)
    known = {t: n for n, t in enumerate(t for t in terms if t in df)}
    asked = index.shards.sparkSession.sparkContext.broadcast((list(known), [weight(index.n_docs, df[t]) for t in known], [[known[t] for t in ts if t in known] for _, ts in block]))

    def run(batches):
        words, weights, queries = asked.value
        wanted, kept = pa.array(words, pa.binary()), {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].as_py()
                at = places(wanted, batch.column("terms")[row].values)
                ends = np.concatenate([[0], np.frombuffer(batch.column("ends")[row].as_buffer(), np.int64)])
                docs = np.frombuffer(batch.column("docs")[row].as_buffer(), np.int32)
                parts = np.frombuffer(batch.column("impacts")[row].as_buffer(), np.int32)
                scores = np.zeros(len(ids), np.int64)
                for q, query in enumerate(queries):
                    scores[:] = 0
                    for t in query:
                        if (here := at[t]) >= 0:
                            a, b = ends[here], ends[here + 1]
                            scores[docs[a:b]] += weights[t] * parts[a:b].astype(np.int64)  # a term has a document once
                    if top := best(scores, ids, k):
                        old_ids, old = kept.get(q, ([], np.zeros(0, np.int64)))
                        both_ids, both = old_ids + [ids[i] for i in top], np.concatenate([old, scores[top]])
                        of_both = best(both, both_ids, k)
                        kept[q] = [both_ids[i] for i in of_both], both[of_both]
        flat = [(q, i, s) for q, (some, scores) in kept.items() for i, s in zip(some, scores.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(flat), pa.int32()), *(pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64())))], ["block", "query", "doc_id", "score"])

    return index.shards.mapInArrow(run, "block int, query int, doc_id long, score long").withColumn("doc_id", F.col("doc_id").cast(id_kind))


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = BEST) -> DataFrame:
    """``id_col, rank, doc_id, score``: each query's ``k`` best documents.

    Queries pass the driver a block at a time; each block is a job over all shards whose result is written.
    """
    spark = queries.sparkSession
    kind, id_kind = queries.schema[id_col].dataType, index.shards.schema["ids"].dataType.elementType.simpleString()
    result = spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", index.shards.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())]))
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    for number, block in enumerate(blocks(queries, id_col, text_col)):
        top = _ranked(index, block, number, k, id_kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField(id_col, kind)]))
        named = top.join(F.broadcast(names), "query")  # one block's
        with small_batches(spark):
            result = result.union(cut(named.select(id_col, "rank", "doc_id", "score"), "ranked"))
    return result


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_WORDS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "'))"
OP13_SQL = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term),
asked AS (SELECT DISTINCT item_id, {_WORDS} AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * (({SCALE} * tf) // ({PER_TF} * tf + {PER_LENGTH} * ({FLAT} + ({SLOPE} * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0) WHERE rank <= {BEST}
"""
