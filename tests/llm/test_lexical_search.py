"""Ranked search against SQL on the tables and a plain walk over odd ones."""

import math
import re
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import duck, sparked
from wattscan.llm import lexical_search as ls
from wattscan.llm.common import BATCH_BYTES, small_batches

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(ls.TERM, text or "")]


def plain(docs, items, k=10):
    """Every document's score for every item, sorted."""
    bags = [(i, t) for i, x in docs if (t := plain_terms(x))]
    total = sum(len(t) for _, t in bags)
    out = []
    for item, text in items:
        scores = []
        for doc, words in bags:
            m = 100 - 90 + (90 * len(words) * len(bags)) // total
            score = 0
            for t in set(plain_terms(text)) & set(words):
                df = sum(t in w for _, w in bags)
                score += math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df + 1))) * ((10**9 * words.count(t)) // (1000 * words.count(t) + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, n + 1, d if known else None, -s) for n, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    assert sparked(ls.op13_lexical_search(spark, SF)) == duck(SF, ls.OP13_SQL)


def test_terms():
    for text in (None, "", "  ", "A-b_C", "Ünï İ ẞ", "x\x00y\x7fz", "a　b c\u0085d", "1,000 tokens™"):
        assert [t.decode() for t in ls.terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("shard_bytes, queries", [(1, 1), (40, 2), (1 << 20, 100)])
def test_odd_rows_in_any_shards_and_blocks(spark, monkeypatch, shard_bytes, queries):
    monkeypatch.setattr(ls, "BLOCK_QUERIES", queries)
    docs = [(5, "red fox"), (None, "red fox"), (4, "RED  Fox!"), (4, "red fox"), (9, None), (8, ""), (7, "... --"), (3, "fox " * 5000 + "blue"), (2, "blue red green"), (1, "größe Größe GRÖSSE 你好 你好"), *[(i, "same copies here") for i in range(40, 20, -1)]]
    items = [(1, "the red fox"), (1, "the red fox"), (2, None), (3, ""), (None, "same"), (4, "nothing known"), (5, "größe 你好 Red"), (6, "blue blue here fox")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS terms", "1 AS score")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "'x' AS query", "2 AS doc_id")
    index = ls.build(rows, shard_bytes=shard_bytes)
    assert found(ls.search(index, asked)) == plain(docs, items)
    assert sum(len(r.ids) for r in index.shards.collect()) == index.n_docs == len([d for d in docs if plain_terms(d[1])])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ls.search(ls.build(docs), items).collect() == []
    one = ls.search(ls.build(spark.createDataFrame([(1, "a")], "doc_id int, text string")), items.limit(0))
    assert one.collect() == [] and dict(one.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "int", "score": "bigint"}


def test_selection_keeps_ties_until_ids_decide():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        scores, ids = rng.integers(0, 4, n), [int(i) if i else None for i in rng.permutation(n)]
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], ids[i] is not None, ids[i] or 0))
        for k in (1, 3, 10):
            assert ls.best(scores, ids, k) == want[:k]


def test_postings_lie_in_small_row_groups(spark):
    """However many shards one task writes, few are in a row group, as a task holds a row group when it writes or reads."""
    docs = spark.range(0, 2400, numPartitions=1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 1000), x -> hash(id, x))) AS text")
    index = ls.build(docs)
    groups = []
    for path in index.shards.inputFiles():
        meta = pq.ParquetFile(urlparse(path).path).metadata
        groups += [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 4 and index.n_docs == 2400
    assert max(g.num_rows for g in groups) <= 2 and max(g.total_byte_size for g in groups) < 48 << 20


def test_small_batches_puts_the_setting_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), small_batches(spark):
        assert spark.conf.get(key) == BATCH_BYTES
        raise ValueError
    assert spark.conf.get(key) == before
