"""The pipeline against a plain version of its stages, and on odd tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import duck
from tests.llm.test_native_ops import SMALL, odd_rows
from wattscan.llm import bpe, mixing, near_dup, quality
from wattscan.llm.common import cut, table


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: library.encode(text, add_special_tokens=False).ids


def test_pipeline_equals_stages_done_plainly(spark):
    docs = {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}
    kept = {int(x.strip("(),")) for x in duck(SMALL, f"SELECT doc_id FROM ({quality.OP6_SQL}) q WHERE kept")}
    last: dict[str, int] = {}
    for i in sorted(kept):
        last[docs[i].text] = i
    kept = set(last.values())
    # Near-duplicate classes are compared with brute force in their own test; here the stage takes the least id of each.
    rows = cut(table(spark, SMALL, "documents").where(f"doc_id IN ({', '.join(map(str, kept))})"))
    kept = {r.class_id for r in near_dup.near_classes(rows).collect()}
    rows = cut(rows.where(f"doc_id IN ({', '.join(map(str, kept))})"))
    judged = cut(mixing.posteriors(rows, mixing.fitted(rows, table(spark, SMALL, "labels")), "doc_id"))
    assert len(kept) == judged.count()  # too few labels here to thin anything; the next test but two has enough
    got, encode = corpus_pipeline.run(spark, SMALL).collect(), tokenizer()
    assert {r.doc_id for r in got} == kept and len(got) == len(kept)
    for r in got:
        assert r.text == docs[r.doc_id].text and r.token_ids == encode(r.text) and r.n_tokens == len(r.token_ids)


def write(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SMALL, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, copies, repeated rows and columns of names that stages use."""
    r = random.Random(4)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b = words(300), words(80)
    rows = [(1, a, "en", "s"), (2, a, None, "s"), (3, a.replace(" ", "  ", 5), "en", None), (4, a + " end", "en", "s"), (5, b, "de", "t"), (5, b, "de", "t"), (None, words(90), None, None), (None, None, "en", "s"), (8, "", "en", "s"), (9, words(30_000), "fr", "u"), (10, words(40), "fr", "u"), (11, words(12), "fr", "u")]
    docs = spark.createDataFrame([(*x, 7, 1, 2.0, "z", [3]) for x in rows], "doc_id long, text string, lang string, source string, n_words int, kept int, rate double, _doc string, token_ids array<int>")
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs)).collect()
    # Rejected: no words (null, 8). Of equal texts 2 and one of 5 stay, of near ones (2, 3, 4) the least; too few labels to thin.
    assert sorted((x.doc_id or 0, x.text) for x in got) == sorted((i or 0, t) for i, t in {2: a, 5: b, None: rows[6][1], 9: rows[9][1], 10: rows[10][1], 11: rows[11][1]}.items())
    encode = tokenizer()
    assert all(x.token_ids == encode(x.text) for x in got if len(x.text) < 5000)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = table(spark, SMALL, "documents").limit(0)
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs))
    assert got.count() == 0 and got.columns == [*docs.columns, "token_ids", "n_tokens"]


def test_every_stage_keeps_columns_and_takes_odd_rows(spark):
    rows = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SMALL)
        assert out.columns == rows.columns, name
        assert out.exceptAll(rows).count() == 0, name  # nothing is made up, and no row comes twice
        assert stage(spark, rows.limit(0), SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows.drop("kept"), SMALL).count() == rows.count()
    assert rows.where(F.col("doc_id").isNull()).count() == 2


def test_pipeline_keeps_clean_documents_where_a_domain_lost_its_labels(spark):
    """At this size no document labelled poor is left when the mixture is fitted."""
    sf = "/root/testdata/sf0.01"
    labels = {r.labelled_id: r.label for r in mixing.domain_of(table(spark, sf, "labels")).collect()}
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = cut(stage(spark, docs, sf))
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    kept = {r.doc_id for r in mixing.stage(spark, docs, sf).select("doc_id").collect()}
    of = lambda d: [i for i in before if labels.get(i) == d]
    assert not of(1) and len(of(0)) > 200 and len(of(2)) > 20
    assert sum(i in kept for i in of(0)) >= 0.98 * len(of(0)) and sum(i in kept for i in of(2)) <= 0.2 * len(of(2))
    assert len(kept) > 0.8 * len(before)
