"""Token counts against the library, on whole texts, with chunks small enough that every splice is needed."""

import random

import pytest

from wattscan.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def odd_texts(n: int, most: int, seed: int = 1) -> list[str]:
    """Texts of pieces on which pre-tokens depend: runs of white space, contractions, numbers, specials whole and cut, other scripts."""
    pieces = ["word", "It's", "we'll", "'re", "'", " ", "  ", "\n", "\n\n ", "\t", " ", "　", "\x1c", "\x00", "​", "a1b2", "1234567", "...", "!?", "_", "<|endoftext|>", "<|endof", "text|>", "<|", "naïve", "Δσ", "你好", "\U0001f600", "é", "ǅ", "ﬁ", "x" * 40]
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) + (" " if rnd.random() < 0.5 else "") for _ in range(rnd.randrange(1, most))) for _ in range(n)]


def test_pieces_equal_the_library(library):
    counter = tc.Counter(tc.vocabulary())
    texts = odd_texts(400, 40) + ["", " ", "  ", " a", "a ", "a  b", "\n", "a\n", "<|endoftext|>", " <|endoftext|> ", "word,", "don't.", "İx", "ªº", "café!? café!?! x"]
    assert [counter.count(t) for t in texts] == list(map(library, texts)) == [counter.count(t) for t in texts]


def test_a_worker_starts_anew_when_it_remembers_enough(library, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    counter = tc.Counter(tc.vocabulary())
    texts = odd_texts(30, 20, 2)
    assert [counter.count(t) for t in texts] == list(map(library, texts))
    assert len(counter.inner) < 60


@pytest.mark.parametrize("chunk, overlap", [(64, 32), (97, 60), (128, 128)])
def test_spliced_chunks_equal_the_library(spark, library, chunk, overlap):
    texts = odd_texts(40, 200, chunk) + ["x" * 3000, " " * 1000, "ab " * 500, "<|endoftext|>" * 80, "1" * 200 + " " * 200 + "b" * 200, "你" * 400, "n" * 63 + " " + "m" * 64]
    got = tc.token_counts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), chunk=chunk, overlap=overlap, keep=["id"]).collect()
    assert sorted((r.id, r.n_tokens, r.n_bytes) for r in got) == [(i, library(t), len(t.encode())) for i, t in enumerate(texts)]


def test_overlaps_widen_only_for_texts_that_fail(spark, monkeypatch):
    asked = []
    plain = tc.chunks
    monkeypatch.setattr(tc, "chunks", lambda texts, size, overlap: asked.append((texts.count(), size, overlap)) or plain(texts, size, overlap))
    rows = spark.createDataFrame([(1, "some words " * 200), (2, "words " * 20 + "y" * 900 + " words" * 40)], "id long, text string")
    tc.token_counts(rows, chunk=128, overlap=48).collect()
    assert asked[:4] == [(2, 128, 48), (1, 128, 128), (1, 512, 512), (1, 2048, 2048)] and len(asked) == 4
    with pytest.raises(ValueError, match="overlap"):
        tc.token_counts(rows, chunk=10, overlap=11)


def test_odd_rows(spark, library):
    schema = "doc_id long, text string, n_tokens string, digest string, `a.b` int"
    long = "a long text " * 4000
    rows = [(None, None, "x", "y", 1), (1, "", None, None, None), (1, "same", "x", "y", 2), (1, "same", "x", "y", 2), (2, long, "x", "y", 3), (2, long, "x", "y", 3), (3, long + "!", None, None, None)]
    got = tc.token_counts(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "digest", "a.b", "n_bytes", "n_tokens"]
    assert sorted((r.doc_id or 0, len(r.text or ""), r.n_bytes, r.n_tokens) for r in got.collect()) == sorted((r[0] or 0, len(r[1] or ""), len(r[1] or ""), library(r[1])) for r in rows)
    assert tc.token_counts(spark.createDataFrame([], schema)).collect() == []


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: (len((r.text or "").encode()), n := library(r.text), n > 512) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = tc.op12_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == want and len(got) == len(want)
