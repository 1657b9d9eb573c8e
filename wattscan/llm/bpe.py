"""BPE encoding and decoding with a public word-level vocabulary.

A text is normalised and split into words as the vocabulary file says; each word is then merged over one contiguous array
of part boundaries and the ranks of adjacent parts: find the least rank, delete that boundary, refresh the two ranks
beside it. That is quadratic in a word's length, so words of over ``SHORT`` bytes keep their candidates in a heap, with
the same merges. Words repeat, so each Python worker remembers a bounded number of them.

Nulls: a null text counts as empty; an empty text has no tokens and decodes to an empty text. Very long texts are read whole. Ties of ranks can't occur but for equal pairs, of which the left one merges first.
Repeated rows give repeated results, extra columns (null or not) pass through, but one that has an output's name gives way
to it. An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscan.llm.common import table

SHORT = 64
#: Runs of words that a worker remembers (about 150 bytes each) before it starts anew.
REMEMBERED = 200_000
ROWS = 200
NONE = 1 << 30


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file of the word-end BPE kind."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"]:
            raise ValueError("not a word-end BPE vocabulary of the known kind")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        #: Adjacent ids as one number -> rank, and rank -> id of the merged part.
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [ids[a + b] for a, b in model["merges"]]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.inner, self.last = [ids[x] for x in byte_letters()], [ids[x + end] for x in byte_letters()]
        self.known = Remembered(self)

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return (self.scanned if len(parts) <= SHORT else self.heaped)(parts)

    def scanned(self, parts: list[int]) -> list[int]:
        get = self.ranks.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def heaped(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def chunk(self, chunk: str) -> bytes:
        """The ids of a run of words, as bytes."""
        return np.array([i for w in self.words.findall(chunk) for i in self.word(w)], np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text.

        No word holds white space, so each run between white space is looked up as a whole. Python also splits at
        four control characters that belong to words here; a text with one of them is not split.
        """
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for piece in self.marks.split(text) if "<|" in text else (text,):
            if piece in self.special:
                out.append(np.int32(self.special[piece]).tobytes())
                continue
            # Lower-casing is by character, without the word-final form of sigma.
            piece = (piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")).lower()
            if any(c in piece for c in "\x1c\x1d\x1e\x1f"):
                out.append(self.chunk(piece))
            else:
                out.extend(map(self.known.__getitem__, piece.split()))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder the library joins the tokens' names by spaces."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


class Remembered(dict):
    """Run of words -> its ids as bytes."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        got = self[chunk] = self.bpe.chunk(chunk)
        return got


def vocabulary(path: str | None = None) -> dict:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_OPEN: dict[str, WordBpe] = {}


def _opened(key: str, shared) -> WordBpe:
    """A worker opens a vocabulary once, however many tasks it runs."""
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = WordBpe(shared.value)
    return _OPEN[key]


def sliced(batches):
    """Slices of few rows, so that a worker holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encoded(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the token ids of each whole text as ``array<int>``."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != ids_col]
    mine = "_text"
    while mine in kept:
        mine += "_"
    key, shared = str(path), docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # bounded by the vocabulary file

    def run(batches):
        bpe = _opened(key, shared)
        for batch in sliced(batches):
            ids = [bpe.encode(t or "") for t in batch.column(mine).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            arrays = [batch.column(c) for c in kept] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, ids_col])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias(mine)).mapInArrow(run, schema)


def decoded(rows: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the text that each list of ids decodes to."""
    key, shared = str(path), rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = rows.drop(text_col)

    def run(batches):
        bpe = _opened(key, shared)
        for batch in sliced(batches):
            ids, ends = batch.column(ids_col).flatten().to_numpy(), np.cumsum([0, *batch.column(ids_col).value_lengths().fill_null(0).to_pylist()])
            texts = [bpe.decode(ids[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their token ids and number of tokens."""
    return encoded(docs).withColumn("n_tokens", F.size("token_ids").cast("long"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
