"""Token counts of whole texts with a public byte-level vocabulary, as its library counts them.

Texts of up to ``CHUNK`` code points are counted in one task each. Huge ones are cut into chunks that overlap, the chunks
are dealt out by Spark and encoded by the library with offsets, and neighbours are spliced where both have a boundary
between pre-tokens inside their overlap. Such a boundary is proven stable:

- The pre-tokeniser runs from left to right, looks at most ``LOOK`` characters past a pre-token and never back, so all it
  knows at a boundary is its place. From a common boundary on, the right chunk's tokens are those of the whole text.
- What the left chunk has before a boundary can only be changed by text behind its end within ``LOOK`` characters and the
  longest special string; boundaries nearer to its end than that aren't used.

The tokens of a text are then those of its last chunk and, for every junction, the left chunk's tokens before the splice
less the right chunk's. Where an overlap holds no common boundary (a long run of letters, say), the text is encoded
again with overlaps four times as wide, and with chunks four times as long once an overlap is a whole chunk.

Short texts are cut at spaces behind a letter, digit or ASCII sign, where a pre-token always starts; each worker remembers
what the library counted for a bounded number of such pieces.

Nulls: a null text counts as empty and has no tokens; null ids and other columns pass through. Very long texts are read
whole. Ties can't occur. Repeated rows give repeated results (equal huge texts are encoded once). Extra columns pass
through, but ones named ``n_bytes`` or ``n_tokens`` give way to the result's. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscan.llm.bpe import byte_letters, sliced
from wattscan.llm.common import cut, table, text_of

#: Code points of a chunk and of an overlap, at first.
CHUNK, OVERLAP = 32_768, 512
#: Characters past its end that can decide where a pre-token ends.
LOOK = 4
#: Pieces that a worker remembers (about 150 bytes each) before it starts anew.
REMEMBERED = 600_000
LIMIT = 512
#: Added to the count of a piece behind which a text may not be cut.
OPEN = 1 << 40
#: A space behind what is no white space in any reading: a pre-token starts here.
CUT = re.compile(r"(?<=[!-~\w]) ")
#: A Latin word and signs behind it: two pre-tokens at most, which go to the library's merges without its splitting.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]{0,3})\Z")


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Counts(dict):
    """Piece -> its tokens; ``lead`` stands before each piece."""

    def __init__(self, tokenizer, lead: str):
        self.tokenizer, self.lead = tokenizer, lead
        self.merges, self.letters = tokenizer.model.tokenize, dict(enumerate(byte_letters()))
        self.signs = {"": 0}

    def __missing__(self, piece: str) -> int:
        if plain := PLAIN.match(piece):
            word, signs = plain.groups()
            if signs not in self.signs:
                self.signs[signs] = len(self.merges(signs))
            n = len(self.merges((self.lead + word).encode().decode("latin-1").translate(self.letters))) + self.signs[signs]
        else:
            n = len(self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids)
        got = self[piece] = n + (0 if CUT.match(piece[-1:] + " ", 1) else OPEN)
        return got


class Counter:
    """The library's tokenizer with what a worker remembers."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        if '"ByteLevel"' not in spec or self.tokenizer.normalizer is not None or self.tokenizer.post_processor is not None:
            raise ValueError("not a byte-level vocabulary of the known kind")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Boundaries nearer to a cut end than this can change with what follows.
        self.margin = LOOK + max([len(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()], default=0)
        self.first, self.inner = Counts(self.tokenizer, ""), Counts(self.tokenizer, " ")

    def count(self, text: str) -> int:
        """Tokens of a whole text, piece by piece."""
        if len(self.inner) + len(self.first) > REMEMBERED:
            self.inner.clear()
            self.first.clear()
        head, *rest = text.split(" ")
        last = rest.pop() if rest else None
        n = self.first[head] + sum(map(self.inner.__getitem__, rest))
        if last is None:
            return n % OPEN
        if n < OPEN:
            return n + self.inner[last] % OPEN
        head, *rest = CUT.split(text)
        return (self.first[head] + sum(map(self.inner.__getitem__, rest))) % OPEN

    def boundaries(self, chunk: str) -> tuple[list[tuple[int, int]], int]:
        """``(place, tokens before)`` of each pre-token's start, and all tokens."""
        got = self.tokenizer.encode(chunk, add_special_tokens=False)
        words = got.word_ids
        starts = [i for i in range(len(words)) if not i or words[i] != words[i - 1]]
        offsets = got.offsets
        return [(offsets[i][0], i) for i in starts], len(words)


_OPEN: dict[str, Counter] = {}


def _opened(key: str, shared) -> Counter:
    """A worker opens a vocabulary once, however many tasks it runs."""
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Counter(shared.value)
    return _OPEN[key]


def _short(docs: DataFrame, kept: list[str], text: str, key: str, shared) -> DataFrame:
    def run(batches):
        counter = _opened(key, shared)
        for batch in sliced(batches):
            n = [counter.count(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], [*kept, "n_tokens"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], text).mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_tokens", T.LongType())]))


_CHUNKS = "digest binary, k int, chunk string, last boolean"
_ENDS = "digest binary, k int, total long, heads array<struct<at:long,n:long>>, tails array<struct<at:long,n:long>>"


def chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """``digest, text`` -> ``digest, k, chunk, last``: a chunk starts at every ``size`` and reaches ``overlap`` into the next; equal ones come once."""

    def run(batches):
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text")):
                text = text.as_py()
                for k in range(0, max(1, -(-len(text) // size))):
                    last = (k + 1) * size >= len(text)
                    yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([k], pa.int32()), pa.array([text[k * size : (k + 1) * size + overlap]]), pa.array([last])], ["digest", "k", "chunk", "last"])

    return texts.select("digest", "text").mapInArrow(run, _CHUNKS).dropDuplicates(["digest", "k"])


def ends(cuts: DataFrame, size: int, overlap: int, key: str, shared) -> DataFrame:
    """Encoded chunks: all tokens of a last one, and the boundaries inside each overlap with the tokens before them."""

    def run(batches):
        counter = _opened(key, shared)
        for batch in sliced(batches):
            rows = []
            for digest, k, chunk, last in zip(*(batch.column(c).to_pylist() for c in ("digest", "k", "chunk", "last"))):
                found, total = counter.boundaries(chunk)
                base = k * size
                near = [{"at": base + p, "n": n} for p, n in found if k and p <= overlap]
                far = [{"at": base + p, "n": n} for p, n in found if not last and size <= p <= len(chunk) - counter.margin]
                rows.append({"digest": digest, "k": k, "total": total if last else 0, "heads": near, "tails": far})
            kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("digest", pa.binary()), ("k", pa.int32()), ("total", pa.int64()), ("heads", kind), ("tails", kind)]))

    return cuts.mapInArrow(run, _ENDS)


def spliced(encoded: DataFrame) -> DataFrame:
    """``digest, n_tokens``; null where a junction has no common boundary."""
    sides = F.filter(F.array(F.struct(F.col("k").alias("j"), "tails", F.lit(None).cast("array<struct<at:long,n:long>>").alias("heads"), "total"), F.struct((F.col("k") - 1).alias("j"), F.lit(None).cast("array<struct<at:long,n:long>>").alias("tails"), "heads", F.lit(0).cast("long").alias("total"))), lambda s: s["j"] >= 0)
    rows = encoded.select("digest", F.explode(sides).alias("s")).select("digest", "s.*")
    junctions = rows.groupBy("digest", "j").agg(F.first("tails", True).alias("tails"), F.first("heads", True).alias("heads"), F.sum("total").alias("total"))
    place = lambda xs: F.transform(xs, lambda x: x["at"])
    before = lambda xs: F.element_at(F.map_from_entries(xs), F.col("at"))
    # No right chunk: the end of the text.
    common = junctions.withColumn("at", F.try_element_at(F.array_intersect(place("tails"), place("heads")), F.lit(1)))
    part = F.when(F.col("heads").isNull(), F.col("total")).otherwise(before("tails") - before("heads"))
    return common.withColumn("part", part).groupBy("digest").agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def _huge(texts: DataFrame, size: int, overlap: int, key: str, shared) -> DataFrame:
    """``digest, n_tokens`` of ``digest, text``; texts whose chunks can't be spliced go round again with wider overlaps."""
    done = None
    while True:
        found = cut(spliced(ends(chunks(texts, size, overlap), size, overlap, key, shared)), "counts")
        good, failed = found.where("n_tokens IS NOT NULL"), found.where("n_tokens IS NULL").select("digest")
        done = good if done is None else done.union(good)
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "digest", "left_semi")
        size, overlap = (size * 4 if overlap >= size else size), min(size, overlap * 4) if overlap < size else overlap * 4


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text.

    ``chunk`` must be at least ``overlap``, and ``overlap`` over a few dozen characters, or the first rounds are in vain.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is at most a chunk")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens")]
    inner = [f"_c{i}" for i in range(len(kept))]  # so that no column clashes
    spec = vocabulary(path)
    key, shared = str(path), docs.sparkSession.sparkContext.broadcast(spec)  # bounded by the vocabulary file
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)], text_of(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long = F.char_length("text") > chunk
    short = _short(rows.where(~long), [*inner, "n_bytes"], "text", key, shared)
    huge = rows.where(long).withColumn("digest", F.unhex(F.sha2("text", 256)))
    counted = huge.drop("text").join(_huge(huge.select("digest", "text"), chunk, overlap, key, shared), "digest")
    both = short.union(counted.select(*short.columns))
    return both.select(*[F.col(i).alias(c) for c, i in zip(kept, inner)], "n_bytes", "n_tokens")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
