"""Language-model scores from an Elias-Fano n-gram trie.

Spark counts words, then pairs, then triples of the training texts. Pairs and triples are kept from ``least`` occurrences:
all of them with one (``op8_lm_score_whole``), those that occur again with two (``op8_lm_score``). A triple can only reach
``least`` if both its pairs did, so only such triples are counted. Pairs and triples are nearly as many as the tokens, so
they are not a row each: a task's are dealt by their hash to parts, and a row holds those of one part. Spark brings a part's
rows together, and the number of parts grows with the training tokens.
The kept n-grams go to sorted shards of three levels in the shared folder; tasks map them into memory and touch only the
pages that they need:

* words: sorted 64-bit hashes (Elias-Fano) with their counts; a word's id is its place. A second hash of 64 bits tells
  words of one hash apart: the seed is one under which no two training words share a hash, and half of the second hash is
  kept to verify the words of other texts;
* pairs: for each first word the successors' ids;
* triples: for each pair the third word's place among the successors of the second, so a context shrinks the numbers.

In pairs and triples each context has a range of positions, given by monotone pointers. Its items are stored behind the
last value of the context before, so that a level is one rising sequence, and a search is for the successor of an item
within its context's range only. Probabilities interpolate absolute discounting down to the add-half unigram of the
contract and are stored as 16-bit codes of log10, as are the back-off weights. A missing level backs off to the one below.

Shards are cut by context and item, so the n-grams of one context (the start mark, a very frequent word) may fill many
shards, and no task holds more than a shard. Sums over a context that lies in several shards are added up on the driver
(two rows a shard) and written into those shards.

Nulls: a null text counts as empty; an empty text is its end token alone. A null id is in no split and is scored as held
out = null. Repeated rows count each time in training. Very long texts are read whole; blocks of documents bound memory.
Ties: equal n-grams are one. Extra columns are ignored. Without training rows every token is unknown and has probability
one. An empty table gives an empty result.

The shared folder must be mounted on the executors (a ``file:`` path), as memory maps need files.
"""

from __future__ import annotations

import itertools
import os
import uuid
from functools import cache
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscan.llm.common import crc_mod, cut, shared_path, table, text_of
from wattscan.llm.elias_fano import EliasFano, encode

#: Occurrences from which ``op8_lm_score`` keeps pairs and triples.
LEAST = 2
DISCOUNT = 0.5
#: Log10 values from -LOWEST to 0 in 16 bits.
LOWEST, CODES = 16.0, 65535
#: Rows of a shard, about; tokens of a block, and bytes of text that are cut into words at once (a longer text comes alone).
SHARD_ROWS, BLOCK, BYTES = 500_000, 400_000, 1 << 19
#: Training tokens for each part in which pairs and triples are counted; occurrences that a task holds before it deals them;
#: the most keys of a row; how many keys one number can tell apart.
PART, HELD, ROW, KEYS = 1 << 20, 1 << 21, 1 << 23, 1 << 64
_U = np.uint64
_TOP = _U(1 << 63)  # signed order as unsigned order


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-logs / LOWEST, 0, 1) * CODES).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (-LOWEST / CODES)


_BYTE = np.arange(256)
#: What a byte adds to a word's hash: one more than its value with A-Z as a-z, nothing if it is white space.
_CHAR = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 33, _BYTE + 1).astype(_U)
_CHAR[(_BYTE == 32) | (_BYTE >= 9) & (_BYTE <= 13)] = 0
_MIX = _U(0xD6E8FEB86659FD93)
#: The end of a text, hashed like a word of one tab, which no word is.
END = 9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _MIX
    return x ^ x >> _U(29)


def _factor(seed: int) -> np.uint64:
    return _mixed(np.array([2 * seed + 1], _U))[0] | _U(1)


def _powers(factor: int, size: int) -> np.ndarray:
    """The first powers of a factor; those for a block's bytes are kept."""
    if size <= BYTES:
        return _kept_powers(factor)[:size]
    out = np.full(size, factor, _U)
    return np.cumprod(out, out=out)


@cache
def _kept_powers(factor: int) -> np.ndarray:
    return np.cumprod(np.full(BYTES, factor, _U))


def _hashed(data: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of the words (A-Z as a-z) and the end of each text, and each text's number of tokens."""
    ends = np.cumsum(sizes)
    chars = _CHAR[data]
    space = chars == 0
    first = ~space
    begins = np.zeros(len(data) + 1, bool)
    begins[ends] = True  # a text begins where the one before ends
    first[1:] &= (space[:-1] | begins[1:-1]) if len(data) else space[:-1]
    starts = np.flatnonzero(first)
    words = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    out = [np.full(len(starts) + len(sizes), _U(0)) for _ in range(2)]
    last = np.cumsum(words + 1) - 1
    is_word = np.ones(len(out[0]), bool)
    is_word[last] = False
    for i in range(2):
        factor = _factor(2 * seed + i)
        out[i][last] = np.array([END + 1], _U) * factor
        if len(starts):
            # Powers by place in the data, taken back by the place where the word starts.
            found = np.add.reduceat(chars * _powers(int(factor), len(data)), starts)
            later = starts > 0
            found[later] *= _powers(pow(int(factor), -1, 1 << 64), len(data))[starts[later] - 1]
            out[i][is_word] = found
    return _mixed(out[0]), _mixed(out[1]), words + 1


def _one_of(values: np.ndarray, back: np.ndarray, size: int) -> np.ndarray:
    """A value of each group that ``back`` numbers."""
    out = np.empty(size, values.dtype)
    out[back] = values
    return out


def _texts(batches, seed: int):
    """(batch slice, hashes, second hashes, tokens of each text) of blocks of bounded size, straight from the bytes of the texts."""
    for batch in batches:
        column = batch.column("_text").cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < batch.num_rows:
            begin, parts, held = at, [], 0
            while at < batch.num_rows and held < BLOCK:
                to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES, "right")) - 1), batch.num_rows)
                parts.append(_hashed(data[ends[at] : ends[to]], np.diff(ends[at : to + 1]), seed))
                held += len(parts[-1][0])
                at = to
            yield batch.slice(begin, at - begin), *(np.concatenate(x) for x in zip(*parts))


def _blocks(batches, column: str):
    """(batch slice, values, tokens of each document) of blocks of bounded size."""
    for batch in batches:
        lists = batch.column(column)
        ends = lists.offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), lists.values.slice(ends[at], ends[to] - ends[at]).to_numpy(), np.diff(ends[at : to + 1])
            at = to


@cache
def _arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a shard file, mapped."""
    raw = np.asarray(np.memmap(path, np.uint8, "r"))  # plain arrays are indexed faster
    out, at = {}, 8 + int(raw[:8].view(np.int64)[0])
    for field in bytes(raw[8:at]).decode().strip().split(";"):
        name, kind, n = field.split(":")
        size = int(n) * np.dtype(kind).itemsize
        out[name] = raw[at : at + size].view(kind) if size else np.empty(0, kind)
        at += -(-size // 8) * 8
    return out


def _write(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a shard; a retried task leaves another file, and only the reported one is read."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}"
    head = ";".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    head += b" " * (-len(head) % 8)
    with open(path + ".part", "wb") as f:
        f.write(np.int64(len(head)).tobytes() + head)
        for v in arrays.values():
            f.write(v.tobytes())
            f.write(b"\0" * (-v.nbytes % 8))
    os.replace(path + ".part", path)
    return path


class Shard(NamedTuple):
    first: tuple[int, int]  # context and item
    last: int  # context
    n: int
    path: str


class Level:
    """Shards of one level in order."""

    def __init__(self, shards: list[Shard]):
        self.shards = sorted(shards)
        self.first = np.array([s.first[0] for s in self.shards], _U)
        self.last = np.array([s.last for s in self.shards], _U)
        self.items = np.array([s.first[1] for s in self.shards], np.int64)
        self.before = np.r_[0, np.cumsum([s.n for s in self.shards])].astype(np.int64)
        self.n = int(self.before[-1])

    def of(self, contexts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The shard that may hold each (context, item), or -1."""
        found = np.searchsorted(self.first, contexts, "right") - 1
        # A context that begins several shards is divided among them, and the shard before, by item.
        divided = np.flatnonzero((found >= 0) & (self.first[found] == contexts)) if len(self.shards) else []
        for c in np.unique(contexts[divided]) if len(divided) else ():
            rows = divided[contexts[divided] == c]
            low = int(np.searchsorted(self.first, c, "left"))
            starts = self.items[low : int(np.searchsorted(self.first, c, "right"))]
            lowest = low - (low > 0 and self.last[low - 1] >= c)  # the first that holds the context, and so its back-off weight
            found[rows] = np.maximum(low - 1 + np.searchsorted(starts, items[rows], "right"), lowest)
        return found

    def begin(self, contexts: np.ndarray) -> np.ndarray:
        """The shard in which each context begins, or would."""
        low = np.searchsorted(self.first, contexts, "left")
        holds = (low > 0) & (self.last[np.maximum(low - 1, 0)] >= contexts) if len(self.shards) else np.zeros(len(contexts), bool)
        return np.where(holds | (low == len(self.shards)), low - 1, low)

    def parts(self, of: np.ndarray):
        """(rows, shard number, its arrays) of each shard; the rows are a slice where ``of`` rises."""
        rising = not len(of) or bool((of[1:] >= of[:-1]).all())
        order = None if rising else np.argsort(of, kind="stable")
        kept = of if rising else of[order]
        cuts = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1], True]) if len(of) else []
        for a, b in zip(cuts, cuts[1:]):
            if kept[a] >= 0:
                yield slice(a, b) if rising else order[a:b], int(kept[a]), _arrays(self.shards[kept[a]].path)


def _coder(arrays: dict, name: str) -> EliasFano:
    """The coder of a field, kept with its shard's arrays."""
    if name not in arrays:
        arrays[name] = EliasFano({k: arrays[f"{name}_{k}"] for k in ("head", "low", "high", "ranks")})
    return arrays[name]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of rising values, and where each value's is."""
    first = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    return values[first], np.cumsum(first) - 1


def _range(arrays: dict, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the items of contexts begin and end in a shard, and what their values start from."""
    c, size = contexts.astype(np.int64) - int(arrays["first"][0]), len(arrays["off"])
    known = (c >= 0) & (c < size)
    c = np.where(known, c, 0)
    pointers = _coder(arrays, "pointers")
    begin, end = pointers.at(c).astype(np.int64), pointers.at(c + 1).astype(np.int64)
    end = np.where(known, end, begin)
    base = np.zeros(len(c), _U)
    later = np.flatnonzero(begin > 0)
    base[later] = _coder(arrays, "keys").at(begin[later] - 1) + _U(1)
    return begin, end, base


class Trie:
    def __init__(self, documents: int, tokens: int, least: int = LEAST, seed: int = 0):
        self.least, self.seed = least, seed
        self.documents, self.tokens = documents, tokens  # training documents and training tokens
        self.words, self.pairs, self.triples = Level([]), Level([]), Level([])

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Add-half log10 probabilities."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words.n + 1)))

    def find_words(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Ids (-1: unknown) of rising hashes, whose words are verified by a part of the second hash."""
        ids = np.full(len(hashes), -1, np.int64)
        for rows, shard, arrays in self.words.parts(self.words.of(hashes, np.zeros(len(hashes), np.int64))):
            at, found = _coder(arrays, "keys").successor(hashes[rows])
            found &= arrays["check"][np.minimum(at, len(arrays["check"]) - 1)] == (checks[rows] >> _U(32)).astype(np.uint32)
            ids[rows] = np.where(found, at + self.words.before[shard], -1)
        return ids

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word ids; unknown words have none, and the start mark, whose id follows the last, counts the documents."""
        out = np.where(ids < 0, 0, self.documents)
        known = np.flatnonzero((ids >= 0) & (ids < self.words.n))
        some = ids[known]
        for rows, shard, arrays in self.words.parts(np.searchsorted(self.words.before, some, "right") - 1):
            out[known[rows]] = arrays["n"][some[rows] - self.words.before[shard]]
        return out

    def find(self, level: Level, contexts: np.ndarray, items: np.ndarray):
        """For rising (context, item): place in the level (-1: none), code, back-off code of the context, and where its items begin."""
        place, begins = np.full(len(contexts), -1, np.int64), np.zeros(len(contexts), np.int64)
        code, off = np.zeros(len(contexts), np.uint16), np.zeros(len(contexts), np.uint16)
        for rows, shard, arrays in level.parts(level.of(contexts.astype(_U), items)):
            some, back = _runs(contexts[rows])
            first = int(arrays["first"][0])
            begin, end, base = _range(arrays, some)
            at, found = _coder(arrays, "keys").successor(base[back] + np.maximum(items[rows], 0).astype(_U), begin[back], end[back])
            found &= items[rows] >= 0
            place[rows] = np.where(found, at + level.before[shard], -1)
            code[rows] = np.where(found, arrays["code"][np.minimum(at, len(arrays["code"]) - 1)], 0)
            c = some - first
            off[rows] = np.where(c < len(arrays["off"]), arrays["off"][np.minimum(c, len(arrays["off"]) - 1)], 0)[back]
            begin += level.before[shard]
            if shard and len(some) and some[0] == first and level.last[shard - 1] == level.first[shard]:  # goes on from the shard before
                begin[0] = self.begins(some[:1])[0] if level is self.pairs else begin[0]
            begins[rows] = begin[back]
        return place, code, off, begins

    def of_pairs(self, places: np.ndarray, field: str) -> np.ndarray:
        """``n`` or ``code`` of the pairs at places."""
        out = np.zeros(len(places), np.int64)
        for rows, shard, arrays in self.pairs.parts(np.searchsorted(self.pairs.before, places, "right") - 1):
            out[rows] = arrays[field][places[rows] - self.pairs.before[shard]]
        return out

    def second(self, places: np.ndarray) -> np.ndarray:
        """Second word of the pairs at rising places."""
        out = np.zeros(len(places), np.int64)
        for rows, shard, arrays in self.pairs.parts(np.searchsorted(self.pairs.before, places, "right") - 1):
            at = places[rows] - self.pairs.before[shard]
            begins = _coder(arrays, "pointers").at(np.arange(len(arrays["off"]) + 1)).astype(np.int64)
            words, back = np.unique(np.searchsorted(begins, at, "right") - 1 + int(arrays["first"][0]), return_inverse=True)
            out[rows] = (_coder(arrays, "keys").at(at) - _range(arrays, words)[2][back]).astype(np.int64)
        return out

    def begins(self, words: np.ndarray) -> np.ndarray:
        """Where the successors of word ids that have some begin among the pairs."""
        out = np.zeros(len(words), np.int64)
        for rows, shard, arrays in self.pairs.parts(self.pairs.begin(words.astype(_U))):
            out[rows] = _range(arrays, words[rows])[0] + self.pairs.before[shard]
        return out


class Tokens:
    """A block of documents as ids, each document behind a start mark, and what the levels hold of its n-grams. Only distinct n-grams are looked up."""

    def __init__(self, trie: Trie, ids: np.ndarray, sizes: np.ndarray):
        self.trie, self.sizes = trie, sizes + 1
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.scored = np.ones(int(self.sizes.sum()), bool)
        self.scored[self.starts] = False
        self.id = np.full(len(self.scored), trie.words.n, ids.dtype)
        self.id[self.scored] = ids
        self.distinct, self.code = np.unique(self.id, return_inverse=True)
        self.count = trie.counts_of(self.distinct.astype(np.int64))[self.code]

    def pair_ends(self) -> np.ndarray:
        """The positions that end a pair which may be kept."""
        often = (self.count >= self.trie.least) | ~self.scored
        return np.flatnonzero(np.r_[False, self.scored[1:] & often[1:] & (self.id[1:] >= 0) & often[:-1] & (self.id[:-1] >= 0)])

    def look_up_pairs(self):
        """``which`` of the distinct pairs each position ends (-1: none), their places, codes and items (places among the first word's pairs); ``kept`` is ``which`` without pairs that have no place."""
        at, size = self.pair_ends(), len(self.distinct)  # numbers of the block's own words can't overflow
        keys, back = np.unique(self.code[at - 1] * size + self.code[at], return_inverse=True)
        self.ctx, self.next = self.distinct[keys // size].astype(np.int64), self.distinct[keys % size].astype(np.int64)
        self.which = np.full(len(self.id), -1, np.int64)
        self.which[at] = back
        self.place, self.pair_code, self.pair_off, begins = self.trie.find(self.trie.pairs, self.ctx, self.next)
        self.item = self.place - begins
        self.kept = np.where((self.which >= 0) & (self.place[np.maximum(self.which, 0)] >= 0) if len(self.place) else False, self.which, -1)

    def scores(self) -> np.ndarray:
        """Model log10 probability of each document."""
        if not self.trie.tokens:
            return np.zeros(len(self.sizes))
        self.look_up_pairs()
        logp = self.trie.unigram(self.count)
        looked = np.flatnonzero(self.which >= 0)
        pair = self.which[looked]
        logp[looked] = np.where(self.place[pair] >= 0, restored(self.pair_code[pair]), restored(self.pair_off[pair]) + logp[looked])
        # Words that aren't looked up as a pair still back off from a known word before.
        rest = np.flatnonzero(np.r_[False, self.scored[1:] & (self.id[:-1] >= 0) & (self.which[1:] < 0)])
        before, back = np.unique(self.code[rest - 1], return_inverse=True)
        words = self.distinct[before].astype(np.int64)
        logp[rest] += restored(self.trie.find(self.trie.pairs, words, np.zeros_like(words))[2][back])
        # Third words that can't be kept only take the pair's back-off weight.
        after = np.flatnonzero(np.r_[False, self.kept[:-1] >= 0] & self.scored)
        size = len(self.place) + 1
        keys, back = np.unique(self.kept[after - 1] * size + self.kept[after] + 1, return_inverse=True)
        third = keys % size - 1
        items = np.where(third >= 0, self.item[np.maximum(third, 0)], -1) if len(keys) else third
        place, code, off, _ = self.trie.find(self.trie.triples, self.place[keys // size], items)
        logp[after] = np.where(place[back] >= 0, restored(code[back]), logp[after] + restored(off[back]))
        return np.add.reduceat(np.where(self.scored, logp, 0.0), self.starts)


def _tallied(ctx: np.ndarray, item: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ctx, item, n)], ["ctx", "item", "n"])


#: Odd, so that multiplying is one to one on 64 bits and can be undone.
_SCATTER = 0x9E3779B97F4A7C15
_GATHER = pow(_SCATTER, -1, 1 << 64)


def dealt(keys: np.ndarray, parts: int):
    """Rows (part, distinct scattered keys, how often each) of keys that may repeat."""
    keys, n = np.unique(keys * _U(_SCATTER), return_counts=True)
    bounds = np.array([-(-(i << 64) // parts) for i in range(parts)], _U)
    for at in range(0, len(keys), ROW):
        some, often = keys[at : at + ROW], n[at : at + ROW].astype(np.uint32)
        cuts = np.r_[np.searchsorted(some, bounds), len(some)]
        used = np.flatnonzero(np.diff(cuts))
        ends = np.r_[cuts[used], len(some)].astype(np.int32)
        packed = [pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (some, often)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *packed], ["part", "keys", "n"])


def gathered(rows: pa.Table, items: int, least: int) -> pa.RecordBatch:
    """Counts (``ctx, item, n``) of the keys of whole parts that occur ``least`` times; a key is context * ``items`` + item."""
    keys, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("keys", _U), ("n", np.uint32)))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    total = np.add.reduceat(n[order], first, dtype=np.int64)
    often = total >= least
    keys = keys[first[often]] * _U(_GATHER)
    return _tallied((keys // _U(items)).view(np.int64), (keys % _U(items)).view(np.int64), total[often])


def _sharded(rows: DataFrame, build) -> list[dict]:
    """Cut written counts (``ctx, item, n``) into sorted shards and write each; the driver gets a row for each shard."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    parts = (rows.repartitionByRange(shards, "ctx", "item") if shards > 1 else rows.repartition(1)).sortWithinPartitions("ctx", "item")

    def run(batches):
        got = [b for b in batches if b.num_rows]  # a shard's rows: about SHARD_ROWS
        if got:
            found = build(*(np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("ctx", "item", "n")))
            yield pa.RecordBatch.from_pylist([found], schema=_SHARD)

    return [r.asDict() for r in parts.mapInArrow(run, "ctx long, item long, last long, n long, path string, sums array<long>").collect()]


_SHARD = pa.schema([(k, pa.int64()) for k in ("ctx", "item", "last", "n")] + [("path", pa.string()), ("sums", pa.list_(pa.int64()))])


def _leveled(folder: str, ctx: np.ndarray, item: np.ndarray, n: np.ndarray, coded) -> dict:
    """Write a shard of pairs or triples. ``coded`` gives code and back-off code from the sums of a context."""
    first, last = int(ctx[0]), int(ctx[-1])
    begin = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
    ends = np.r_[begin[1:], len(ctx)]
    sums, types = np.add.reduceat(n, begin), ends - begin
    tops = item[ends - 1].astype(_U) + _U(1)
    base = np.r_[_U(0), np.cumsum(tops)[:-1]].astype(_U)
    code, weight = coded(ctx, item, n, np.repeat(sums, types), np.repeat(types, types))
    off = np.zeros(last - first + 1, np.uint16)
    off[ctx[begin] - first] = weight[begin]
    arrays = {"first": np.array([first], np.int64), "n": n, "code": code, "off": off}
    arrays |= {f"keys_{k}": v for k, v in encode(item.astype(_U) + np.repeat(base, types)).items()}
    arrays |= {f"pointers_{k}": v for k, v in encode(np.searchsorted(ctx, np.arange(first, last + 2)).astype(_U)).items()}
    return {"ctx": first, "item": int(item[0]), "last": last, "n": len(ctx), "path": _write(folder, arrays), "sums": [int(x) for x in (sums[0], types[0], sums[-1], types[-1])]}


def _joined(spark: SparkSession, folder: str, shards: list[dict], coded) -> Level:
    """The level; shards whose first or last context goes on in another are written anew with the sums over all of it."""
    totals: dict[int, list[int]] = {}
    for s in shards:
        for c, (n, types) in ({s["ctx"]: s["sums"][:2]} | {s["last"]: s["sums"][2:]}).items():
            got = totals.setdefault(c, [0, 0, 0])
            totals[c] = [got[0] + n, got[1] + types, got[2] + 1]
    divided = {c: t[:2] for c, t in totals.items() if t[2] > 1}
    todo = [(s["path"], c, *divided[c]) for s in shards for c in sorted({s["ctx"], s["last"]}) if c in divided]

    def run(batches):
        for batch in batches:
            for path in dict.fromkeys(batch.column("path").to_pylist()):
                arrays = {k: v.copy() for k, v in _arrays(path).items() if isinstance(v, np.ndarray)}
                for c, n, types in ((r["c"], r["n"], r["types"]) for r in batch.to_pylist() if r["path"] == path):
                    begin, end, base = (int(x[0]) for x in _range(arrays, np.array([c])))
                    at = np.arange(begin, end)
                    item = (_coder(arrays, "keys").at(at) - _U(base)).astype(np.int64)
                    same = np.ones(len(at), np.int64)
                    code, weight = coded(same * c, item, arrays["n"][begin:end], same * n, same * types)
                    arrays["code"][begin:end], arrays["off"][c - int(arrays["first"][0])] = code, weight[0]
                yield pa.RecordBatch.from_pydict({"old": [path], "new": [_write(folder, {k: v for k, v in arrays.items() if isinstance(v, np.ndarray)})]})

    moved = {}
    if todo:
        rows = spark.createDataFrame(todo, "path string, c long, n long, types long")
        moved = dict(rows.repartition(len({t[0] for t in todo}), "path").mapInArrow(run, "old string, new string").collect())
    return Level([Shard((s["ctx"] % (1 << 64), s["item"]), s["last"] % (1 << 64), s["n"], moved.get(s["path"], s["path"])) for s in shards])


def vocabulary(training: DataFrame, folder: str, least: int = LEAST) -> Trie:
    """The level of words, under hashes by which no two of them are the same; a second hash tells words apart."""
    texts = training.select(text_of().alias("_text"))

    def counted(seed):
        def run(batches):
            for _, hashes, checks, _ in _texts(batches, seed):
                keys, back, n = np.unique(hashes ^ _TOP, return_inverse=True, return_counts=True)
                yield _tallied(keys.view(np.int64), _one_of(checks, back, len(keys)).view(np.int64), n)

        found = texts.mapInArrow(run, "ctx long, item long, n long").groupBy("ctx")
        return cut(found.agg(F.min("item").alias("item"), F.max("item").alias("other"), F.sum("n").alias("n")), "words")

    for seed in itertools.count():
        words = counted(seed)
        if words.where("item != other").isEmpty():
            break
    trie = Trie(training.count(), words.agg(F.sum("n")).first()[0] or 0, least, seed)

    def build(keys, checks, n):
        arrays = {"n": n, "check": (checks.view(_U) >> _U(32)).astype(np.uint32), **{f"keys_{k}": v for k, v in encode(keys.view(_U) ^ _TOP).items()}}
        return {"ctx": int(keys[0]), "item": 0, "last": int(keys[-1]), "n": len(n), "path": _write(folder, arrays), "sums": []}

    flipped = lambda x: (x % (1 << 64)) ^ (1 << 63)
    trie.words = Level([Shard((flipped(s["ctx"]), 0), flipped(s["last"]), s["n"], s["path"]) for s in _sharded(words, build)])
    return trie


def indexed(docs: DataFrame, trie: Trie, *keep) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``n_known``, ``base_score`` and ``ids`` (-1: unknown) of each whole text."""
    wide = trie.words.n >= (1 << 31) - 1
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("ids", T.ArrayType(T.LongType() if wide else T.IntegerType()))
    names = schema.names[:-4]

    def run(batches):
        for part, hashes, checks, sizes in _texts(batches, trie.seed):
            distinct, back = np.unique(hashes, return_inverse=True)
            found = trie.find_words(distinct, _one_of(checks, back, len(distinct)))
            one, starts = (trie.unigram(trie.counts_of(found)) if trie.tokens else np.zeros(len(found)))[back], np.r_[0, np.cumsum(sizes)[:-1]]
            ids = (found if wide else found.astype(np.int32))[back]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))
            numbers = [pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((ids >= 0).astype(np.int64), starts)), pa.array(np.add.reduceat(one, starts))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *numbers, lists], schema.names)

    return docs.select(*keep, text_of().alias("_text")).mapInArrow(run, schema)


def grown(trie: Trie, ids: DataFrame, folder: str) -> Trie:
    """The trie with pairs and triples of the written training ``ids``."""
    spark, ids = ids.sparkSession, ids.select("ids")

    def counts(run, name, contexts, items):
        """Counts of the (context, item) that ``run`` gives for a block, under one number for both where that can't overflow."""
        least, parts = trie.least, -(-max(trie.tokens, 1) // PART)

        def whole(batches):
            for _, values, sizes in _blocks(batches, "ids"):
                ctx, item = run(Tokens(trie, values, sizes))
                order = np.lexsort((item, ctx))
                first = np.flatnonzero(np.r_[True, (np.diff(ctx[order]) != 0) | (np.diff(item[order]) != 0)]) if len(order) else order
                yield _tallied(ctx[order[first]], item[order[first]], np.diff(np.r_[first, len(order)]))

        def packed(batches):
            held = []
            for _, values, sizes in _blocks(batches, "ids"):
                ctx, item = run(Tokens(trie, values, sizes))
                held.append(ctx.astype(_U) * _U(items) + item.astype(_U))
                if sum(map(len, held)) >= HELD:
                    yield from dealt(np.concatenate(held), parts)
                    held = []
            if held:
                yield from dealt(np.concatenate(held), parts)

        def counted(batches):
            got = [b for b in batches if b.num_rows]  # a part's keys: PART at most, about
            if got:
                yield gathered(pa.Table.from_batches(got), items, least)

        if contexts * items > KEYS:
            found = ids.mapInArrow(whole, "ctx long, item long, n long").groupBy("ctx", "item").agg(F.sum("n").alias("n"))
            return cut(found.where(F.col("n") >= least), name)
        rows = ids.mapInArrow(packed, "part int, keys binary, n binary")
        return cut(rows.repartitionById(parts, "part").mapInArrow(counted, "ctx long, item long, n long"), name)

    def pairs_of(block):
        at = block.pair_ends()
        return block.id[at - 1].astype(np.int64), block.id[at].astype(np.int64)

    def coded(ctx, item, n, sums, types, total, lower):
        weight = np.maximum(1 - (sums - DISCOUNT * types) / total, 10.0**-LOWEST)
        return quantised(np.log10((n - DISCOUNT) / total + weight * 10.0**lower)), quantised(np.log10(weight))

    def coded_pairs(ctx, item, n, sums, types):
        return coded(ctx, item, n, sums, types, trie.counts_of(ctx), trie.unigram(trie.counts_of(item)))

    trie.pairs = _joined(spark, folder, _sharded(counts(pairs_of, "pairs", trie.words.n + 1, trie.words.n + 1), lambda *x: _leveled(folder, *x, coded_pairs)), coded_pairs)

    def triples_of(block):
        block.look_up_pairs()
        at = np.flatnonzero(np.r_[False, (block.kept[1:] >= 0) & (block.kept[:-1] >= 0)])
        return block.place[block.kept[at - 1]], block.item[block.kept[at]]

    def coded_triples(ctx, item, n, sums, types):
        # The middle word of a context is known by the pair that an item stands for.
        contexts, back = np.unique(ctx, return_inverse=True)
        total = trie.of_pairs(contexts, "n")[back]
        second, where = np.unique(trie.second(contexts), return_inverse=True)
        lower = restored(trie.of_pairs(trie.begins(second)[where][back] + item, "code"))
        return coded(ctx, item, n, sums, types, total, lower)

    trie.triples = _joined(spark, folder, _sharded(counts(triples_of, "triples", trie.pairs.n, trie.words.n + 1), lambda *x: _leveled(folder, *x, coded_triples)), coded_triples)
    return trie


def _folder(spark: SparkSession) -> str:
    target = urlparse(shared_path(spark, "trie"))
    if target.scheme not in ("", "file"):
        raise ValueError("the trie needs a shared folder that executors have mounted (spark.checkpoint.dir as file:)")
    return target.path


def trained(training: DataFrame, least: int = LEAST) -> Trie:
    """Count the training texts and write the trie's levels to the shared folder."""
    folder = _folder(training.sparkSession)
    trie = vocabulary(training, folder, least)
    return grown(trie, cut(indexed(training, trie), "ids"), folder)


def scored(rows: DataFrame, trie: Trie) -> DataFrame:
    """Indexed texts with ``score`` in place of their ids."""
    names = [c for c in rows.columns if c != "ids"]

    def run(batches):
        for part, values, sizes in _blocks(batches, "ids"):
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(Tokens(trie, values, sizes).scores())], [*names, "score"])

    return rows.mapInArrow(run, rows.select(*names).schema.add("score", "double"))


def scored_texts(docs: DataFrame, trie: Trie) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each whole text."""
    return scored(indexed(docs, trie, "doc_id"), trie)


def op8_lm_score(spark: SparkSession, sf_dir: str, least: int = LEAST) -> DataFrame:
    held_out = (crc_mod("doc_id", 5) == 1).alias("held_out")
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text", held_out), _folder(spark)
    trie = vocabulary(docs.where("NOT held_out"), folder, least)
    ids = cut(indexed(docs, trie, "doc_id", "held_out"), "ids")  # texts are cut into words once more, for all that follows
    grown(trie, ids.where("NOT held_out"), folder)
    return scored(ids, trie).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from every pair and triple of the training texts."""
    return op8_lm_score(spark, sf_dir, 1)
