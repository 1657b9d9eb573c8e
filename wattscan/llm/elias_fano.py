"""Elias-Fano coding of rising whole numbers, in numpy arrays that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th one of a byte.
_PLACE = np.array([[*np.flatnonzero(np.unpackbits(np.uint8(b), bitorder="little")), *[0] * 8][:8] for b in range(256)], np.int64)


def _packed(at: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Words with ``bits`` or-ed in at the rising word numbers ``at``."""
    out = np.zeros(size, _U)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.bitwise_or.reduceat(bits, first)
    return out


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing uint64 sequence: ``head`` (length, low bits, buckets), ``low``, ``high``, ``ranks``."""
    values = np.ascontiguousarray(values, _U)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    bit = np.arange(n, dtype=np.int64) * width
    shift = (bit & 63).astype(_U)
    part = values & _U((1 << width) - 1)
    size = (n * width >> 6) + 2
    low = _packed(bit >> 6, part << shift, size)
    over = np.flatnonzero((bit & 63) + width > 64)
    low[(bit[over] >> 6) + 1] |= part[over] >> (_U(64) - shift[over])
    place = (values >> _U(width)).astype(np.int64) + np.arange(n)
    buckets = (top >> width) + 1
    high = _packed(place >> 6, _U(1) << (place & 63).astype(_U), (n + buckets >> 6) + 1)
    ones = np.bitwise_count(high).astype(np.int64)
    return {"head": np.array([n, width, buckets], np.int64), "low": low, "high": high, "ranks": np.r_[0, np.cumsum(ones)].astype(np.int64)}


class EliasFano:
    """Queries on encoded arrays, for many positions or values at once."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width, self.buckets = map(int, arrays["head"])
        self.low, self.high, self.ranks = arrays["low"], arrays["high"], arrays["ranks"]
        self.zeros = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero) of the high bits: the byte that holds it by sums over all bytes of a word at once."""
        word = np.searchsorted(counts, k, "right") - 1
        bits = ~self.high[word] if flip else self.high[word]
        rest = (k - counts[word]).astype(_U)
        ones = bits - (bits >> _U(1) & _U(0x5555555555555555))
        ones = (ones & _U(0x3333333333333333)) + (ones >> _U(2) & _U(0x3333333333333333))
        upto = (ones + (ones >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte j holds the ones of bytes 0 to j
        passed = (rest * _EACH | _TOPS) - upto & _TOPS  # the top bit of a byte says that the wanted one is behind it
        shift = np.bitwise_count(passed).astype(_U) << _U(3)
        before = upto << _U(8) >> shift & _U(255)
        return word * 64 + shift.astype(np.int64) + _PLACE[(bits >> shift & _U(255)).astype(np.int64), (rest - before).astype(np.int64)]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(_U)
        spill = self.low[word + 1] << (_U(63) - shift) << _U(1)  # in two steps, as a shift by 64 isn't defined
        return (self.low[word] >> shift | spill) & _U((1 << self.width) - 1)

    def _bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first position of each bucket and the one behind its last: its ones follow the zero of the bucket before."""
        place = np.zeros(len(bucket), np.int64)
        later = slice(None) if len(bucket) and bucket.min() > 0 else np.flatnonzero(bucket > 0)
        place[later] = self._select(bucket[later] - 1, self.zeros, True) + 1
        word, shift = place >> 6, (place & 63).astype(_U)
        bits = self.high[word] >> shift | self.high[np.minimum(word + 1, len(self.high) - 1)] << (_U(63) - shift) << _U(1)
        start = place - bucket
        stop = start + np.bitwise_count(bits & ~(bits + _U(1)))
        full = np.flatnonzero(bits == ~_U(0))  # 64 ones, perhaps more
        stop[full] = self._select(bucket[full], self.zeros, True) - bucket[full]
        return start, stop

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at positions below ``n``."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.empty(0, _U)
        return (self._select(index, self.ranks, False) - index).astype(_U) << _U(self.width) | self._lows(index)

    def successor(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each value the first position that holds no less, and whether it holds the value itself.

        With ``begin`` and ``end`` each search is within its own positions, whose values must rise through all values
        asked for there; a value beyond them gives the end.
        """
        values = np.asarray(values, _U)
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        bucket = (values >> _U(self.width)).astype(np.int64)
        beyond = bucket >= self.buckets
        bucket = np.minimum(bucket, self.buckets - 1)
        start, stop = self._bucket(bucket)
        start[beyond] = stop[beyond] = self.n
        if begin is not None:
            start, stop = np.clip(start, begin, end), np.clip(stop, begin, end)
        part, found = values & _U((1 << self.width) - 1), np.zeros(len(values), bool)
        some = np.flatnonzero(start < stop)
        while len(some):
            low, high = start[some], stop[some]
            middle = low + high >> 1
            here, wanted = self._lows(middle), part[some]
            less = here < wanted
            found[some] |= here == wanted  # of equal ones the first is where the search ends
            start[some] = low = np.where(less, middle + 1, low)
            stop[some] = high = np.where(less, high, middle)
            some = some[low < high]
        return start, found
