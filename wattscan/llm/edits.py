"""Whether the edit distance of two word sequences is within a limit: exact, with bounds tried before the alignment."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Lengths of runs for the lower bound, and of those that anchor the upper one.
COUNTED, ANCHOR = (1, 2, 3), 3
#: Words more frequent than a text's length by this number keep a mask of it, so masks stay in proportion to the text.
MASKS = 512


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    out = words.astype(np.uint64) if size == 1 else np.zeros(max(len(words) - size + 1, 0), np.uint64)
    if size > 1:
        for j in range(size):
            out = (out ^ words[j : len(words) - size + 1 + j]) * _MUL
            out ^= out >> np.uint64(31)
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the common part of two bags."""
    (a, ca), (b, cb) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[at], cb[to]).sum())


def chained(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound: the cost of an alignment through a longest rising chain of runs that each text holds once."""
    x, y = _runs(a, ANCHOR), _runs(b, ANCHOR)
    (u, iu, cu), (v, iv, cv) = np.unique(x, return_index=True, return_counts=True), np.unique(y, return_index=True, return_counts=True)
    _, at, to = np.intersect1d(u[cu == 1], v[cv == 1], assume_unique=True, return_indices=True)
    i, j = iu[cu == 1][at], iv[cv == 1][to]
    order = np.argsort(i)
    i, j = i[order].tolist(), j[order].tolist()
    tails, ends, before = [], [], []
    for k, at_b in enumerate(j):
        place = bisect_left(tails, at_b)
        before.append(ends[place - 1] if place else -1)
        tails[place : place + 1] = [at_b]
        ends[place : place + 1] = [k]
    chain, k = [(len(a), len(b))], ends[-1] if ends else -1
    while k >= 0:
        chain.append((i[k], j[k]))
        k = before[k]
    cost, p, q = 0, 0, 0  # both texts are aligned up to here
    for s, t in reversed(chain):
        back = max(p - s, q - t, 0)  # runs overlap
        s, t = s + back, t + back
        if s - p == t - q:
            cost += int(np.count_nonzero(a[p:s] != b[q:t])) if s > p else 0
        else:
            cost += max(s - p, t - q)
        p, q = min(s + max(ANCHOR - back, 0), len(a)), min(t + max(ANCHOR - back, 0), len(b))
    return cost


def banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance if it is at most ``band``, else more than ``band``.

    The columns of the alignment are bit vectors of vertical differences, within ``band`` cells on either side of the
    main diagonal; the vectors move down a cell with each column.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > band:
        return band + 1
    if not m:
        return n
    band = min(band, n)
    width = 2 * band + 1
    _, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    mine, other = back[:n], back[n:].tolist()
    order = np.argsort(mine, kind="stable")
    cuts = np.searchsorted(mine[order], np.arange(back.max() + 2))
    frequent = {}
    for w in np.flatnonzero(np.diff(cuts) > max(8, n // MASKS)).tolist():
        bits = np.zeros(n, np.uint8)
        bits[order[cuts[w] : cuts[w + 1]]] = 1
        frequent[w] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, top = (1 << width) - 1, 1 << (width - 1)
    up = full ^ ((1 << band) - 1)  # cells from row 1 on: a column's distances grow downwards at first
    down = 0
    score = band  # of the lowest cell in the band; it goes down with the band to the last row, then along it
    for column, w in enumerate(other):
        lowest = column - band  # row of bit 0
        if w in frequent:
            same = frequent[w] >> lowest if lowest >= 0 else frequent[w] << -lowest
        else:
            same = 0
            for at in order[cuts[w] : cuts[w + 1]].tolist():
                if 0 <= at - lowest < width:
                    same |= 1 << (at - lowest)
        same &= full
        kept = ((((same & up) + up) ^ up) | same | down) & full  # diagonal steps without cost
        right, left = down | (full ^ (kept | up)), kept & up
        row = column + band
        if row < n:
            score += not kept & top
        else:
            at = 1 << (n - 1 - lowest)
            score += bool(right & at) - bool(left & at)
        moved = kept >> 1
        up, down = left | (full ^ (moved | right)), moved & right
    return score


def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether the edit distance is at most ``limit``."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = differ[0] if len(differ) else n
    a, b = a[head:], b[head:]
    n -= head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = differ[0] if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    longest = max(len(a), len(b))
    if not min(len(a), len(b)) or longest <= limit:
        return longest <= limit
    if abs(len(a) - len(b)) > limit:
        return False
    for size in COUNTED:  # an edit takes away so many runs at most
        if longest - size + 1 - _shared(_runs(a, size), _runs(b, size)) > size * limit:
            return False
    if len(a) == len(b) and np.count_nonzero(a != b) <= limit or chained(a, b) <= limit:
        return True
    return banded(a, b, limit) <= limit
