"""Literals that every match of a pattern holds: a text without any of them needs no regular expression."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters beyond ASCII that match ASCII letters where case doesn't count, and those letters.
_ODD, _PLAIN = "ſKıİ", "skii"


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """Of several sets, each of which holds a literal of every match, the one whose shortest literal is longest."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _of(items) -> frozenset[str] | None:
    found, run = [], ""

    def ended() -> None:
        nonlocal run
        if run.strip():
            found.append(frozenset([run]))
        run = ""

    for op, value in items:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value)
            continue
        ended()
        inner = None
        if name == "SUBPATTERN":
            inner = _of(value[-1])
        elif name == "ATOMIC_GROUP":
            inner = _of(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _of(value[2])
        elif name == "BRANCH":
            ways = [_of(way) for way in value[1]]
            inner = frozenset().union(*ways) if all(ways) else None
        if inner:
            found.append(inner)
    ended()
    return _best(found)


@functools.lru_cache(256)
def required(pattern: str, flags: str = "") -> tuple[str, ...]:
    """Literals of which every match of a pattern holds one, in lower case where case doesn't count; none if that can't be told."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError):
        return ()
    if parsed.state.flags & re.IGNORECASE and "i" not in flags or "(?i" in pattern:
        return ()
    found = _of(parsed) or ()
    return tuple(sorted({x.lower() if "i" in flags else x for x in found}))


def folded(text: Column) -> Column:
    """A text in which lower-case literals are found wherever a pattern without case would find them."""
    return F.lower(F.translate(text, _ODD, _PLAIN))
