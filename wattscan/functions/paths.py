"""Normal forms of paths, as column expressions and for walks."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A store's scheme and its two slashes stay as they are.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_LOOSE = r"(^|/)\.(/|$)|//|.+/$"
_UP = r"(^|/)\.\.(/|$)"


def _parts(path: str, up: bool) -> str:
    head = "/" if path.startswith("/") else ""
    kept: list[str] = []
    for part in path.split("/"):
        if up and part == ".." and (head or kept and kept[-1] != ".."):
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return head + "/".join(kept) or "."


def _split(path: str) -> tuple[str, str]:
    scheme = re.match(SCHEME, path)
    return (scheme[0], path[scheme.end() :]) if scheme else ("", path)


def normal_path(path: str) -> str:
    """A path without ``.`` parts, empty parts and a trailing slash; ``..`` stays. The empty path is ``.``."""
    scheme, rest = _split(path)
    return scheme + _parts(rest, False)


def resolved_path(path: str, cwd: str | None = None) -> str:
    """A path from the root on, without ``.`` and ``..``; a relative one is taken from ``cwd``. Links aren't followed."""
    scheme, rest = _split(path)
    if scheme or rest.startswith("/"):
        return scheme + _parts(rest, True)
    base, below = _split(os.getcwd() if cwd is None else cwd)
    return base + _parts(f"{below}/{rest}", True)


def _folded(path: Column, up: bool) -> Column:
    """The parts of a path put together anew; only paths that need it come here."""
    rooted = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        more = F.when((part == "") | (part == "."), kept).otherwise(F.concat(kept, F.array(part)))
        if not up:
            return more
        last = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(".."))
        poppable = (part == "..") & (rooted | (last != ".."))
        return F.when(poppable, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(more)

    joined = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    whole = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(whole == "", ".").otherwise(whole)


def _with_scheme(path: Column, fold) -> Column:
    scheme = F.regexp_extract(path, SCHEME, 0)
    return F.when(scheme != "", F.concat(scheme, fold(F.substring(path, F.length(scheme) + 1, F.length(path))))).otherwise(fold(path))


def normal(path: Column) -> Column:
    """``normal_path`` of a column."""
    loose = F.regexp_replace(path, SCHEME, "").rlike(_LOOSE) | (path == "")
    return F.when(loose, _with_scheme(path, lambda p: _folded(p, False))).otherwise(path)


def resolved(path: Column, cwd: str | None = None) -> Column:
    """``resolved_path`` of a column; ``cwd`` is by default the driver's folder."""
    base = F.lit(resolved_path(".", cwd).rstrip("/") + "/")
    whole = F.when(path.rlike(SCHEME) | F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, path))
    loose = F.regexp_replace(whole, SCHEME, "").rlike(f"{_LOOSE}|{_UP}")
    return F.when(loose, _with_scheme(whole, lambda p: _folded(p, True))).otherwise(whole)


def below(path: Column, root: str, cwd: str | None = None) -> Column:
    """A path relative to ``root`` where it is below it, both resolved; else its normal form as given."""
    base = resolved_path(root or ".", cwd).rstrip("/") + "/"
    whole = resolved(path, cwd)
    return F.when(F.startswith(whole, F.lit(base)), F.substring(whole, F.lit(len(base) + 1), F.length(whole))).otherwise(normal(path))
