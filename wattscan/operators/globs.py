"""Ignore globs, as one pattern that columns and walks share."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattscan.functions.paths import normal

PRUNED = (".git", "node_modules")  # fixed values


def _tokens(glob: str) -> list[str]:
    """A glob as pieces of a pattern, one for each wildcard, set or character; ``*`` crosses ``/``, and ``!`` negates a set."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else ("\\" + body if body[0] == "^" else body)) + "]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w/ ])", r"\\\1", c))
    return out


def _slash_taken(tokens: list[str]) -> list[list[str]]:
    """What is left of a glob for a path without a leading slash, once the glob has matched one."""
    if not tokens:
        return []
    head, rest = tokens[0], tokens[1:]
    if head == ".*":
        return [tokens, *_slash_taken(rest)]
    takes = head in ("/", ".") or head[0] == "[" and re.fullmatch(head, "/")
    return [rest] if takes else []


def _tree(globs: list[list[str]]) -> dict:
    """Globs by their leading literal folders: folder -> tree, and under ``""`` what is left of those that end there."""
    root: dict = {"": []}
    for tokens in globs:
        node, at = root, 0
        while "/" in tokens[at:]:
            to = tokens.index("/", at) + 1
            part = tokens[at:to]
            if any(t == ".*" or t == "." or t[0] == "[" for t in part):
                break
            node, at = node.setdefault("".join(part), {"": []}), to
        node[""].append("".join(tokens[at:]))
    return root


def _pattern(node: dict) -> str:
    ways = [*dict.fromkeys(node[""]), *(folder + _pattern(below) for folder, below in node.items() if folder)]
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


@functools.lru_cache(64)
def compiled(globs: tuple[str, ...]) -> str:
    """All globs as one pattern for a whole path, with or without a leading slash; leading literal folders are looked at once.

    Java and Python read it alike. No globs match nothing.
    """
    ways = []
    for glob in globs:
        tokens = _tokens(glob)
        ways += [tokens, *_slash_taken(tokens)]
    return _pattern(_tree(ways)) if ways else "(?!)"


@functools.lru_cache(64)
def _whole(globs: tuple[str, ...]) -> re.Pattern:
    return re.compile(compiled(globs), re.S)


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a path, in its normal form and with or without a leading slash, matches any glob: one pattern for all."""
    return normal(path).rlike(rf"(?s)\A(?:{compiled(tuple(globs))})\z") if globs else F.lit(False)


def ignored_path(path: str, globs: list[str]) -> bool:
    return _whole(tuple(globs)).fullmatch(path) is not None


def prunable(globs: list[str]) -> list[str]:
    """The base of each glob of the form ``<base>/*`` or ``<base>/**``, wildcards and all: it rules out whole the folders that match it."""
    bases = [g.rstrip("*")[:-1] for g in globs if re.search(r".+/\*+\Z", g, re.S)]
    return list(dict.fromkeys(b for b in bases if b))


def braces(glob: str) -> list[str]:
    """``{a,b}`` alternatives written out, the innermost first."""
    if m := re.search(r"\{([^{}]*)\}", glob):
        return list(dict.fromkeys(x for part in m[1].split(",") for x in braces(glob[: m.start()] + part + glob[m.end() :])))
    return [glob]


def union(*lists: list[str]) -> list[str]:
    """Globs of the configuration, the call and the editor as one list; the first of equal ones stays."""
    return list(dict.fromkeys(g for each in lists for g in each))


def editor_excludes(files: dict[str, object], search: dict[str, object], root: str) -> list[str]:
    """The two exclude settings of an editor as ignore globs; a key that either sets to true counts."""
    return editor_globs({k: files.get(k) is True or search.get(k) is True for k in [*files, *search]}, root)


def editor_globs(excludes: dict[str, object], root: str) -> list[str]:
    """Editor exclude settings as ignore globs below ``root``; only values that are true count."""
    out = []
    for key in (k for k, v in excludes.items() if v is True):
        for glob in braces(key):
            base = re.sub(r"(?:/\*\*)?/*$", "", glob).replace("**", "*")
            if base:
                out += [f"{root.rstrip('/')}/{base}", f"{root.rstrip('/')}/{base}/*"]
    return out
