"""The scan configuration file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field


DEFAULT = ".wattscan.toml"


@dataclass(frozen=True)
class Config:
    disable: tuple[str, ...] = ()
    ignore: list[str] = field(default_factory=list)


def load_config(path: str | None = None) -> Config:
    """``disable`` and ``ignore`` of a TOML file, by default of ``DEFAULT`` here.

    A missing file changes nothing, a malformed one raises ``SystemExit``; list items are taken as strings.
    """
    path = path or DEFAULT
    if not os.path.isfile(path):
        return Config()
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    except tomllib.TOMLDecodeError as error:
        raise SystemExit(f"{path}: {error}") from error
    for key in ("disable", "ignore"):
        if not isinstance(found.get(key, []), list):
            raise SystemExit(f"{path}: {key} must be a list")
    return Config(tuple(map(str, found.get("disable", []))), [str(x) for x in found.get("ignore", [])])
