"""Strict configuration: version 1, known keys only, no nulls, checked globs and limits."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

SEVERITIES = ("deny", "warn", "off")
POLICIES = ("E101", "E102", "V101", "V102", "S102")


class ConfigError(ValueError):
    """What is wrong with a configuration, and where."""


@dataclass(frozen=True)
class Config:
    """Effective settings; the defaults are those of an empty configuration."""

    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    min_clone_lines: int = 10
    sloc_growth: bool = True
    severity: dict = field(default_factory=lambda: {p: "warn" if p == "S102" else "deny" for p in POLICIES})
    caps: dict = field(default_factory=lambda: {"terminal": 50, "agent": 30, "github": 10})


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ConfigError("a key occurs twice")
    return out


def _globs(value: object, where: str, may_be_empty: bool) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{where}: a list of globs is wanted")
    if not value and not may_be_empty:
        raise ConfigError(f"{where}: an empty list takes everything out of scope")
    for g in value:
        if not g.strip() or g.startswith("!"):
            raise ConfigError(f"{where}: {g!r} is empty or negated")
    return tuple(value)


def parse(text: str) -> Config:
    """A configuration in JSON (a subset of YAML)."""
    try:
        raw = json.loads(text, object_pairs_hook=_unique)
    except json.JSONDecodeError as e:
        raise ConfigError(f"line {e.lineno}: {e.msg}") from e
    if not isinstance(raw, dict) or raw.get("version") != 1 or isinstance(raw["version"], bool):
        raise ConfigError("version: 1 is wanted")
    known = {"version", "include", "exclude", "min_clone_lines", "sloc_growth", "severity", "caps"}
    for key, value in raw.items():
        if key not in known:
            raise ConfigError(f"{key}: unknown")
        if value is None:
            raise ConfigError(f"{key}: null")
    base = Config()
    limit = raw.get("min_clone_lines", base.min_clone_lines)
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise ConfigError("min_clone_lines: a positive number is wanted")
    growth = raw.get("sloc_growth", True)
    if not isinstance(growth, bool):
        raise ConfigError("sloc_growth: true or false is wanted")
    return Config(
        include=_globs(raw["include"], "include", False) if "include" in raw else None, exclude=_globs(raw.get("exclude", []), "exclude", True), min_clone_lines=limit, sloc_growth=growth,
        severity=base.severity | _table(raw.get("severity", {}), "severity", POLICIES, lambda v: v in SEVERITIES),
        caps=base.caps | _table(raw.get("caps", {}), "caps", tuple(base.caps), lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0),
    )


def _table(value: object, where: str, keys: tuple[str, ...], good) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"{where}: a table is wanted")
    for k, v in value.items():
        if k not in keys or not good(v):
            raise ConfigError(f"{where}.{k}: {v!r} is not allowed")
    return value
