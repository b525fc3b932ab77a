"""Configuration and rule dictionaries: small files, read on the driver at plan time."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path
from typing import Any


def _parsed(path: Path) -> Any:
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml  # only for YAML files

        return yaml.safe_load(text)
    return json.loads(text)


def merged(given: Any, defaults: Any) -> Any:
    """`given` with what it lacks from `defaults`, key by key at every level; null counts as lacking."""
    if isinstance(defaults, dict):
        own = given if isinstance(given, dict) else {}
        return {**own, **{k: merged(own.get(k), v) for k, v in defaults.items()}}
    return defaults if given is None else given


def load_config(path: str, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """A YAML or JSON object with defaults filled in; a missing or empty file gives the defaults."""
    p = Path(path)
    got = _parsed(p) if p.exists() else None
    if got is not None and not isinstance(got, dict):
        raise ValueError(f"{path}: not an object")
    return merged(got, defaults or {})


@lru_cache(maxsize=32)
def _cached(path: str, changed: float) -> str:
    return json.dumps(load_config(path))


def load_rules(path: str, defaults: dict[str, list[str]]) -> dict[str, list[str]]:
    """Named term lists, read once for each version of the file; every list without blanks and repeats, in order."""
    p = Path(path)
    got = merged(json.loads(_cached(path, p.stat().st_mtime)) if p.exists() else {}, defaults)
    return {k: list(dict.fromkeys(str(t).strip() for t in v if t is not None and str(t).strip())) for k, v in got.items() if isinstance(v, list)}


def masked(secret: str | None) -> str:
    """A secret's first and last four characters; of eight or fewer the first and last alone."""
    s = secret or ""
    return f"{s[:1]}***{s[-1:]}" if len(s) <= 8 else f"{s[:4]}***{s[-4:]}"


def is_placeholder(value: str) -> bool:
    """Whether a setting still holds the template's text."""
    low = value.strip().lower()
    return "your-" in low or "your_" in low
