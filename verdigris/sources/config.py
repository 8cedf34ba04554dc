"""Run configurations, read on the driver: layers that extend each other, placeholders, dotted overrides.  Files are JSON or YAML."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from pathlib import Path

from verdigris.sources.documents import document
from verdigris.sources.readers import deep_merge

#: Words that stay text in an override, though other readers take them for truth values.
TRUTH_WORDS = ("on", "off", "yes", "no")


class ConfigError(ValueError):
    """A configuration that cannot be read."""


def load_layers(path: str | Path, above: tuple[Path, ...] = ()) -> dict:
    """The file over all that it extends, parents first; `_source_files` lists them in order."""
    here = Path(path).resolve()
    if here in above:
        raise ConfigError(f"{here} extends itself through {[p.name for p in above]}")
    own = document(here) or {}
    parents = own.pop("extends", None) or []
    layers = [load_layers(here.parent / p, (*above, here)) for p in ([parents] if isinstance(parents, str) else parents)]
    out: dict = {}
    for layer in [*layers, own]:
        out = deep_merge(out, {k: v for k, v in layer.items() if k != "_source_files"})
    return out | {"_source_files": [f for layer in layers for f in layer["_source_files"]] + [str(here)]}


def interpolate(value: object, kinds: Mapping[str, Callable[[str], str | None]] | None = None) -> object:
    """Values with their placeholders ${kind:name|fallback} resolved, innermost first.

    `env` reads the environment and `file` a file's text; a placeholder that
    gives nothing and has no fallback is an error, as is one that never closes.
    """
    known = {"env": os.environ.get, "file": lambda p: Path(p).read_text(encoding="utf-8").strip() if Path(p).is_file() else None} | dict(kinds or {})
    if isinstance(value, dict):
        return {k: interpolate(v, kinds) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, kinds) for v in value]
    if not isinstance(value, str):
        return value

    def resolve(found: re.Match) -> str:
        kind, _, rest = found[1].partition(":")
        name, bar, fallback = rest.partition("|")
        if kind not in known:
            raise ConfigError(f"unknown placeholder {kind!r}")
        got = known[kind](name)
        if got is None and not bar:
            raise ConfigError(f"nothing for {kind}:{name}")
        # what came out may not be read as a placeholder again
        done.append(fallback if got is None else got)
        return f"\0{len(done) - 1}\0"

    done: list[str] = []
    while (smaller := re.sub(r"\$\{([^${}]*)\}", resolve, value)) != value:
        value = smaller
    if "${" in value:
        raise ConfigError(f"a placeholder in {value!r} never closes")
    while "\0" in value:
        value = re.sub("\0(\\d+)\0", lambda m: done[int(m[1])], value)
    return value


def dotted(settings: dict, override: str) -> dict:
    """The settings with a.b.c=value in place; the value is JSON where it is that, else text."""
    path, _, raw = override.partition("=")
    raw = raw.strip()
    try:
        value = raw if raw.lower() in TRUTH_WORDS else json.loads(raw)
    except ValueError:
        value = raw
    *outer, last = path.split(".")
    node = settings
    for key in outer:
        node = node.get(key, {}) if isinstance(node, dict) else None
    if not isinstance(node, dict):
        raise ConfigError(f"{path}: not a mapping on the way")
    nested: dict = {last: value}
    for key in reversed(outer):
        nested = {key: nested}
    return deep_merge(settings, nested)
