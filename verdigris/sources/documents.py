"""YAML and JSON documents that a driver reads: templates, configurations, instances; and datasets that may be absent."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from verdigris.functions.prompts import TemplateError

try:
    import yaml
except ImportError:  # JSON documents are read without it
    yaml = None


class SkippedDataset(Exception):
    """A dataset that cannot be read here, and why; the run goes on without it."""


def document(path: str | Path) -> Any:
    """A YAML or JSON document, gzipped or not; bytes that are not UTF-8 are replaced."""
    where = Path(path)
    raw = where.read_bytes()
    plain = where.with_suffix("") if where.suffix == ".gz" else where
    body = (raw if plain is where else gzip.decompress(raw)).decode("utf-8", errors="replace")
    if plain.suffix == ".json":
        return json.loads(body)
    if yaml is None:
        raise SkippedDataset(f"{where.name}: no YAML reader is installed")
    return yaml.load(body, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def first_existing(paths: Iterable[str | Path]) -> Path | None:
    return next((p for p in map(Path, paths) if p.exists()), None)


def loaded(loaders: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables by name, reasons by name): datasets whose files are missing or broken are skipped with their reason.

    Each loader's schema is asked for, and its first row, so that a file that
    cannot be parsed shows here and not in the middle of a run.
    """
    tables, skipped = {}, {}
    for name, load in loaders.items():
        try:
            df = load()
            df.head(1)
            tables[name] = df
        except (SkippedDataset, OSError, ValueError, PySparkException) as why:
            skipped[name] = str(why).strip().splitlines()[0][:300] if str(why).strip() else type(why).__name__
    return tables, skipped


def templates(directories: Iterable[str | Path]) -> dict[str, dict]:
    """Prompt templates by id, from all documents below the directories, in order of path.

    A document is one template or has a list of them under `templates`.  Each
    needs id and messages, each message role and content; ids are unique.
    """
    found: dict[str, dict] = {}
    for root in map(Path, directories):
        if not root.is_dir():
            raise TemplateError(f"no directory of templates: {root}")
        for path in sorted(p for p in root.rglob("*") if p.suffix in (".yaml", ".yml", ".json")):
            held = document(path)
            listed = held.get("templates") if isinstance(held, dict) else None
            for one in listed if isinstance(listed, list) else [held]:
                messages = one.get("messages") if isinstance(one, dict) else None
                if not messages or "id" not in one or not all(isinstance(m, dict) and {"role", "content"} <= m.keys() for m in messages):
                    raise TemplateError(f"{path}: a template needs id, and messages with role and content")
                name = str(one["id"])
                if name in found:
                    raise TemplateError(f"{name} is in {found[name]['source_path']} and in {path}")
                found[name] = one | {"version": str(one.get("version", "1.0")), "source_path": str(path)}
    return found


def instances(payload: Any, needed: tuple[str, ...]) -> tuple[list[dict], dict[str, int]]:
    """(whole instances, how many lack each field): instances of a document that have every needed field."""
    rows = payload if isinstance(payload, list) else list(payload.values()) if isinstance(payload, dict) else []
    whole, lacking = [], dict.fromkeys(needed, 0)
    for row in rows:
        gaps = [n for n in needed if not isinstance(row, dict) or row.get(n) in (None, "", [], {})]
        for n in gaps:
            lacking[n] += 1
        if not gaps:
            whole.append(row)
    return whole, lacking
