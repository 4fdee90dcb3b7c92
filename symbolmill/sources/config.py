"""Configuration reader and the section sink of generated guidance."""

from __future__ import annotations

import re
from typing import Any

DEFAULT_EXCLUDES = ["vendor/", "node_modules/", "cache/"]


def _snake(key: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key).lower()


def read_config(text: str) -> dict[str, Any]:
    """YAML with snake or camel keys; excludes are added to the defaults."""
    import yaml

    raw = {_snake(k): v for k, v in (yaml.safe_load(text) or {}).items()}
    return {
        "languages": raw.get("languages") or ["php", "sql"],
        "exclude": [*DEFAULT_EXCLUDES, *(raw.get("exclude") or [])],
        "additional_sources": raw.get("additional_sources") or {},
        "postgres": {_snake(k): v for k, v in (raw.get("postgres") or {}).items()},
    }


def inject_section(document: str, section: str, begin: str, end: str) -> str:
    """The section between its markers, replaced where they are, else appended; applying it twice changes nothing."""
    block = f"{begin}\n{section.strip()}\n{end}"
    start, stop = document.find(begin), document.find(end)
    if start >= 0 and stop > start:
        return re.sub(r"\n{3,}", "\n\n", document[:start] + block + document[stop + len(end) :])
    return (document.rstrip() + "\n\n" if document.strip() else "") + block + "\n"


def within(report: str, limit: int) -> str:
    """A report cut at whole lines to ``limit`` characters."""
    if len(report) <= limit:
        return report
    note = "\n... (shortened)\n"
    kept = report[: limit - len(note)]
    return kept[: kept.rfind("\n")] + note if "\n" in kept else kept + note
