"""Names of columns and tables."""

from __future__ import annotations

import re
from collections.abc import Iterable


def column_names(raw: Iterable[object]) -> list[str]:
    """Lower case, white space and non-word characters to one underscore each run, none at the ends, unique."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, r in enumerate(raw):
        name = re.sub(r"\W", "_", re.sub(r"\s+", "_", str(r if r is not None else "").strip().lower())).strip("_") or f"col_{i}"
        base = name
        while name in seen:
            seen[base] += 1
            name = f"{base}_{seen[base]}"
        seen[name] = 0
        out.append(name)
    return out


def table_name(raw: str) -> str:
    name = re.sub(r"[^a-z0-9_]", "_", raw.lower()).strip("_") or "table"
    return f"t_{name}" if name[0].isdigit() else name


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, or with the least number that makes it free."""
    taken, n = set(taken), 1
    out = name
    while out in taken:
        n += 1
        out = f"{name}_{n}"
    return out
