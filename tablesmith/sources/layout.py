"""Where a sheet's header, data and footer are. All of it looks at the first rows and the last five only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

HEAD_ROWS, FOOT_ROWS = 15, 5
FOOTER = re.compile(r"^(total|grand total|subtotal|source|note|footnote|.*\*)", re.I)
_NUMBER = re.compile(r"^[\s(]*[-+]?[$€₹£¥₩₺]?\s*[\d.,]+\s*[%kmb]?[)\s]*$", re.I)
_YEAR = re.compile(r"^(19|20)\d\d$")


def numeric_cell(cell: str) -> bool:
    return bool(_NUMBER.match(cell)) and any(ch.isdigit() for ch in cell)


def _filled(row: Sequence[str]) -> list[str]:
    return [c.strip() for c in row if c and c.strip()]


def width_of(rows: Sequence[Sequence[str]]) -> int:
    """The commonest number of filled cells from the first to the last one of a row; the greater of equally common ones."""
    sizes = Counter(max((i + 1 for i, c in enumerate(r) if c and c.strip()), default=0) for r in rows)
    sizes.pop(0, None)
    return max(sizes, key=lambda w: (sizes[w], w)) if sizes else 0


def flattened(top: Sequence[str], below: Sequence[str]) -> list[str]:
    """Two header rows as one: a group's label is carried over the blanks after it and put before the field."""
    out, group = [], ""
    for i in range(max(len(top), len(below))):
        a = top[i].strip() if i < len(top) else ""
        b = below[i].strip() if i < len(below) else ""
        group = a or group
        out.append(b or group if not group or group == b or not b else f"{group}_{b}")
    return out


def header(rows: Sequence[Sequence[str]]) -> tuple[list[str], int]:
    """(header cells, how many leading rows are not data). Titles, blank rows and rows of numbers before it are passed over.

    A header of two rows has blanks (or years) beside at least two labels, and no number in the row below.
    """
    width = width_of(rows)
    if width <= 1:
        first = next((i for i, r in enumerate(rows) if _filled(r)), 0)
        return list(rows[first]) if rows else [], first + 1
    least = max(2, width // 2)
    for i, r in enumerate(rows[:HEAD_ROWS]):
        cells = _filled(r)
        if len(cells) < least:
            continue
        after = _filled(rows[i + 1]) if i + 1 < len(rows) else []
        numbers = sum(map(numeric_cell, cells))
        years = numbers and all(_YEAR.match(c) for c in cells if numeric_cell(c)) and numbers < len(cells)
        grouped = len(set(cells)) < len(cells) or len(cells) < width
        below_is_head = len(after) >= least and not any(map(numeric_cell, after))
        data_follows = i + 2 < len(rows) and any(map(numeric_cell, _filled(rows[i + 2])))
        if years and below_is_head and data_follows:
            return flattened(r, rows[i + 1]), i + 2
        if numbers >= 0.5 * len(cells):
            continue
        blanks = len(cells) < width
        if blanks and grouped and below_is_head and len(cells) >= 2 and len(after) > len(cells):
            return flattened(r, rows[i + 1]), i + 2
        if len(set(cells)) >= 2:
            return list(r), i + 1
    first = next((i for i, r in enumerate(rows) if len(_filled(r)) >= least), 0)
    return list(rows[first]), first + 1


def footer_rows(last: Sequence[Sequence[str]]) -> int:
    """How many of the last rows are footers: from the bottom, while the first cell says so."""
    n = 0
    for r in reversed(last[-FOOT_ROWS:]):
        if not r or not FOOTER.match((r[0] or "").strip()):
            break
        n += 1
    return n
