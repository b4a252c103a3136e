"""Workbooks, read from their zipped XML: cached values, one table a sheet."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from .text import SourceError, table_from_rows

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _number(text: str, dated: bool, epoch: dt.datetime) -> str:
    value = float(text)
    if dated:
        when = epoch + dt.timedelta(days=value)
        return when.date().isoformat() if value == int(value) else when.replace(microsecond=0).isoformat(" ")
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheets(data: bytes) -> dict[str, tuple[list[list[str]], list[int]]]:
    """For each sheet: rows of cells as text, and columns that hold a formula without a cached value."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        root = ET.fromstring(book.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise SourceError("the file is no workbook") from e
    names = set(book.namelist())
    strings = []
    if "xl/sharedStrings.xml" in names:
        strings = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ET.fromstring(book.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_M}numFmt")}
        shows_date = lambda i: i in _DATE_FORMATS or bool(re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(i, "")), re.I)) and i in own
        xfs = styles.find(f"{_M}cellXfs")
        dated = [shows_date(int(x.get("numFmtId", 0))) for x in (xfs if xfs is not None else [])]
    props = root.find(f"{_M}workbookPr")
    epoch = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for sheet in root.iter(f"{_M}sheet"):
        target = targets[sheet.get(_R)]
        target = target if target.startswith("xl/") else f"xl/{target}"
        rows, uncached = [], set()
        for row in ET.fromstring(book.read(target)).iter(f"{_M}row"):
            cells: list[str] = []
            for i, c in enumerate(row.iter(f"{_M}c")):
                at = _column(c.get("r")) if c.get("r") else i
                cells += [""] * (at + 1 - len(cells))
                value, kind = c.find(f"{_M}v"), c.get("t", "n")
                text = value.text if value is not None and value.text is not None else ""
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif c.find(f"{_M}f") is not None and not text:
                    uncached.add(at)
                elif kind == "s" and text:
                    text = strings[int(text)]
                elif kind == "b":
                    text = "True" if text == "1" else "False"
                elif kind == "n" and text:
                    style = int(c.get("s", 0))
                    text = _number(text, style < len(dated) and dated[style], epoch)
                cells[at] = text
            if any(x.strip() for x in cells):
                rows.append(cells)
        out[sheet.get("name")] = (rows, sorted(uncached))
    return out


def read_bytes(spark: SparkSession, data: bytes) -> dict[str, tuple[DataFrame, list[str], str]]:
    """{sheet: (table, raw names, warning)}; blank sheets and those with a header alone are left out."""
    out = {}
    for name, (rows, uncached) in sheets(data).items():
        if len(rows) < 2:
            continue
        warning = ""
        if uncached:
            head = rows[0]
            named = ", ".join(head[i] if i < len(head) and head[i] else f"column {i + 1}" for i in uncached)
            warning = f"formulas without a stored value: {named}"
        df, raw = table_from_rows(spark, [list(r) for r in rows])
        out[name] = (df, raw, warning)
    if not out:
        raise SourceError("the workbook has no table")
    return out
