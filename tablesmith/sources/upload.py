"""Uploads: files by their extension, each failing alone."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from . import json_, text, xlsx
from .naming import free_name, table_name

TEXT_TYPES, BOOK_TYPES, JSON_TYPES = (".csv", ".tsv", ".txt"), (".xlsx", ".xls"), (".json",)
TYPES = (*TEXT_TYPES, *BOOK_TYPES, *JSON_TYPES)


@dataclass
class Upload:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    raw_names: dict[str, list[str]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def read(spark: SparkSession, files: Iterable[tuple[str, bytes]], taken: Iterable[str] = ()) -> Upload:
    """All tables of all files under free names; a file that can't be read is an error and leaves the others alone."""
    out, taken = Upload(), set(taken)
    for name, data in files:
        stem, kind = PurePath(name).stem, PurePath(name).suffix.lower()
        try:
            if kind in BOOK_TYPES:
                found = xlsx.read_bytes(spark, data)
                found = {stem if len(found) == 1 else sheet: x for sheet, x in found.items()}
            elif kind in JSON_TYPES:
                found = {stem: json_.read_bytes(spark, data)}
            elif kind in TEXT_TYPES:
                found = {stem: text.read_bytes(spark, data)}
            else:
                raise text.SourceError(f"files of type {kind or 'none'} aren't read")
        except text.SourceError as e:
            out.errors[name] = str(e)
            continue
        for base, (df, raw, note) in found.items():
            t = free_name(table_name(base), taken | out.tables.keys())
            out.tables[t], out.raw_names[t] = df, raw
            if note:
                out.notes[t] = note
    return out
