"""JSON: objects flattened to columns. Uploads by their bytes; large files by Spark's reader and its schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .naming import column_names
from .text import SourceError, decoded, framed


def _text(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, list):
        return ", ".join("" if x is None else json.dumps(x) if isinstance(x, (dict, list)) else str(x) for x in v)
    return str(v)


def flat(obj: dict, prefix: str = "") -> dict[str, str | None]:
    """Nested keys joined by a dot; lists as text."""
    out: dict[str, str | None] = {}
    for k, v in obj.items():
        if isinstance(v, dict):
            out |= flat(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = _text(v)
    return out


def read_bytes(spark: SparkSession, data: bytes) -> tuple[DataFrame, list[str], str]:
    """A list of objects, or one object: a row for each, ragged keys NULL; other elements in a column ``value``."""
    try:
        root = json.loads(decoded(data))
    except json.JSONDecodeError as e:
        raise SourceError(f"the file is no JSON: {e.msg}") from e
    if not isinstance(root, (list, dict)):
        raise SourceError("the JSON holds no table")
    rows = [flat(x) if isinstance(x, dict) else {"value": _text(x)} for x in (root if isinstance(root, list) else [root])]
    raw = list(dict.fromkeys(k for r in rows for k in r))
    if not raw:
        raise SourceError("the JSON holds no table")
    return framed(spark, column_names(raw), [[r.get(k) for k in raw] for r in rows]), raw, ""


def flattened(df: DataFrame) -> DataFrame:
    """Struct fields as columns named along their path, arrays as joined text."""
    cols, names = [], []

    def walk(kind: T.DataType, c, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, c.getField(f.name), f"{path}.{f.name}")
            return
        if isinstance(kind, T.ArrayType):
            nested = isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))
            c = F.array_join(F.transform(c, lambda x: F.coalesce(F.to_json(x) if nested else x.cast("string"), F.lit(""))), ", ")
        elif isinstance(kind, T.MapType):
            c = F.to_json(c)
        cols.append(c)
        names.append(path)

    for f in df.schema.fields:
        walk(f.dataType, F.col(f"`{f.name}`"), f.name)
    return df.select(*[c.alias(n) for c, n in zip(cols, column_names(names), strict=True)])


def scan(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A large JSON file or folder, flattened."""
    return flattened(spark.read.option("multiLine", multi_line).json(path))
