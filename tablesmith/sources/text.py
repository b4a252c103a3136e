"""Delimited text: uploads by their bytes, large files by Spark's reader with the layout found in their first rows."""

from __future__ import annotations

import codecs
import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import ROW_ID
from ..operators.numbering import gapless
from .layout import FOOT_ROWS, HEAD_ROWS, footer_rows, header
from .naming import column_names

DELIMITERS = ",;\t|"


class SourceError(ValueError):
    """A file that holds no table."""


def decoded(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8, else the likeliest encoding, else Latin-1."""
    for mark, name in ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    body = data.removeprefix(codecs.BOM_UTF8)
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return body.decode("latin-1")
    best = from_bytes(body).best()
    return str(best) if best is not None else body.decode("latin-1")


def delimiter(text: str) -> str:
    """By the csv module's sniffer over the first 20 lines, else the commonest candidate of the first filled one."""
    lines = [x for x in text.splitlines()[:20] if x.strip()]
    try:
        return csv.Sniffer().sniff("\n".join(lines), DELIMITERS).delimiter
    except csv.Error:
        counts = {d: lines[0].count(d) for d in DELIMITERS} if lines else {}
        best = max(counts, key=counts.get, default=",")
        return best if counts.get(best) else ","


def rows_of(text: str) -> list[list[str]]:
    csv.field_size_limit(1 << 30)
    return [r for r in csv.reader(io.StringIO(text), delimiter=delimiter(text)) if any(c.strip() for c in r)]


def framed(spark: SparkSession, names: list[str], rows: list[list[str | None]]) -> DataFrame:
    schema = T.StructType([T.StructField(ROW_ID, T.LongType(), False), *[T.StructField(n, T.StringType()) for n in names]])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def table_from_rows(spark: SparkSession, rows: list[list[str]]) -> tuple[DataFrame, list[str]]:
    """The table within rows of cells: header found, rows made equally wide, empty columns and footers gone; raw names."""
    head, skip = header(rows)
    while head and not head[-1].strip() and all(len(r) < len(head) or not r[len(head) - 1].strip() for r in rows[skip:]):
        head = head[:-1]
    body = [(r + [""] * len(head))[: len(head)] for r in rows[skip:]]
    body = body[: len(body) - footer_rows(body)] if body else body
    keep = [i for i in range(len(head)) if not body or any(r[i].strip() for r in body)]
    raw = [head[i] for i in keep]
    return framed(spark, column_names(raw), [[r[i] for i in keep] for r in body]), raw


def read_bytes(spark: SparkSession, data: bytes) -> tuple[DataFrame, list[str], str]:
    """An uploaded CSV, TSV or text file as strings: (table, raw names, note)."""
    if not data.strip():
        raise SourceError("the file is empty")
    text = decoded(data)
    if "\0" in text:
        raise SourceError("the file isn't tabular text")
    rows = rows_of(text)
    if not rows:
        raise SourceError("the file is empty")
    df, raw = table_from_rows(spark, rows)
    return df, raw, "" if len(rows) > 1 else "the file has a header and no rows"


def scan(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """A large delimited file as strings with row ids in file order; columns without any cell are left out.

    Only its first rows and the last five come to the driver, for the layout.
    """
    source = spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begins"))
    # Files are read largest first: the head is that of the first by name.
    start = source.agg(F.min("file")).first()[0]
    lines = [r[0] for r in source.where((F.col("file") == start) & (F.col("begins") == 0)).select("value").limit(4 * HEAD_ROWS).collect()]
    sep = delimiter("\n".join(lines))
    sample = [r for r in csv.reader(lines, delimiter=sep) if any(c.strip() for c in r)]
    if not sample:
        raise SourceError("the file is empty")
    head, skip = header(sample)
    names = column_names(head)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).options(sep=sep, quote='"', escape='"', multiLine=multi_line, encoding=encoding, mode="PERMISSIVE")
    filled = {n: F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))) != "" for n in names}
    df = reader.csv(path).where(F.exists(F.array(*filled.values()), lambda x: x))
    # File order: splits by where they begin, rows by the order in which a split is read. Rows travel as one struct.
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")
    placed = df.select(row, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begins"), F.monotonically_increasing_id().alias("at"))
    starts = placed.groupBy("file", "begins").agg(F.min("at").alias("low")).orderBy("file", "begins").collect()  # a row for each split
    order = spark.createDataFrame([(r["file"], r["begins"], i, r["low"]) for i, r in enumerate(starts)], "file string, begins long, i long, low long")
    placed = placed.join(F.broadcast(order), ["file", "begins"]).select("row", (F.col("i") * (1 << 33) + (F.col("at") - F.col("low"))).alias("at"))
    numbered = gapless(placed, "at").where(F.col("at") >= skip).select(F.col("at").alias(ROW_ID), "row.*")
    last = [[r[n] or "" for n in names] for r in reversed(numbered.orderBy(F.desc(ROW_ID)).limit(FOOT_ROWS).collect())]
    top = numbered.agg(F.max(ROW_ID)).first()[0]
    body = numbered if top is None else numbered.where(F.col(ROW_ID) <= top - footer_rows(last))
    any_ = body.agg(F.count(F.lit(1)).alias("rows"), *[F.bool_or(x).alias(f"c{i}") for i, x in enumerate(filled.values())]).first()
    kept = [n for i, n in enumerate(names) if not any_["rows"] or any_[f"c{i}"]]
    return body.select((F.col(ROW_ID) - skip).alias(ROW_ID), *[F.col(f"`{n}`") for n in kept])
