"""CSV in the dialect of the mapping tools: doubled quotes and backslash escapes in one file, multi-line fields.

Spark's reader cannot do both in one file, so a Python data source streams each file in a task
of its own.  ``fast=True`` uses Spark's splittable reader for files without backslash escapes.
"""

from __future__ import annotations

import io
import string
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.literals import blank_to_null


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = "\\"
    header: bool = True


class RaggedRow(ValueError):
    """A row with another number of fields than the header."""


def records(chunks: Iterator[str], dialect: Dialect) -> Iterator[list[str]]:
    """Records of a text that comes in chunks; empty lines are skipped."""
    delimiter, quote, escape = dialect.delimiter, dialect.quote, dialect.escape
    row: list[str] = []
    field: list[str] = []
    state = "start"  # start of field, plain, quoted, escaped, closed
    seen = False
    skip_newline = False
    for chunk in chunks:
        for c in chunk:
            if skip_newline:
                skip_newline = False
                if c == "\n":
                    continue
            if state == "quoted":
                if escape is not None and c == escape and escape != quote:
                    state = "escaped"
                elif c == quote:
                    state = "closed"
                else:
                    field.append(c)
                continue
            if state == "escaped":
                field.append(c)
                state = "quoted"
                continue
            if c == quote and state == "start":
                state, seen = "quoted", True
            elif c == quote and state == "closed":
                field.append(c)
                state = "quoted"
            elif c == delimiter:
                row.append("".join(field))
                field, state, seen = [], "start", True
            elif c in "\r\n":
                skip_newline = c == "\r"
                if row or field or seen:
                    row.append("".join(field))
                    yield row
                row, field, state, seen = [], [], "start", False
            else:
                field.append(c)
                state = "plain" if state in ("start", "plain") else state
    if row or field or seen:
        row.append("".join(field))
        yield row


def chunks_of(path: str, size: int = 1 << 20) -> Iterator[str]:
    """A file's text, read piece by piece; a byte order mark is dropped."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        raw = system.open_input_stream(inner)
    else:
        raw = open(path.removeprefix("file://"), "rb")
    with raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as text:
        while chunk := text.read(size):
            yield chunk


def header_names(names: list[str], upper: bool = False) -> list[str]:
    """Column names: trimmed, without quotes, optionally in upper case."""
    out = [n.strip().replace('"', "") for n in names]
    return [n.upper() for n in out] if upper else out


def letter_names(n: int) -> list[str]:
    """Names of columns without a header: a-z, then A-Z."""
    letters = string.ascii_lowercase + string.ascii_uppercase
    if n > len(letters):
        raise ValueError(f"{n} columns without a header: there are names for {len(letters)}")
    return list(letters[:n])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], width: int, dialect: Dialect):
        self.paths, self.width, self.dialect = paths, width, dialect

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        number = 0
        for k, row in enumerate(records(chunks_of(partition.value), self.dialect)):
            if k == 0 and self.dialect.header:
                continue
            number += 1
            if len(row) != self.width:
                raise RaggedRow(f"{partition.value}: row {number} has {len(row)} fields, the first has {self.width}")
            yield tuple(row)


class DialectCsv(DataSource):
    """``spark.read.format("dialect_csv")``; options paths (line feeds between), width, delimiter, quote, escape, header."""

    @classmethod
    def name(cls):
        return "dialect_csv"

    def schema(self):
        return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(int(self.options["width"]))])

    def reader(self, schema):
        o = self.options
        dialect = Dialect(o.get("delimiter", ","), o.get("quote", '"'), o.get("escape", "\\") or None, o.get("header", "true") == "true")
        return _Reader(o["paths"].split("\n"), int(o["width"]), dialect)


def read_csv(
    spark: SparkSession,
    *paths: str,
    delimiter: str = ",",
    quote: str = '"',
    escape: str | None = "\\",
    header: bool = True,
    upper: bool = False,
    bind_empty: bool = False,
    limit: int | None = None,
    fast: bool = False,
) -> DataFrame:
    """All-text rows of CSV files with equal columns; blank cells are null unless ``bind_empty``."""
    dialect = Dialect(delimiter, quote, escape, header)
    first = next(records(chunks_of(paths[0]), dialect), None)
    if first is None:
        return spark.createDataFrame([], "a string")
    names = header_names(first, upper) if header else letter_names(len(first))
    if len(set(names)) < len(names):
        raise ValueError(f"two columns have one name: {', '.join(n for n in names if names.count(n) > 1)}")
    if fast:
        df = spark.read.csv(list(paths), sep=delimiter, quote=quote, escape=quote, header=header, multiLine=True, mode="FAILFAST", nullValue="\u0001", emptyValue="")
        df = df.toDF(*names)
    else:
        spark.dataSource.register(DialectCsv)
        reader = spark.read.format("dialect_csv").option("paths", "\n".join(paths)).option("width", str(len(first))).option("delimiter", delimiter).option("quote", quote)
        df = reader.option("escape", escape or "").option("header", str(header).lower()).load().toDF(*names)
    if limit is not None:
        df = df.limit(limit)
    return df if bind_empty else df.select(*[blank_to_null(F.col(f"`{n}`")).alias(n) for n in names])
