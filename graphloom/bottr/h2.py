"""The SQL subset and the CSV dialect of instance maps: SELECT [DISTINCT] items FROM CSVREAD('file' [, columns [, options]])."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources.csv import chunks_of


class QueryRefused(ValueError):
    """A query outside the subset."""


@dataclass
class CsvRead:
    items: list[tuple[str, str]]  # (column | constant | null | all, text)
    path: str
    distinct: bool = False
    columns: str | None = None
    options: dict[str, str] = field(default_factory=dict)


_SQL = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\")|(?P<word>[A-Za-z_]\w*)|(?P<op>[*(),;]))")


def parse_select(text: str) -> CsvRead:
    toks, at = [], 0
    text = text.strip().rstrip(";").rstrip()
    while at < len(text):
        m = _SQL.match(text, at)
        if not m:
            raise QueryRefused(f"only SELECT [DISTINCT] columns FROM CSVREAD('file') is read, found {text[at : at + 30]!r}")
        toks.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    toks.append(("end", ""))
    i = 0

    def word(*names: str) -> bool:
        return toks[i][0] == "word" and toks[i][1].upper() in names

    def refuse():
        raise QueryRefused(f"only SELECT [DISTINCT] columns FROM CSVREAD('file') is read, found {toks[i][1] or 'the end'!r}")

    if not word("SELECT"):
        refuse()
    i += 1
    out = CsvRead([], "")
    if word("DISTINCT"):
        out.distinct = True
        i += 1
    while True:
        kind, value = toks[i]
        if kind == "string":
            out.items.append(("constant", value[1:-1].replace("''", "'")))
        elif value == "*":
            out.items.append(("all", ""))
        elif word("NULL"):
            out.items.append(("null", ""))
        elif kind == "quoted":
            out.items.append(("column", value[1:-1].replace('""', '"')))
        elif kind == "word" and not word("FROM"):
            out.items.append(("column", value))
        else:
            refuse()
        i += 1
        if word("AS"):
            i += 1
            if toks[i][0] not in ("word", "quoted"):
                refuse()
            i += 1
        elif toks[i][0] in ("word", "quoted") and not word("FROM"):
            i += 1
        if toks[i][1] != ",":
            break
        i += 1
    if not word("FROM"):
        refuse()
    i += 1
    if not word("CSVREAD") or toks[i + 1][1] != "(":
        refuse()
    i += 2
    args = []
    while toks[i][0] == "string" or word("NULL"):
        args.append(None if word("NULL") else toks[i][1][1:-1].replace("''", "'"))
        i += 1
        if toks[i][1] != ",":
            break
        i += 1
    if toks[i][1] != ")" or not args or args[0] is None or len(args) > 3:
        refuse()
    i += 1
    if toks[i][0] != "end":
        refuse()
    out.path = args[0]
    out.columns = args[1] if len(args) > 1 else None
    if len(args) > 2 and args[2]:
        for part in re.findall(r"(\w+)=(\S*)", args[2]):
            out.options[part[0].lower()] = part[1]
    return out


def records(chunks: Iterator[str], delimiter: str = ",", quote: str = '"', escape: str = '"', comment: str | None = None, null: str = "") -> Iterator[list[str | None]]:
    """Records of the dialect: bare fields trimmed and null where empty, quoted ones as they are, text after a closing quote dropped."""
    row: list[str | None] = []
    field_text: list[str] = []
    state, quoted, line_start, skip = "start", False, True, False

    def finished() -> str | None:
        if quoted:
            return "".join(field_text)
        text = "".join(field_text).strip()
        return None if text == "" or (null and text == null) else text

    for chunk in chunks:
        for c in chunk:
            if skip:
                skip = False
                if c == "\n":
                    continue
            if state == "comment":
                if c in "\r\n":
                    state, line_start = "start", True
                continue
            if state == "quoted":
                if c == escape and escape != quote:
                    state = "escaped"
                elif c == quote:
                    state = "closed"
                else:
                    field_text.append(c)
                continue
            if state == "escaped":
                field_text.append(c)
                state = "quoted"
                continue
            if state == "closed" and c == quote and escape == quote:
                field_text.append(c)
                state = "quoted"
                continue
            if line_start and comment and c == comment:
                state = "comment"
                continue
            if c == delimiter:
                row.append(finished())
                field_text, state, quoted, line_start = [], "start", False, False
            elif c in "\r\n":
                skip = c == "\r"
                if row or field_text or quoted:
                    row.append(finished())
                    yield row
                row, field_text, state, quoted, line_start = [], [], "start", False, True
            elif c == quote and state == "start" and not "".join(field_text).strip():
                field_text, state, quoted, line_start = [], "quoted", True, False
            elif state != "closed":
                field_text.append(c)
                line_start = False
    if row or field_text or quoted:
        row.append(finished())
        yield row


def csv_options(q: CsvRead) -> dict:
    o = q.options
    return {
        "delimiter": o.get("fieldseparator", ",")[:1] or ",",
        "quote": o.get("fielddelimiter", '"')[:1] or '"',
        "escape": o.get("escape", '"')[:1] or '"',
        "comment": o.get("linecomment", "")[:1] or None,
        "null": o.get("null", ""),
    }


class _Reader(DataSourceReader):
    def __init__(self, path: str, width: int, options: dict, header: bool):
        self.path, self.width, self.own, self.header = path, width, options, header

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        for k, row in enumerate(records(chunks_of(self.path), **self.own)):
            if k or not self.header:
                yield tuple((row + [None] * self.width)[: self.width])


class InstanceCsv(DataSource):
    @classmethod
    def name(cls):
        return "instance_csv"

    def schema(self):
        return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(int(self.options["width"]))])

    def reader(self, schema):
        o = self.options
        own = {k: o.get(k) for k in ("delimiter", "quote", "escape", "null")} | {"comment": o.get("comment") or None}
        return _Reader(o["path"], int(o["width"]), own, o["header"] == "true")


def read_select(spark: SparkSession, text: str, folder: str = ".") -> DataFrame:
    """The query's rows; columns c0, c1, ... in the order of its items."""
    q = parse_select(text)
    path = q.path if os.path.isabs(q.path) or "://" in q.path else os.path.join(folder, q.path)
    options = csv_options(q)
    if q.columns is not None:
        names, header = q.columns.split(options["delimiter"]), False
    else:
        names, header = [n or "" for n in next(records(chunks_of(path), **options), [])], True
    spark.dataSource.register(InstanceCsv)
    reader = spark.read.format("instance_csv").option("path", path).option("width", str(len(names))).option("header", str(header).lower())
    for k, v in options.items():
        reader = reader.option(k, v or "")
    df = reader.load()
    folded = [n.strip().upper() for n in names]
    columns = []
    for kind, value in q.items:
        if kind == "all":
            columns += [F.col(f"c{i}") for i in range(len(names))]
        elif kind == "constant":
            columns.append(F.lit(value))
        elif kind == "null":
            columns.append(F.lit(None).cast("string"))
        else:
            if value.upper() not in folded:
                raise QueryRefused(f"{q.path} has no column {value!r}; it has {', '.join(names)}")
            columns.append(F.col(f"c{folded.index(value.upper())}"))
    out = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return out.dropDuplicates() if q.distinct else out
