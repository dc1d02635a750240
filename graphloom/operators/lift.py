"""The lifting layer for columns: each binding reads its column and converts it, all rows in one projection."""

from __future__ import annotations

import difflib
import functools
import operator
import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import literals as L
from graphloom.plans.model import Binding, Conversion, Plan
from graphloom.plans.rdf import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, INTEGER, INTEGER_RANGES, STRING, Prefixes
from graphloom.plans.typed import Val
from graphloom.sources.rows import number_rows

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class LeftOut(ValueError):
    """Strict mode: some rows hold cells that cannot be read."""


def nearest(name: str, columns: list[str]) -> str | None:
    """The column that a mistyped name most likely means."""
    plain = {"".join(x for x in c.lower() if x.isalnum()): c for c in reversed(columns)}
    found = difflib.get_close_matches("".join(x for x in name.lower() if x.isalnum()), plain, n=1, cutoff=0.8)
    return plain[found[0]] if found else None


def check_columns(bindings: list[Binding], columns: list[str]) -> None:
    """Missing mandatory columns are refused before any row is read; optional ones are warned about."""
    for b in bindings:
        if b.column not in columns:
            hint = nearest(b.column, columns)
            text = f"the input has no column {b.column!r}" + (f"; did you mean {hint!r}?" if hint else "")
            if not b.optional:
                raise ValueError(text)
            warnings.warn(text, stacklevel=3)


def expand_cell(text: Column, prefixes: Prefixes) -> Column:
    """A prefixed name of a declared prefix as its IRI, other text as it is."""
    if not prefixes:
        return text
    table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    local = F.substring(text, F.locate(":", text) + 1, F.lit(2**31 - 1))
    namespace = F.when(text.contains(":"), F.try_element_at(table, F.substring_index(text, ":", 1)))
    return F.coalesce(F.concat(namespace, F.when(~local.startswith("//"), local)), text)


def typed_cell(col: Column, kind: T.DataType, datatype: str, bind_empty: bool) -> Val:
    """A literal of a datatype from a cell: canonical where valid, as written where not."""
    if isinstance(kind, INTEGRAL) and (datatype in (INTEGER, DECIMAL) or datatype in INTEGER_RANGES):
        return Val("lit", col.cast("string"), datatype, native=col, safe=True)
    if isinstance(kind, T.BooleanType) and datatype == BOOLEAN:
        return Val("lit", col.cast("string"), datatype, native=col, safe=True)
    if isinstance(kind, T.DateType) and datatype == DATE:
        return Val("lit", L.cell_text(col, kind), datatype, safe=True)
    if isinstance(kind, T.DecimalType) and datatype == DECIMAL:
        return Val("lit", L.decimal_text(col, kind.scale), datatype, native=col, safe=True)
    if isinstance(kind, T.DoubleType) and datatype in (DOUBLE, DECIMAL):
        text = L.double_text(col)
        if datatype == DECIMAL:
            extreme = (F.abs(col) >= 1e16) | (F.abs(col) < 1e-5) & (col != 0) | F.isnan(col)
            text = F.when(extreme, L.cell_text(col, kind)).otherwise(text)
        return Val("lit", text, datatype, native=col, safe=True)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and datatype == DATETIME:
        # well formed by construction: only zeros at the end of the fraction go
        if isinstance(kind, T.TimestampNTZType):  # a cast writes no such zeros; years before 1 have a sign that it writes otherwise
            text = F.when(F.year(col) >= 1, F.replace(col.cast("string"), F.lit(" "), F.lit("T"))).otherwise(F.regexp_replace(L.cell_text(col, kind), "([.][0-9]*?)0+(Z?)$", "$1$2"))
            return Val("lit", text, datatype, safe=True)
        text = F.regexp_replace(L.cell_text(col, kind), "([.][0-9]*?)0+(Z?)$", "$1$2")
        return Val("lit", text, datatype, safe=True)
    text = plain_cell(col, kind, bind_empty)
    if datatype not in L.CANONICAL:
        return Val("lit", text, datatype)
    return Val("lit", F.coalesce(L.canonical(text, datatype), text), datatype)


def plain_cell(col: Column, kind: T.DataType, bind_empty: bool) -> Column:
    if isinstance(kind, T.StringType) and bind_empty:
        return col
    return L.cell_text(col, kind)


def convert(col: Column, kind: T.DataType, how: Conversion, prefixes: Prefixes, bind_empty: bool) -> Val:
    if how.kind == "typed":
        return typed_cell(col, kind, how.argument, bind_empty)
    if how.kind == "iri":
        if isinstance(kind, T.StringType) and not bind_empty:  # blank text is no prefixed name
            return Val("iri", L.unless_blank(col, expand_cell(col, prefixes)))
        return Val("iri", expand_cell(plain_cell(col, kind, bind_empty), prefixes))
    text = plain_cell(col, kind, bind_empty)
    return Val("lit", text, lang=how.argument) if how.kind == "lang" else Val("lit", text, STRING, safe=not isinstance(kind, T.StringType))


def list_cell(col: Column, kind: T.DataType, b: Binding, prefixes: Prefixes, bind_empty: bool) -> Val:
    """A list from a text cell split at a literal separator, or from an array; blank or null items are dropped."""
    if isinstance(kind, T.ArrayType):
        if b.depth > 1 and isinstance(kind.elementType, T.ArrayType):
            inner = Binding(b.var, b.column, b.conversion, b.depth - 1, b.separator, b.optional)
            item = list_cell(F.lit(None).cast(kind.elementType), kind.elementType, inner, prefixes, bind_empty)
            items = F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: list_cell(x, kind.elementType, inner, prefixes, bind_empty).text)
            return Val("list", items, item=item)
        items, element = col, kind.elementType
    else:
        if b.separator is None:
            raise ValueError(f"column {b.column!r} holds text: name the separator of its list")
        items, element = F.split(L.cell_text(col, kind), re.escape(b.separator) if b.separator else "", -1), T.StringType()
    item = convert(F.lit(None).cast(element), element, b.conversion, prefixes, bind_empty)
    made = F.transform(items, lambda x: convert(x, element, b.conversion, prefixes, False).text)
    return Val("list", F.filter(made, lambda x: x.isNotNull()), item=item)


def wants_row_number(plan: Plan, columns: list[str]) -> bool:
    return "ROWNUM" not in columns and any(b.column == "ROWNUM" for b in plan.bindings)


def bind(df: DataFrame, b: Binding, prefixes: Prefixes, bind_empty: bool, row_number: str | None = None) -> Val:
    if b.column == "ROWNUM" and b.column not in df.columns and row_number is not None:
        text = F.col(f"`{row_number}`").cast("string")
        if b.conversion.kind == "typed":
            return Val("lit", text, b.conversion.argument, safe=True)
        return Val("lit", text, INTEGER, safe=True)
    if b.column not in df.columns:
        null = F.lit(None).cast("array<string>" if b.depth else "string")
        how = Val("iri", null) if b.conversion.kind == "iri" else Val("lit", null, b.conversion.argument if b.conversion.kind == "typed" else STRING, b.conversion.argument if b.conversion.kind == "lang" else None)
        return Val("list", null, item=how) if b.depth else how
    col, kind = F.col(f"`{b.column}`"), df.schema[b.column].dataType
    if isinstance(kind, T.NullType):
        col, kind = col.cast("string"), T.StringType()
    if b.depth:
        return list_cell(col, kind, b, prefixes, bind_empty)
    if isinstance(kind, T.ArrayType):
        raise ValueError(f"column {b.column!r} holds lists, but parameter ?{b.var} takes one value")
    return convert(col, kind, b.conversion, prefixes, bind_empty)


def invalid(v: Val) -> Column | None:
    """Is the (bound) value no IRI where one is wanted?  None where that cannot be."""
    if v.kind == "iri":
        return v.text.isNotNull() & ~L.valid_iri(v.text)
    if v.kind == "list" and v.item.kind == "iri":
        return F.coalesce(F.exists(v.text, lambda x: ~L.valid_iri(x)), F.lit(False))
    return None


def record_label(df: DataFrame, row_id: str | None) -> Column:
    """A text that is unique to the row and fits in a blank-node label."""
    if row_id is None:
        return F.monotonically_increasing_id().cast("string")
    if isinstance(df.schema[row_id].dataType, INTEGRAL):
        return F.regexp_replace(F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit("null")), "-", "m")
    return F.md5(F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit("")))


def lift_columns(df: DataFrame, plan: Plan, bind_empty: bool = False, row_id: str | None = None, row_number: str | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Val], Column | None]:
    """(rows with one column for each variable, the variables, which rows are left out)."""
    if wants_row_number(plan, df.columns) and row_number is None:
        df, row_number = number_rows(df, "_gl_rownum"), "_gl_rownum"
    check_columns([b for b in plan.bindings if b.column != "ROWNUM"], df.columns)
    found, columns = {}, [record_label(df, row_id).alias("_record")]
    for i, b in enumerate(plan.bindings):
        v = bind(df, b, plan.prefixes, bind_empty, row_number)
        columns.append(v.text.alias(f"_v{i}"))
        found[b.var] = Val(v.kind, F.col(f"_v{i}"), v.datatype, v.lang, v.item, safe=v.safe)
    tests = [t for v in found.values() if (t := invalid(v)) is not None]
    return df.select(*[F.col(k) for k in keep], *columns), found, functools.reduce(operator.or_, tests) if tests else None


def left_out(df: DataFrame, plan: Plan, bind_empty: bool = False, row_number: Column | None = None) -> DataFrame:
    """row, message: every bad cell of every row that is left out (row numbers start at 1)."""
    number = row_number if row_number is not None else F.monotonically_increasing_id()
    numbered = df.withColumn("_row", number + 1)
    messages = []
    for b in plan.bindings:
        v = bind(df, b, plan.prefixes, bind_empty)
        bad = invalid(v)
        if bad is None:
            continue
        say = lambda text, c=b.column: F.concat(F.lit("row "), F.col("_row").cast("string"), F.lit(f": column {c}: '"), text, F.lit("' is not an IRI"))
        if v.kind == "list":
            messages.append(F.transform(F.filter(v.text, lambda x: ~L.valid_iri(x)), say))
        else:
            messages.append(F.when(bad, F.array(say(v.text))))
    if not messages:
        return numbered.select(F.col("_row").alias("row"), F.lit("").alias("message")).limit(0)
    every = F.concat(*[F.coalesce(m, F.array().cast("array<string>")) for m in messages])
    return numbered.select(F.col("_row").alias("row"), F.explode(every).alias("message"))
