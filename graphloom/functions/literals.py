"""Literals as Spark columns: canonical lexical forms, N-Triples text, and cells of typed columns as text.

Everything is a built-in expression.  An invalid form gives null in ``canonical``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.rdf import BOOLEAN, DATETIME, DECIMAL, DOUBLE, FLOAT, INTEGER, INTEGER_RANGES, XSD

NUMBER = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"
FLOATING = "^([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"
DATE_TIME = (
    "^-?([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T"
    "(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?|24:00:00([.]0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$"
)
IRI_CHARACTERS = r'[^\x00-\x20<>"{}|\\^`%]*+'
VALID_IRI = rf"^[A-Za-z][A-Za-z0-9+.\-]*+:{IRI_CHARACTERS}(?:%[0-9A-Fa-f]{{2}}{IRI_CHARACTERS})*+\z"
USUAL_DATE_TIME = r"^[1-9][0-9]{3}-(0[1-9]|1[0-2])-(0[1-9]|1[0-9]|2[0-8])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?\z"


def when(cond: Column, value: Column) -> Column:
    """value where cond is true, else null."""
    return F.when(cond, value)


def blank_to_null(text: Column) -> Column:
    """Null for text of white space only (Unicode white space)."""
    return unless_blank(text, text)


def unless_blank(text: Column, value: Column) -> Column:
    """Null where the text is of white space only, else the value."""
    return F.when(F.ascii(text).between(33, 126) | F.regexp_like(text, F.lit(r"(?U)\S")), value)


def valid_iri(text: Column) -> Column:
    """Does the text match ``IRI_PATTERN``?  Written without alternatives in a loop, which Java matches one call deep for each character."""
    return F.regexp_like(text, F.lit(VALID_IRI))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; keeps generated code small where a value is used many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_zeros(number: Column) -> Column:
    """Decimal text (digits with an optional sign and point) in canonical form."""
    steps = (("^[+]", ""), ("([.][0-9]*?)0*$", "$1"), ("[.]$", ""), ("^(-?)0+(?=[0-9])", "$1"), ("^(-?)[.]", "$10."), ("^-?0*$", "0"))
    for pattern, by in steps:
        number = F.regexp_replace(number, pattern, by)
    return number


def point_trimmed(number: Column) -> Column:
    """Decimal text with a point and digits on both sides, without needless zeros at its end; -0 stays."""
    return F.rtrim(F.rtrim(number, F.lit("0")), F.lit("."))


def decimal_text(value: Column, scale: int) -> Column:
    """A Spark decimal in canonical form."""
    text = value.cast("string")
    return point_trimmed(text) if scale > 0 else text


def integer_text(text: Column) -> Column:
    short = F.regexp_replace(F.regexp_replace(text, "^[+]", ""), "^(-?)0+(?=[0-9])", "$1")
    return F.when(F.regexp_like(text, F.lit(r"^[+-]?[0-9]+\z")), F.regexp_replace(short, "^-0$", "0"))


def _double_text(value: Column) -> Column:
    def moved(text: Column) -> Column:
        mantissa = F.regexp_extract(text, "^-?([0-9.]+)", 1)
        whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
        digits = F.concat(whole, part)
        point = F.length(whole) + F.coalesce(F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        shown = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
            .otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, F.length(digits))))
        )
        return F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), strip_zeros(shown))

    return let(value.cast("string"), moved)


def double_text(value: Column) -> Column:
    """A double (or float) without exponent, shortest form; INF, -INF, NaN."""
    return (
        F.when((F.abs(value) >= 0.001) & (F.abs(value) < 1e7) | (value == 0), point_trimmed(value.cast("string")))  # written without exponent
        .when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("INF"))
        .when(value == float("-inf"), F.lit("-INF"))
        .otherwise(_double_text(value))
    )


def floating(text: Column, kind: str) -> Column:
    """The number written in ``text``, or null."""
    named = F.when(F.regexp_like(text, F.lit(r"^[+]?INF\z")), F.lit("Infinity")).when(text == "-INF", F.lit("-Infinity")).otherwise(text)
    return F.when(F.regexp_like(text, F.lit(FLOATING.replace("$", r"\z"))), named.try_cast(kind))


def _date_time_text(text: Column) -> Column:
    def shown(t: Column) -> Column:
        month = F.regexp_extract(t, "^-?[0-9]+-([0-9]{2})", 1).try_cast("int")
        day = F.regexp_extract(t, "^-?[0-9]+-[0-9]{2}-([0-9]{2})", 1).try_cast("int")
        y = F.regexp_extract(t, "^(-?[0-9]+)-", 1).try_cast("long")
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        short = F.regexp_replace(F.regexp_replace(t, "([.][0-9]*?)0+(Z|[+-][0-9]{2}:[0-9]{2})?$", "$1$2"), "[.](Z|[+-][0-9]{2}:[0-9]{2})?$", "$1")
        zone = F.regexp_replace(short, "[+-]00:00$", "Z")
        tomorrow = F.date_add(F.regexp_extract(t, "^([0-9]+-[0-9]{2}-[0-9]{2})", 1).try_cast("date"), 1)
        midnight = F.concat(F.date_format(tomorrow, "yyyy-MM-dd"), F.lit("T00:00:00"), F.regexp_extract(zone, "T24:00:00(.*)$", 1))
        return F.when(day <= last, F.when(t.contains("T24:"), midnight).otherwise(zone))

    return F.when(F.regexp_like(text, F.lit(DATE_TIME.replace("$", r"\z"))), let(text, shown))


def date_time_text(text: Column) -> Column:
    """Canonical dateTime: Z for a zero offset, no trailing zeros in the fraction, 24:00 as the next day's start."""
    return F.when(F.regexp_like(text, F.lit(USUAL_DATE_TIME)), text).otherwise(_date_time_text(text))


def canonical(text: Column, datatype: str) -> Column:
    """Canonical lexical form, or null where ``text`` is not in the datatype's lexical space."""
    if datatype == INTEGER or datatype in INTEGER_RANGES:
        return integer_text(text)
    if datatype == DECIMAL:
        return F.when(F.regexp_like(text, F.lit(NUMBER.replace("$", r"\z"))), strip_zeros(text))
    if datatype == DOUBLE:
        return double_text(floating(text, "double"))
    if datatype == FLOAT:
        return double_text(floating(text, "float"))
    if datatype == BOOLEAN:
        return F.when(text.isin("true", "1"), F.lit("true")).when(text.isin("false", "0"), F.lit("false"))
    if datatype == DATETIME:
        return date_time_text(text)
    return text


CANONICAL = {INTEGER, DECIMAL, DOUBLE, FLOAT, BOOLEAN, DATETIME, *INTEGER_RANGES}


def in_range(text: Column, datatype: str) -> Column:
    """Is an integer's text within a derived datatype's range?"""
    low, high = INTEGER_RANGES[datatype]
    value, ok = text.try_cast("decimal(38,0)"), F.lit(True)
    if low is not None:
        ok = ok & (value >= F.lit(low).cast("decimal(38,0)"))
    if high is not None:
        ok = ok & (value <= F.expr(f"{high}BD").cast("decimal(38,0)"))
    return F.coalesce(ok, F.lit(False))


def escaped(text: Column) -> Column:
    """N-Triples string escapes; the tests are skipped for text without any."""
    out = text
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def literal_nt(lexical: Column, datatype: str, safe: bool = False) -> Column:
    """``safe``: the lexical form is known to need no escapes."""
    body = lexical if safe else escaped(lexical)
    end = '"' if datatype == XSD + "string" else f'"^^<{datatype}>'
    return F.concat(F.lit('"'), body, F.lit(end))


def cell_text(col: Column, kind: T.DataType) -> Column:
    """A cell as text; null for an empty cell."""
    if isinstance(kind, T.StringType):
        return blank_to_null(col)
    if isinstance(kind, T.FloatType):
        col, kind = col.cast("double"), T.DoubleType()
    if isinstance(kind, T.DoubleType):
        def far(t: Column) -> Column:
            return F.concat(F.regexp_replace(F.substring_index(t, "E", 1), "[.]0$", ""), F.lit("e"), F.substring_index(t, "E", -1))

        near = F.regexp_replace(double_text(col), "^(-?[0-9]+)$", "$1.0")
        extreme = ((F.abs(col) >= 1e16) & (F.abs(col) < float("inf"))) | ((F.abs(col) < 1e-5) & (col != 0))
        usual = (F.abs(col) >= 0.001) & (F.abs(col) < 1e7)  # written without exponent
        return F.when(usual, col.cast("string")).when(extreme, let(col.cast("string"), far)).otherwise(near)
    if isinstance(kind, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampNTZType):
        return fraction_of_three(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.TimestampType):
        utc = F.to_utc_timestamp(col, F.current_timezone())
        return F.concat(fraction_of_three(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("Z"))
    if isinstance(kind, T.DayTimeIntervalType):
        col = col.cast("interval day to second")
        seconds = F.extract(F.lit("DAY"), col) * 86400 + F.extract(F.lit("HOUR"), col) * 3600 + F.extract(F.lit("MINUTE"), col) * 60 + F.extract(F.lit("SECOND"), col)
        return F.concat(F.lit("PT"), strip_zeros(seconds.cast("decimal(20,6)").cast("string")), F.lit("S"))
    if isinstance(kind, (T.BinaryType, T.StructType, T.MapType)):
        raise ValueError(f"a column of type {kind.simpleString()} cannot be read as a cell")
    return col.cast("string")


def fraction_of_three(text: Column) -> Column:
    """A six-digit fraction in the shortest of 0, 3 or 6 digits."""
    return F.regexp_replace(F.regexp_replace(text, "[.]000000$", ""), "([.][0-9]{3})000$", "$1")
