"""SPARQL expressions as native Spark columns.

``Context.compile`` turns an expression into a typed value; null is an error or an unbound variable, so
SQL's three-valued logic is SPARQL's.  Functions are found in ``FUNCTIONS`` by built-in name or IRI.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.plans.rdf import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, DURATION, FLOAT, INTEGER, INTEGER_RANGES, IRI, LANG_STRING, NUMERIC, STRING, TIME, XSD, Literal, Prefixes
from graphloom.plans.typed import Val, boolean, constant, dyn, is_numeric, null_value, plain_text, render, same_kind, string, unify

from . import literals as L

DEC = "decimal(38,18)"
TARQL_NAMESPACES = ("https://semanticarts.com/tarql/", "http://tarql.github.io/tarql#")
AFN_NAMESPACES = ("http://jena.apache.org/ARQ/function#", "http://jena.hpl.hp.com/ARQ/function#", "java:org.apache.jena.sparql.function.library.")
FN, SPIF, GEOF = "http://www.w3.org/2005/xpath-functions#", "http://spinrdf.org/spif#", "http://www.opengis.net/def/function/geosparql/"


class QueryError(ValueError):
    """An expression that cannot be compiled, found before any input is read."""


def function(*names: str):
    def add(build):
        for n in names:
            FUNCTIONS[n] = build
        return build

    return add


FUNCTIONS: dict[str, Callable] = {}


class Context:
    """What expressions see: variables, prefixes, the base IRI, and where blank nodes get their labels."""

    def __init__(self, values: dict[str, Val], prefixes: Prefixes, base: str = "", label: Callable[[str], Column] | None = None, exists: Callable | None = None, now: str | None = None):
        self.values, self.prefixes, self.base, self.label, self.exists = values, prefixes, base, label, exists
        self.now = now or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f").rstrip("0").rstrip(".") + "Z"
        self.sites = 0

    def compile(self, e) -> Val:
        kind = e[0]
        if kind == "term":
            return constant(e[1]) if not isinstance(e[1], Literal) else rewritten(e[1])
        if kind == "var":
            return self.values.get(e[1]) or null_value()
        if kind == "exists":
            if self.exists is None:
                raise QueryError("EXISTS cannot stand here")
            return boolean(self.exists(e[1], self))
        if kind == "aggregate":
            raise QueryError("an aggregate stands outside a grouped query")
        _, name, args = e
        if name == "bound":
            if args[0][0] != "var":
                raise QueryError("BOUND takes a variable")
            v = self.values.get(args[0][1])
            return boolean(v.bound if v is not None else F.lit(False))
        build = FUNCTIONS.get(name)
        if build is None:
            raise QueryError(f"unknown function {name}")
        try:
            return build(self, *[self.compile(a) for a in args])
        except TypeError as error:
            if "positional argument" in str(error):
                raise QueryError(f"{name}: wrong number of arguments") from error
            raise


def rewritten(t: Literal) -> Val:
    """A literal in a query: canonical, derived integer datatypes as xsd:integer."""
    return strdt(string(F.lit(t.lexical)), t.datatype) if t.lang is None and t.datatype != STRING else constant(t)


def strdt(v: Val, datatype: str) -> Val:
    if datatype in INTEGER_RANGES:
        datatype = INTEGER
    elif datatype == XSD + "dateTimeStamp":
        datatype = DATETIME
    if datatype == STRING:
        return string(v.text)
    if datatype in L.CANONICAL:
        return Val("lit", F.coalesce(L.canonical(v.text, datatype), v.text), datatype)
    return Val("lit", v.text, datatype)


# ---- values

def number(v: Val) -> tuple[Column, str] | None:
    """(native number, INTEGER, DECIMAL or DOUBLE), or None where the value is no number."""
    if v.kind == "dyn":
        ok = v.text["dt"].isin(*sorted(NUMERIC))
        return F.when(ok, v.text["v"].try_cast("double")), DOUBLE
    if not is_numeric(v):
        return None
    if v.datatype == INTEGER or v.datatype in INTEGER_RANGES:
        return (v.native if v.native is not None else v.text.try_cast("bigint")), INTEGER
    if v.datatype == DECIMAL:
        return (v.native if v.native is not None else v.text).try_cast(DEC), DECIMAL
    return (v.native.cast("double") if v.native is not None else L.floating(v.text, "double")), v.datatype


def numeric(native: Column, datatype: str) -> Val:
    if datatype == INTEGER:
        return Val("lit", native.cast("string"), INTEGER, native=native, safe=True)
    if datatype == DECIMAL:
        native = native.try_cast(DEC)
        return Val("lit", L.strip_zeros(native.cast("string")), DECIMAL, native=native, safe=True)
    text = L.double_text(native.cast("float") if datatype == FLOAT else native)
    return Val("lit", text, datatype, native=native, safe=True)


RANK = {INTEGER: 0, DECIMAL: 1, FLOAT: 2, DOUBLE: 3}
CAST = {INTEGER: "bigint", DECIMAL: DEC, FLOAT: "double", DOUBLE: "double"}


def promoted(a: Val, b: Val) -> tuple[Column, Column, str] | None:
    x, y = number(a), number(b)
    if x is None or y is None:
        return None
    kind = max(x[1], y[1], key=RANK.__getitem__)
    return x[0].try_cast(CAST[kind]), y[0].try_cast(CAST[kind]), kind


def arithmetic(sql: str):
    def build(ctx, a: Val, b: Val) -> Val:
        both = promoted(a, b)
        if both is None:
            return null_value()
        x, y, kind = both
        if sql == "/":
            if kind in (INTEGER, DECIMAL):
                # the quotient keeps 18 fraction digits only if the divisor has none
                x, y = x.try_cast(DEC), y.try_cast(DEC)
                whole = F.try_divide(x, y.try_cast("decimal(20,0)"))
                million = F.lit(1_000_000).cast("decimal(7,0)")
                shifted = F.try_divide(F.try_multiply(x, million).try_cast(DEC), F.try_multiply(y, million).try_cast("decimal(26,0)"))
                slow = F.try_divide(x.cast("double"), y.cast("double"))
                quotient = F.when(y == F.floor(y), whole.try_cast(DEC)).when(y == y.try_cast("decimal(38,6)"), shifted.try_cast(DEC)).otherwise(slow.try_cast(DEC))
                return numeric(quotient, DECIMAL)
            return numeric(x / F.when(y != 0, y) if kind == INTEGER else F.when(y != 0, x / F.when(y != 0, y)).when(x == 0, F.lit(float("nan"))).when(F.isnan(x), x).when(x > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf)), kind)
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sql]
        if kind in (FLOAT, DOUBLE):
            return numeric({"+": x + y, "-": x - y, "*": x * y}[sql], kind)
        return numeric(f(x, y).try_cast(CAST[kind]), kind)

    return build


for _op in "+-*/":
    FUNCTIONS[_op] = arithmetic(_op)


@function("neg")
def _neg(ctx, a):
    n = number(a)
    return null_value() if n is None else numeric(F.try_subtract(F.lit(0).cast(CAST[n[1]]), n[0]) if n[1] in (INTEGER, DECIMAL) else -n[0], n[1])


@function("pos")
def _pos(ctx, a):
    n = number(a)
    return null_value() if n is None else numeric(*n)


def ebv(v: Val) -> Column:
    """Effective boolean value; null where there is none."""
    if v.kind == "lit" and v.lang is None:
        if v.datatype == BOOLEAN:
            return v.native if v.native is not None else F.when(v.text.isin("true", "1"), True).when(v.text.isin("false", "0"), False)
        if v.datatype == STRING:
            return v.text != ""
        if (n := number(v)) is not None:
            return (n[0] != 0) & ~F.isnan(n[0].cast("double"))
        return F.lit(None).cast("boolean")
    if v.kind == "dyn":
        s = v.text
        return F.when(s["dt"] == BOOLEAN, s["v"].isin("true", "1")).when(s["dt"] == STRING, s["v"] != "").when(s["dt"].isin(*sorted(NUMERIC)), s["v"].try_cast("double") != 0)
    return F.lit(None).cast("boolean")


@function("&&")
def _and(ctx, a, b):
    return boolean(ebv(a) & ebv(b))


@function("||")
def _or(ctx, a, b):
    return boolean(ebv(a) | ebv(b))


@function("!")
def _not(ctx, a):
    return boolean(~ebv(a))


TEMPORAL = {DATETIME, DATE, TIME}


def instant(v: Val) -> Column:
    """A dateTime or date as a timestamp (no zone: UTC); null where invalid."""
    zoned = F.regexp_like(v.text, F.lit(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"))
    text = F.when(zoned, v.text).otherwise(F.concat(v.text, F.lit("Z")))
    if v.datatype == DATE:
        text = F.regexp_replace(text, "^(-?[0-9]+-[0-9]{2}-[0-9]{2})", "$1T00:00:00")
    return F.when(F.regexp_like(v.text, F.lit(r"^-?[0-9]{4,}-")), text.try_cast("timestamp"))


def comparable(a: Val, b: Val) -> tuple[Column, Column] | None:
    """Natives in an order, for values whose kinds have one."""
    if (both := promoted(a, b)) is not None:
        return both[0], both[1]
    if a.kind == b.kind == "lit":
        if a.lang is None and b.lang is None and a.datatype == b.datatype:
            if a.datatype == STRING:
                return a.text, b.text
            if a.datatype == BOOLEAN:
                return ebv(a), ebv(b)
            if a.datatype in (DATETIME, DATE):
                return instant(a), instant(b)
            if a.datatype == TIME:
                return a.text, b.text
        if a.lang is not None and b.lang is not None and not isinstance(a.lang, Column) and a.lang == b.lang:
            return a.text, b.text
    return None


def order(sql: str):
    def build(ctx, a: Val, b: Val) -> Val:
        pair = comparable(a, b)
        if pair is None:
            if "dyn" in (a.kind, b.kind):
                x, y = dyn(a).text, dyn(b).text
                pair = F.when(x["dt"] == STRING, x["v"]), F.when(y["dt"] == STRING, y["v"])
            else:
                return boolean(F.lit(None).cast("boolean"))
        x, y = pair
        return boolean({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sql])

    return build


for _op in ("<", "<=", ">", ">="):
    FUNCTIONS[_op] = order(_op)


def equal(a: Val, b: Val) -> Column:
    """=: by value where the types have values to compare; different types of literals give an error."""
    if "dyn" in (a.kind, b.kind):
        x, y = dyn(a), dyn(b)
        numbers = x.text["dt"].isin(*sorted(NUMERIC)) & y.text["dt"].isin(*sorted(NUMERIC))
        return F.when(F.coalesce(numbers, F.lit(False)), x.text["v"].try_cast("double") == y.text["v"].try_cast("double")).otherwise(render(x) == render(y))
    if a.kind != b.kind:
        return F.when(a.bound & b.bound, F.lit(False))
    if a.kind in ("iri", "bnode"):
        return a.text == b.text
    if (pair := comparable(a, b)) is not None:
        return pair[0] == pair[1]
    if a.lang is not None or b.lang is not None:
        return render(a) == render(b)
    if a.datatype == b.datatype:
        return F.when(a.text == b.text, F.lit(True))  # an unknown datatype: equal terms only
    return F.lit(None).cast("boolean")


@function("=")
def _eq(ctx, a, b):
    return boolean(equal(a, b))


@function("!=")
def _ne(ctx, a, b):
    return boolean(~equal(a, b))


@function("in")
def _in(ctx, a, *items):
    out = F.lit(False)
    for x in items:
        out = out | equal(a, x)
    return boolean(out)


@function("sameterm")
def _sameterm(ctx, a, b):
    return boolean(render(a) == render(b))


@function("if")
def _if(ctx, c, a, b):
    cond = ebv(c)
    a, b = unify([a, b]) if not literal_null(a, b) else typed_null(a, b)
    return a.at(F.when(cond, a.text).when(~cond, b.text)) if a.kind != "dyn" else Val("dyn", F.when(cond, a.text).when(~cond, b.text))


def literal_null(*values: Val) -> bool:
    return any(is_null(v) for v in values)


def is_null(v: Val) -> bool:
    return v.kind == "lit" and str(v.text) == str(null_value().text)


def typed_null(*values: Val) -> list[Val]:
    """Values among which a constant null takes the kind of the others."""
    known = [v for v in values if not is_null(v)] or [values[0]]
    if not all(same_kind(known[0], v) for v in known[1:]) or isinstance(known[0].lang, Column):
        return [dyn(v) for v in values]
    return [v if not is_null(v) else known[0].at(F.lit(None).cast("string")) if known[0].kind != "dyn" else dyn(v) for v in values]


@function("coalesce")
def _coalesce(ctx, *values):
    values = typed_null(*values) if literal_null(*values) else unify(list(values))
    text = F.coalesce(*[v.text for v in values])
    return Val("dyn", text) if values[0].kind == "dyn" else values[0].at(text)


# ---- terms

@function("str")
def _str(ctx, a):
    return string(plain_text(a))


@function("lang")
def _lang(ctx, a):
    if a.kind == "dyn":
        return string(F.when(a.text["k"] == "lit", F.coalesce(a.text["lang"], F.lit(""))))
    if a.kind != "lit":
        return null_value()
    tag = a.lang if isinstance(a.lang, Column) else F.lit(a.lang or "")
    return string(F.when(a.bound, tag))


@function("langmatches")
def _langmatches(ctx, a, b):
    x, y = F.lower(a.text), F.lower(b.text)
    return boolean(F.when(y == "*", x != "").otherwise((x == y) | x.startswith(F.concat(y, F.lit("-")))))


@function("datatype")
def _datatype(ctx, a):
    if a.kind == "dyn":
        return Val("iri", F.when(a.text["k"] == "lit", a.text["dt"]))
    if a.kind != "lit":
        return Val("iri", F.lit(None).cast("string"))
    return Val("iri", F.when(a.bound, F.lit(LANG_STRING if a.lang is not None else a.datatype)))


@function("iri")
def _iri(ctx, a):
    if a.kind == "iri":
        return a
    text = plain_text(a)
    if a.kind == "bnode" or (a.kind == "lit" and (a.lang is not None or a.datatype != STRING)):
        return Val("iri", F.lit(None).cast("string"))
    if ctx.base:
        # a reference without a scheme is resolved against the base; one with dot segments would need more
        root = urljoin(ctx.base, "/").rstrip("/")
        folder = urljoin(ctx.base, ".")
        full = F.when(F.regexp_like(text, F.lit("^[A-Za-z][A-Za-z0-9+.\\-]*:")), text).when(text == "", F.lit(ctx.base)).when(text.startswith("#"), F.concat(F.lit(ctx.base.split("#")[0]), text)).when(text.startswith("/"), F.concat(F.lit(root), text)).otherwise(F.concat(F.lit(folder), text))
    else:
        full = text
    return Val("iri", F.when(L.valid_iri(full), full))


@function("bnode")
def _bnode(ctx, a=None):
    if ctx.label is None:
        raise QueryError("BNODE cannot be used here")
    if a is None:
        ctx.sites += 1
        return Val("bnode", ctx.label(str(ctx.sites)))
    return Val("bnode", F.concat(ctx.label("s"), F.lit("_"), F.md5(plain_text(a))))


@function("rand")
def _rand(ctx):
    return numeric(F.rand(), DOUBLE)


@function("now", *(ns + "now" for ns in AFN_NAMESPACES))
def _now(ctx):
    return Val("lit", F.lit(ctx.now), DATETIME, safe=True)


@function("uuid", SPIF + "generateUUID")
def _uuid(ctx):
    return Val("iri", F.concat(F.lit("urn:uuid:"), F.expr("uuid()")))


@function("struuid")
def _struuid(ctx):
    return string(F.expr("uuid()"))


@function("strlang")
def _strlang(ctx, a, tag):
    if a.kind != "lit" or a.lang is not None or a.datatype != STRING:
        return null_value() if a.kind != "dyn" else dyn_lang(F.when((a.text["dt"] == STRING), a.text["v"]), tag.text)
    return dyn_lang(a.text, tag.text)


def dyn_lang(text: Column, tag: Column) -> Val:
    ok = F.regexp_like(tag, F.lit(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*\z"))
    s = F.struct(F.lit("lit").alias("k"), text.alias("v"), F.lit(LANG_STRING).alias("dt"), F.lower(tag).alias("lang"))
    return Val("dyn", F.when(text.isNotNull() & ok, s))


@function("strdt")
def _strdt(ctx, a, datatype):
    if a.kind == "dyn":
        a = string(F.when(a.text["dt"] == STRING, a.text["v"]))
    if a.kind != "lit" or a.lang is not None or a.datatype != STRING:
        return null_value()
    fixed = static_text(datatype)
    if fixed is not None:
        return strdt(a, fixed)
    s = F.struct(F.lit("lit").alias("k"), a.text.alias("v"), datatype.text.alias("dt"), F.lit(None).cast("string").alias("lang"))
    return Val("dyn", F.when(a.bound & datatype.bound, s))


def static_text(v: Val) -> str | None:
    """The text of a constant value, if it is one."""
    try:
        node = v.text._jc.node()
        if node.getClass().getSimpleName() == "Literal":
            value = node.value()
            return None if value is None else str(value)
    except Exception:  # another Spark build: not known to be constant
        return None
    return None


@function("isiri")
def _isiri(ctx, a):
    return kind_test(a, "iri")


@function("isblank")
def _isblank(ctx, a):
    return kind_test(a, "bnode")


@function("isliteral")
def _isliteral(ctx, a):
    return kind_test(a, "lit")


def kind_test(a: Val, kind: str) -> Val:
    return boolean(a.text["k"] == kind if a.kind == "dyn" else F.when(a.bound, F.lit(a.kind == kind)))


@function("isnumeric")
def _isnumeric(ctx, a):
    if a.kind == "dyn":
        return boolean(F.when(a.bound, F.coalesce(a.text["dt"].isin(*sorted(NUMERIC)) & a.text["v"].try_cast("double").isNotNull(), F.lit(False))))
    n = number(a)
    return boolean(F.when(a.bound, n[0].isNotNull() if n is not None else F.lit(False)))


# ---- strings

def text_of(v: Val) -> Column:
    """The lexical form of a string or language-tagged string; null for other terms."""
    if v.kind == "dyn":
        return F.when(v.text["dt"].isin(STRING, LANG_STRING), v.text["v"])
    if v.kind == "lit" and (v.lang is not None or v.datatype == STRING):
        return v.text
    return F.lit(None).cast("string")


def like(v: Val, text: Column) -> Val:
    """A string that keeps the language tag of its argument."""
    if v.kind == "dyn":
        s = F.struct(F.lit("lit").alias("k"), text.alias("v"), v.text["dt"].alias("dt"), v.text["lang"].alias("lang"))
        return Val("dyn", F.when(text.isNotNull(), s))
    return Val("lit", text, lang=v.lang) if v.kind == "lit" and v.lang is not None and not isinstance(v.lang, Column) else string(text)


@function("concat")
def _concat(ctx, *parts):
    if not parts:
        return string(F.lit(""))
    text = F.concat(*[text_of(p) for p in parts])
    tags = {p.lang if p.kind == "lit" and not isinstance(p.lang, Column) else None for p in parts}
    return Val("lit", text, lang=tags.pop()) if len(tags) == 1 and None not in tags else string(text)


def substring(text: Column, start: Column, length: Column | None) -> Column:
    """Code points whose position is >= round(start) and < round(start) + round(length)."""
    first = F.floor(start + F.lit(0.5)).cast("bigint")
    low = F.greatest(first, F.lit(1))
    if length is None:
        return text.substr(low.cast("int"), F.length(text))
    end = first + F.floor(length + F.lit(0.5)).cast("bigint")
    return F.when(text.isNotNull(), text.substr(low.cast("int"), F.greatest(end - low, F.lit(0)).cast("int")))


@function("substr", FN + "substring")
def _substr(ctx, s, start, length=None):
    n, k = number(start), number(length) if length is not None else None
    if n is None or (length is not None and k is None):
        return null_value()
    return like(s, substring(text_of(s), n[0].cast("double"), k[0].cast("double") if k else None))


@function("strlen", FN + "string-length")
def _strlen(ctx, s):
    return numeric(F.char_length(text_of(s)).cast("bigint"), INTEGER)


FORBIDDEN = ("(?=", "(?!", "(?<=", "(?<!", "\\1", "\\2", "\\k")


def pattern_of(v: Val, flags: Val | None) -> Column:
    fixed = static_text(v)
    if fixed is not None and any(x in fixed for x in FORBIDDEN):
        raise QueryError("look-around and back references are not supported in patterns")
    if flags is None:
        return text_of(v)
    mark = static_text(flags)
    if mark is not None:
        if set(mark) - set("imsxq"):
            return F.lit(None).cast("string")
        if "q" in mark:
            body = F.concat(F.lit("\\Q"), text_of(v), F.lit("\\E"))
            mark = mark.replace("q", "")
        else:
            body = text_of(v)
        return F.concat(F.lit(f"(?{mark})"), body) if mark else body
    return F.when(flags.text == "", text_of(v)).otherwise(F.concat(F.lit("(?"), flags.text, F.lit(")"), text_of(v)))


@function("regex", FN + "matches")
def _regex(ctx, s, p, flags=None):
    return boolean(F.regexp_like(text_of(s), pattern_of(p, flags)))


@function("replace", FN + "replace")
def _replace(ctx, s, p, by, flags=None):
    return like(s, F.regexp_replace(text_of(s), pattern_of(p, flags), text_of(by)))


@function("ucase", FN + "upper-case", SPIF + "upperCase")
def _ucase(ctx, s):
    return like(s, F.upper(text_of(s)))


@function("lcase", FN + "lower-case", SPIF + "lowerCase")
def _lcase(ctx, s):
    return like(s, F.lower(text_of(s)))


@function("encode_for_uri", SPIF + "encodeURL", FN + "encode-for-uri")
def _encode(ctx, s):
    out = F.url_encode(text_of(s))
    for code, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return string(out)


def compatible(a: Val, b: Val) -> bool:
    """Argument compatibility: the second may have no tag, or the first one's."""
    if "dyn" in (a.kind, b.kind) or isinstance(a.lang, Column) or isinstance(b.lang, Column):
        return True
    return b.lang is None or a.lang == b.lang


def string_test(f):
    def build(ctx, a, b):
        return boolean(f(text_of(a), text_of(b)) if compatible(a, b) else F.lit(None).cast("boolean"))

    return build


FUNCTIONS["contains"] = FUNCTIONS[FN + "contains"] = string_test(lambda a, b: a.contains(b))
FUNCTIONS["strstarts"] = FUNCTIONS[FN + "starts-with"] = string_test(lambda a, b: a.startswith(b))
FUNCTIONS["strends"] = FUNCTIONS[FN + "ends-with"] = string_test(lambda a, b: a.endswith(b))


@function("strbefore", FN + "substring-before")
def _strbefore(ctx, a, b):
    if not compatible(a, b):
        return null_value()
    x, y = text_of(a), text_of(b)
    at = F.position(y, x)
    found = F.when(at > 0, x.substr(F.lit(1), at - 1))
    return cut_result(a, x, y, at, found)


@function("strafter", FN + "substring-after")
def _strafter(ctx, a, b):
    if not compatible(a, b):
        return null_value()
    x, y = text_of(a), text_of(b)
    at = F.position(y, x)
    found = F.when(at > 0, x.substr(at + F.char_length(y), F.char_length(x)))
    return cut_result(a, x, y, at, found)


def cut_result(a: Val, x: Column, y: Column, at: Column, found: Column) -> Val:
    """No match: an empty string without a tag."""
    text = F.when(at > 0, found).when(x.isNotNull() & y.isNotNull(), F.lit(""))
    if a.kind == "lit" and a.lang is None:
        return string(text)
    tag = F.lit(None).cast("string") if a.kind == "lit" and a.lang is None else a.text["lang"] if a.kind == "dyn" else a.lang if isinstance(a.lang, Column) else F.lit(a.lang)
    tag = F.when(at > 0, tag)
    s = F.struct(F.lit("lit").alias("k"), text.alias("v"), F.when(tag.isNotNull(), F.lit(LANG_STRING)).otherwise(F.lit(STRING)).alias("dt"), tag.alias("lang"))
    return Val("dyn", F.when(text.isNotNull(), s))


for _name, _sql in (("md5", F.md5), ("sha1", F.sha1)):
    FUNCTIONS[_name] = lambda ctx, s, f=_sql: string(f(text_of(s).cast("binary")))
for _bits in (256, 384, 512):
    FUNCTIONS[f"sha{_bits}"] = lambda ctx, s, n=_bits: string(F.sha2(text_of(s).cast("binary"), n))


# ---- numbers

def type_keeping(f_exact, f_double):
    def build(ctx, a):
        n = number(a)
        if n is None:
            return null_value()
        return numeric(f_exact(n[0]) if n[1] != DOUBLE and n[1] != FLOAT else f_double(n[0]), n[1])

    return build


FUNCTIONS["abs"] = FUNCTIONS[FN + "abs"] = type_keeping(F.abs, F.abs)
FUNCTIONS["ceil"] = FUNCTIONS[FN + "ceiling"] = type_keeping(F.ceil, lambda x: F.ceil(x).cast("double"))
FUNCTIONS["floor"] = FUNCTIONS[FN + "floor"] = type_keeping(F.floor, lambda x: F.floor(x).cast("double"))
FUNCTIONS["round"] = FUNCTIONS[FN + "round"] = type_keeping(lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")), lambda x: F.floor(x + F.lit(0.5)).cast("double"))


# ---- dates

def date_part(pattern: str, datatype: str):
    def build(ctx, a):
        text = F.when(a.text["dt"] == DATETIME, a.text["v"]) if a.kind == "dyn" else a.text if a.kind == "lit" and a.datatype in (DATETIME, DATE) else F.lit(None).cast("string")
        found = F.regexp_extract(text, pattern, 1)
        found = F.when(F.regexp_like(text, F.lit(L.DATE_TIME.replace("$", r"\z"))) | F.regexp_like(text, F.lit(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}")), found)
        return numeric(found.try_cast("bigint"), INTEGER) if datatype == INTEGER else numeric(found.try_cast(DEC), DECIMAL)

    return build


for _name, _pattern, _type in (
    ("year", "^(-?[0-9]+)-", INTEGER), ("month", "^-?[0-9]+-([0-9]{2})", INTEGER), ("day", "^-?[0-9]+-[0-9]{2}-([0-9]{2})", INTEGER),
    ("hours", "T([0-9]{2})", INTEGER), ("minutes", "T[0-9]{2}:([0-9]{2})", INTEGER), ("seconds", "T[0-9]{2}:[0-9]{2}:([0-9.]+)", DECIMAL),
):
    FUNCTIONS[_name] = FUNCTIONS[FN + f"{_name}-from-dateTime"] = date_part(_pattern, _type)


def zone(a: Val) -> Column:
    text = F.when(a.text["dt"] == DATETIME, a.text["v"]) if a.kind == "dyn" else a.text if a.kind == "lit" and a.datatype == DATETIME else F.lit(None).cast("string")
    return F.regexp_extract(text, "(Z|[+-][0-9]{2}:[0-9]{2})$", 1)


@function("tz")
def _tz(ctx, a):
    return string(zone(a))


@function("timezone")
def _timezone(ctx, a):
    z = zone(a)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    sign = F.when(z.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    return Val("lit", F.when(z == "Z", F.lit("PT0S")).when(z != "", F.when((hours == 0) & (minutes == 0), F.lit("PT0S")).otherwise(text)), XSD + "dayTimeDuration", safe=True)


# ---- casts

def source_text(a: Val) -> Column:
    return a.text["v"] if a.kind == "dyn" else a.text


@function(STRING)
def _to_string(ctx, a):
    return string(plain_text(a))


def cast_to(datatype: str):
    def build(ctx, a):
        if a.kind in ("iri", "bnode"):
            return Val("lit", F.lit(None).cast("string"), datatype)
        if a.kind == "lit" and a.lang is not None:
            return Val("lit", F.lit(None).cast("string"), datatype)
        n = number(a) if a.kind == "lit" else None
        if n is not None:
            x, kind = n
            if datatype == BOOLEAN:
                return boolean((x != 0) & ~F.isnan(x.cast("double")))
            if datatype == INTEGER:
                return numeric(x.try_cast("bigint"), INTEGER)
            if datatype in (DECIMAL, DOUBLE, FLOAT):
                return numeric(x.try_cast(CAST[datatype]), datatype)
            return Val("lit", F.lit(None).cast("string"), datatype)
        if a.kind == "lit" and a.datatype == BOOLEAN and datatype in (INTEGER, DECIMAL, DOUBLE, FLOAT):
            return numeric(ebv(a).cast("int").cast(CAST[datatype]), datatype)
        if a.kind == "lit" and a.datatype == DATETIME and datatype == DATE:
            return Val("lit", F.lit(None).cast("string"), DATE)
        text = L.canonical(source_text(a), datatype)
        native = text.try_cast("bigint") if datatype == INTEGER else None
        return Val("lit", text, datatype, native=native, safe=True)

    return build


for _dt in (INTEGER, DECIMAL, DOUBLE, FLOAT, BOOLEAN, DATETIME):
    FUNCTIONS[_dt] = cast_to(_dt)
#: Lexical spaces of the types that are kept as written.
LEXICAL = {
    DATE: r"^-?([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?\z",
    TIME: r"^(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?|24:00:00([.]0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?\z",
    DURATION: r"^-?P(?=.)([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+([.][0-9]+)?S)?)?\z",
}


def lexical_cast(datatype: str):
    def build(ctx, a):
        if a.kind != "lit" or a.lang is not None or a.datatype not in (STRING, datatype):
            return Val("lit", F.lit(None).cast("string"), datatype)
        ok = F.regexp_like(a.text, F.lit(LEXICAL[datatype]))
        if datatype == DATE:
            ok = ok & (F.regexp_extract(a.text, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date").isNotNull() | a.text.startswith("-") | ~F.regexp_like(a.text, F.lit("^[0-9]{4}-")))
        return Val("lit", F.when(ok, a.text), datatype, safe=True)

    return build


for _dt in LEXICAL:
    FUNCTIONS[_dt] = lexical_cast(_dt)


# ---- prefixes

def prefix_table(ctx) -> Column:
    return F.create_map(*[F.lit(x) for pair in ctx.prefixes.items() for x in pair]) if ctx.prefixes else F.create_map().cast("map<string,string>")


@function(*(ns + "expandPrefixedName" for ns in TARQL_NAMESPACES))
def _expand_prefixed_name(ctx, a):
    text = plain_text(a)
    colon = F.locate(":", text)
    namespace = F.element_at(prefix_table(ctx), text.substr(F.lit(1), colon - 1))
    full = F.when(colon > 0, F.concat(namespace, text.substr(colon + 1, F.length(text))))
    return Val("iri", F.when(L.valid_iri(full), full))


@function(*(ns + "expandPrefix" for ns in TARQL_NAMESPACES))
def _expand_prefix(ctx, a):
    return string(F.element_at(prefix_table(ctx), plain_text(a)))


# ---- afn:

#: First and later characters of an XML name without a colon.
NAME_START = "A-Z_a-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u02FF\\u0370-\\u037D\\u037F-\\u1FFF\\u200C-\\u200D\\u2070-\\u218F\\u2C00-\\u2FEF\\u3001-\\uD7FF\\uF900-\\uFDCF\\uFDF0-\\uFFFD"
NAME_REST = NAME_START + "\\-.0-9\\u00B7\\u0300-\\u036F\\u203F-\\u2040"


def local_name(iri: Column) -> Column:
    """The longest XML name at the end, not reaching into a %-escape."""
    tail = F.regexp_extract(iri, f"([{NAME_REST}]*)$", 1)
    before = iri.substr(F.lit(1), F.length(iri) - F.length(tail))
    # after '%', the two digits belong to the escape
    safe = F.when(before.endswith("%"), tail.substr(F.lit(3), F.length(tail))).otherwise(tail)
    return F.regexp_extract(safe, f"([{NAME_START}][{NAME_REST}]*)$", 1)


def namespace_of(iri: Column) -> Column:
    return iri.substr(F.lit(1), F.length(iri) - F.length(local_name(iri)))


def afn(*names: str):
    return function(*(ns + n for ns in AFN_NAMESPACES for n in names))


def iri_text(a: Val) -> Column:
    return F.when(a.text["k"] == "iri", a.text["v"]) if a.kind == "dyn" else a.text if a.kind == "iri" else F.lit(None).cast("string")


@afn("localname")
def _localname(ctx, a):
    return string(local_name(iri_text(a)))


@afn("namespace")
def _namespace(ctx, a):
    return string(namespace_of(iri_text(a)))


@afn("strjoin")
def _strjoin(ctx, sep, *parts):
    def text(v):
        return F.when(v.text["k"] == "lit", v.text["v"]) if v.kind == "dyn" else v.text if v.kind == "lit" else F.lit(None).cast("string")

    pieces = []
    for p in parts:
        pieces += [text(sep), text(p)] if pieces else [text(p)]
    return string(F.concat(*pieces) if pieces else F.lit(""))


@afn("substr", "substring")
def _afn_substr(ctx, s, start, end=None):
    text, a = text_of(s), number(start)
    b = number(end) if end is not None else (F.char_length(text), INTEGER)
    if a is None or b is None:
        return null_value()
    ok = (a[0] >= 0) & (a[0] <= b[0]) & (b[0] <= F.char_length(text))
    return string(F.when(ok, text.substr((a[0] + 1).cast("int"), (b[0] - a[0]).cast("int"))))


@afn("sha1sum")
def _sha1sum(ctx, a):
    return string(F.sha1(plain_text(a).cast("binary")))


def extreme(smaller: bool):
    def build(ctx, a, b):
        both = promoted(a, b)
        if both is None:
            return null_value()
        x, y, _ = both
        first = x <= y if smaller else x >= y
        u, v = unify([a, b])
        text = F.when(first, u.text).when(~first, v.text)
        return Val("dyn", text) if u.kind == "dyn" else u.at(text)

    return build


for _ns in AFN_NAMESPACES:
    FUNCTIONS[_ns + "min"], FUNCTIONS[_ns + "max"] = extreme(True), extreme(False)


@afn("sqrt")
def _sqrt(ctx, a):
    n = number(a)
    return null_value() if n is None else numeric(F.sqrt(n[0].cast("double")), DOUBLE)


@afn("pi")
def _pi(ctx):
    return numeric(F.lit(math.pi), DOUBLE)


@afn("e")
def _e(ctx):
    return numeric(F.lit(math.e), DOUBLE)


# ---- fn: and spif:

@function(FN + "string")
def _fn_string(ctx, a):
    return string(plain_text(a))


@function(FN + "concat")
def _fn_concat(ctx, *parts):
    return string(F.concat(*[plain_text(p) for p in parts]))


@function(FN + "normalize-space")
def _normalize(ctx, a):
    return string(F.trim(F.regexp_replace(text_of(a), "[\\x20\\t\\r\\n]+", " ")))


@function(FN + "translate")
def _translate(ctx, a, what, by):
    x, y = static_text(what), static_text(by)
    if x is None or y is None:
        raise QueryError("fn:translate takes constant characters")
    return string(F.translate(text_of(a), x, y))


@function(FN + "compare")
def _compare(ctx, a, b):
    x, y = text_of(a), text_of(b)
    return numeric(F.when(x < y, -1).when(x == y, 0).when(x > y, 1).cast("bigint"), INTEGER)


@function(FN + "not")
def _fn_not(ctx, a):
    return boolean(~ebv(a))


@function(FN + "boolean")
def _fn_boolean(ctx, a):
    return boolean(ebv(a))


@function(SPIF + "trim")
def _trim(ctx, a):
    return string(F.regexp_replace(text_of(a), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""))


@function(SPIF + "indexOf")
def _index_of(ctx, a, b):
    at = F.position(text_of(b), text_of(a))
    return numeric(F.when(at > 0, (at - 1).cast("bigint")), INTEGER)


@function(SPIF + "lastIndexOf")
def _last_index_of(ctx, a, b):
    x, y = text_of(a), text_of(b)
    at = F.position(F.reverse(y), F.reverse(x))
    return numeric(F.when(at > 0, (F.char_length(x) - at - F.char_length(y) + 1).cast("bigint")), INTEGER)


@function(SPIF + "buildString")
def _build_string(ctx, form, *args):
    out = plain_text(form)
    for i, a in enumerate(args, 1):
        out = F.replace(out, F.lit(f"{{?{i}}}"), plain_text(a))
    return string(out)


@function(SPIF + "titleCase")
def _title_case(ctx, a):
    return string(F.initcap(text_of(a)))


@function(SPIF + "unCamelCase")
def _un_camel(ctx, a):
    return string(F.lower(F.regexp_replace(text_of(a), "(?<=[a-z0-9])(?=[A-Z])", " ")))


@function(SPIF + "decodeURL")
def _decode_url(ctx, a):
    return string(F.try_url_decode(text_of(a)))


@function(SPIF + "name")
def _spif_name(ctx, a):
    return string(F.coalesce(local_name(iri_text(a)), text_of(a)))


EARTH_M = 6_371_008.8
UNITS = {"metre": 1.0, "meter": 1.0, "kilometre": 1000.0, "kilometer": 1000.0, "statuteMile": 1609.344}


@function(GEOF + "distance")
def _distance(ctx, a, b, unit):
    """Great-circle distance of two WKT points (longitude latitude)."""

    def point(v):
        text = source_text(v)
        form = "POINT\\s*\\(\\s*(-?[0-9.]+)\\s+(-?[0-9.]+)\\s*\\)"
        return [F.radians(F.regexp_extract(text, form, i).try_cast("double")) for i in (1, 2)]

    (lon1, lat1), (lon2, lat2) = point(a), point(b)
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    name = (static_text(unit) or "").rsplit("/", 1)[-1]
    if name not in UNITS:
        raise QueryError(f"unknown unit {name!r}")
    return numeric(F.lit(2 * EARTH_M / UNITS[name]) * F.asin(F.sqrt(h)), DOUBLE)


for _name in ("sprintf", "bnode"):
    for _ns in AFN_NAMESPACES:

        def _refused(ctx, *args, _name=_name):
            raise QueryError(f"afn:{_name} is not supported")

        FUNCTIONS[_ns + _name] = _refused


