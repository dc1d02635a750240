"""Instance maps: a source, a query, and how each column becomes an argument of a template."""

from __future__ import annotations

import functools
import json
import operator
import os
import re
import urllib.request
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import literals as L
from graphloom.functions.sparql import LEXICAL
from graphloom.operators.lift import expand_cell
from graphloom.operators.run import emit
from graphloom.operators.shape import TRIPLE, Shaper
from graphloom.ottr.expand import IRI_TYPES, Expander
from graphloom.ottr.syntax import NONE, Library, Parameter, Type
from graphloom.ottr.types import LITERAL, RESOURCE, basic_subtype
from graphloom.plans.model import VarPat
from graphloom.plans.rdf import BOOLEAN, INTEGER, INTEGER_RANGES, NIL, OTTR, RDF, STRING, TYPE, XSD, BNode, Literal, Prefixes, nt
from graphloom.plans.rdf import FIRST as RDF_FIRST
from graphloom.plans.rdf import IRI as Iri
from graphloom.plans.rdf import REST as RDF_REST
from graphloom.plans.typed import Val, constant, dyn, null_value
from graphloom.session import ship
from graphloom.sources.files import read_rdf
from graphloom.sources.rows import number_rows
from graphloom.sparql.dataset import parsed, select_query
from graphloom.sparql.syntax import parse_query, parse_turtle

from .h2 import read_select


class MapError(ValueError):
    """An instance map that cannot be used."""


@dataclass
class ArgumentMap:
    type: str | None = None
    list_of: str | None = None
    list_separator: str = ","
    null_value: object | None = None
    translations: list = field(default_factory=list)  # (in, out)
    fresh: list[str] = field(default_factory=list)
    true_words: list[str] = field(default_factory=list)
    false_words: list[str] = field(default_factory=list)
    language: str | None = None
    language_separator: str | None = None
    datatype_separator: str | None = None


@dataclass
class InstanceMap:
    template: str
    source: str  # H2Source, RDFFileSource, SPARQLEndpointSource
    urls: list[str]
    query: str
    arguments: list[ArgumentMap] | None
    prefixes: Prefixes
    folder: str = "."


def parse_maps(text: str, folder: str = ".") -> list[InstanceMap]:
    """Instance maps of a Turtle document, in order; @@THIS_DIR@@ is the document's folder."""
    triples, prefixes = parse_turtle(text.replace("@@THIS_DIR@@", folder))
    about: dict = {}
    for s, p, o in triples:
        about.setdefault(s, []).append((p.value, o))

    def values(node, name: str) -> list:
        return [o for p, o in about.get(node, ()) if p == OTTR + name]

    def one(node, name: str):
        found = values(node, name)
        if len(found) > 1:
            raise MapError(f"ottr:{name} is given {len(found)} times")
        return found[0] if found else None

    def items(node) -> list:
        out = []
        while node != Iri(NIL):
            pairs = dict(about.get(node, ()))
            if RDF_FIRST not in pairs:
                raise MapError("a list is expected")
            out.append(pairs[RDF_FIRST])
            node = pairs[RDF_REST]
        return out

    def text_of(node) -> str:
        return node.lexical if isinstance(node, Literal) else getattr(node, "value", "")

    def argument(node) -> ArgumentMap:
        a = ArgumentMap()
        kind = one(node, "type")
        if isinstance(kind, Iri) and kind.value != NIL:
            a.type = kind.value
        elif kind is not None:
            parts = items(kind)
            if len(parts) < 2 or parts[0] not in (Iri(RDF + "List"), Iri(OTTR + "NEList")):
                raise MapError("a list type is (rdf:List type)")
            a.list_of = parts[-1].value
        a.null_value = one(node, "nullValue")
        for table in values(node, "translationTable"):
            for entry in values(table, "entry"):
                a.translations.append((text_of(one(entry, "inValue")), one(entry, "outValue")))
        if (fresh := one(node, "blankNodeFresh")) is not None:
            a.fresh = [text_of(x) for x in items(fresh)]
        for attribute, name in (("true_words", "booleanTrue"), ("false_words", "booleanFalse")):
            if (words := one(node, name)) is not None:
                setattr(a, attribute, [text_of(x) for x in items(words)])
        for attribute, name in (("language", "languageTag"), ("language_separator", "languageTagSep"), ("datatype_separator", "datatypeSep")):
            if (x := one(node, name)) is not None:
                setattr(a, attribute, text_of(x))
        if (x := one(node, "listSep")) is not None:
            a.list_separator = text_of(x)
        settings = [a.language is not None, a.language_separator is not None, a.datatype_separator is not None]
        if (a.type or a.list_of) and any(settings):
            raise MapError("an argument map cannot have both a type and a language tag or a datatype separator")
        if sum(settings) > 1:
            raise MapError("an argument map has one of languageTag, languageTagSep and datatypeSep")
        return a

    out = []
    for s, pairs in about.items():
        if (TYPE, Iri(OTTR + "InstanceMap")) not in pairs:
            continue
        template, source = one(s, "template"), one(s, "source")
        if template is None or source is None:
            raise MapError("an instance map needs ottr:template and ottr:source")
        kinds = [o.value for p, o in about.get(source, ()) if p == TYPE]
        kind = kinds[0].removeprefix(OTTR) if kinds else ""
        if kind not in ("H2Source", "RDFFileSource", "SPARQLEndpointSource"):
            raise MapError(f"a source is an H2Source, RDFFileSource or SPARQLEndpointSource; {kind or 'an untyped node'} is not one")
        maps = one(s, "argumentMaps")
        urls = [text_of(x) for x in values(source, "sourceURL")]
        query = one(s, "query")
        out.append(InstanceMap(template.value, kind, urls, text_of(query) if query is not None else "", [argument(x) for x in items(maps)] if maps is not None else None, prefixes, folder))
    if not out:
        raise MapError("the document has no ottr:InstanceMap")
    return out


# ---- sources

def endpoint_rows(spark: SparkSession, url: str, query: str, timeout: float = 600) -> DataFrame:
    """A SELECT's results from a SPARQL endpoint (JSON), as N-Triples text columns."""
    request = urllib.request.Request(url, data=query.encode(), headers={"Content-Type": "application/sparql-query", "Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        data = json.load(answer)
    names = data["head"]["vars"]

    def term(x):
        if x is None:
            return None
        if x["type"] == "uri":
            return nt(Iri(x["value"]))
        if x["type"] == "bnode":
            return nt(BNode("d" + re.sub(r"\W", "_", x["value"])))
        return nt(Literal(x["value"], x.get("datatype", STRING), x.get("xml:lang")))

    rows = [tuple(term(b.get(n)) for n in names) for b in data["results"]["bindings"]]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def source_rows(spark: SparkSession, m: InstanceMap) -> tuple[DataFrame, bool]:
    """(rows with columns c0, c1, ..., are the cells N-Triples terms?)"""
    if m.source == "H2Source":
        return read_select(spark, m.query, m.folder), False
    if not m.urls:
        raise MapError("the source needs ottr:sourceURL")
    if m.source == "RDFFileSource":
        paths = [u.removeprefix("file://") if os.path.isabs(u.removeprefix("file://")) else os.path.join(m.folder, u) for u in m.urls]
        df = select_query(spark, parse_query(m.query), read_rdf(spark, *paths))
    else:
        df = endpoint_rows(spark, m.urls[0], m.query)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), True


# ---- arguments

def valid_lexical(text: Column, datatype: str) -> Column:
    """Is the text in the datatype's lexical space (and range)?"""
    if datatype in INTEGER_RANGES:
        return L.integer_text(text).isNotNull() & L.in_range(text, datatype)
    if datatype in L.CANONICAL:
        return L.canonical(text, datatype).isNotNull()
    if datatype in LEXICAL:
        return F.regexp_like(text, F.lit(LEXICAL[datatype]))
    if datatype == XSD + "gYear":
        return F.regexp_like(text, F.lit(r"^-?[0-9]{4,}(Z|[+-][0-9]{2}:[0-9]{2})?\z"))
    return F.lit(True)


def read_as(text: Column, kind: str | None, a: ArgumentMap, prefixes: Prefixes) -> tuple[Val, Column | None, str]:
    """(value, is it invalid?, what it should be) of a cell's text."""
    if kind is None:
        if a.language is not None:
            return Val("lit", text, lang=a.language.lower()), None, ""
        if a.language_separator is not None or a.datatype_separator is not None:
            sep = a.language_separator if a.language_separator is not None else a.datatype_separator
            tail = F.substring_index(text, sep, -1)
            head = text.substr(F.lit(1), F.length(text) - F.length(tail) - len(sep))
            missing = ~text.contains(sep)
            null = F.lit(None).cast("string")
            if a.language_separator is not None:
                s = F.struct(F.lit("lit").alias("k"), head.alias("v"), F.lit(RDF + "langString").alias("dt"), F.lower(tail).alias("lang"))
                bad = missing | ~F.regexp_like(tail, F.lit(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*\z"))
                return Val("dyn", F.when(text.isNotNull(), s)), bad, "text with a language tag"
            datatype = expand_cell(tail, prefixes)
            s = F.struct(F.lit("lit").alias("k"), head.alias("v"), datatype.alias("dt"), null.alias("lang"))
            wrong = functools.reduce(operator.or_, [(datatype == dt) & ~valid_lexical(head, dt) for dt in (INTEGER, XSD + "decimal", XSD + "double", BOOLEAN, XSD + "int", XSD + "date", XSD + "dateTime")])
            return Val("dyn", F.when(text.isNotNull(), s)), missing | ~L.valid_iri(datatype) | wrong, "text with a datatype"
        return Val("lit", text), None, ""
    if kind in IRI_TYPES:
        iri = expand_cell(text, prefixes)
        return Val("iri", iri), text.isNotNull() & ~L.valid_iri(iri), "an IRI"
    if kind == BOOLEAN and (a.true_words or a.false_words):
        word = F.when(text.isin(*(a.true_words or ["true", "1"])), F.lit("true")).when(text.isin(*(a.false_words or ["false", "0"])), F.lit("false"))
        return Val("lit", word, BOOLEAN, safe=True), text.isNotNull() & word.isNull(), "a boolean"
    if kind.startswith(XSD):
        return Val("lit", text, kind), text.isNotNull() & ~valid_lexical(text, kind), f"of type {kind.rsplit('#', 1)[-1]}"
    return Val("lit", text), None, ""


def nested_list(label: Column, text: Column, separator: str, kind: str | None, prefixes: Prefixes) -> Column:
    """struct(head, links): the RDF collection that a cell with brackets spells, at any depth.

    The depth is in the data, so this is an Arrow function; cells without inner brackets do not need it.
    """
    table, is_iri = dict(prefixes), kind in IRI_TYPES

    @F.arrow_udf(f"head string, links array<{TRIPLE}>")
    def build(labels: pa.Array, cells: pa.Array) -> pa.Array:
        out = []
        for name, cell in zip(labels.to_pylist(), cells.to_pylist(), strict=True):
            out.append(None if cell is None else collection(name, split_brackets(cell, separator), lambda x: term_text(x, kind, is_iri, table)))
        triple = pa.struct([("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string())])
        return pa.array(out, pa.struct([("head", pa.string()), ("links", pa.list_(triple))]))

    return build(label, text)


def term_text(x: str, kind: str | None, is_iri: bool, prefixes: dict) -> str:
    if is_iri:
        return f"<{Prefixes(prefixes).cell(x)}>"
    return nt(Literal(x, kind if kind and kind.startswith(XSD) else STRING))


def split_brackets(cell: str, separator: str) -> list:
    """Items of a list cell; brackets nest, and a cell without them is one list.  The brackets match (see ``bad_brackets``)."""
    if "(" not in cell:
        return [x.strip() for x in cell.split(separator)]
    parts = [p.strip() for p in re.split(r"([()])", cell.strip())[1:-1]]
    open_lists: list[list] = [[]]
    for i, part in enumerate(parts):
        if part == "(":
            open_lists.append([])
        elif part == ")":
            done = open_lists.pop()
            open_lists[-1].append(done)
        elif part:
            # a separator beside a nested list stands for no item
            mark = separator.strip() or separator
            if parts[i - 1] == ")":
                part = part.removeprefix(mark)
            if parts[i + 1] == "(":
                part = part.removesuffix(mark)
            if part or parts[i - 1] == "(" and parts[i + 1] == ")":
                open_lists[-1] += [x.strip() for x in part.split(separator)]
    return open_lists[0][0]


def bad_brackets(text: Column) -> Column:
    """Does the cell have brackets that do not match, or text outside the outer ones?"""
    only = F.regexp_replace(text, "[^()]", "")
    depth = F.aggregate(
        F.filter(F.split(only, ""), lambda x: x != ""),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"), F.lit(False).alias("shut")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c == "(", 1).otherwise(-1)).alias("depth"),
            (s["bad"] | s["shut"] | ((c == ")") & (s["depth"] == 0))).alias("bad"),
            ((c == ")") & (s["depth"] == 1)).alias("shut"),
        ),
        lambda s: s["bad"] | (s["depth"] != 0),
    )
    return F.when(only != "", depth | ~F.regexp_like(text, F.lit(r"(?s)^\s*\(.*\)\s*\z"))).otherwise(False)


def collection(name: str, items: list, render_item) -> dict:
    links: list[dict] = []
    add = lambda s, p, o: links.append({"subject": s, "predicate": p, "object": o})
    count = iter(range(10**9))

    def build(xs: list) -> str:
        head = f"<{NIL}>"
        for x in reversed(xs):
            node = f"_:{name}n{next(count)}"
            add(node, f"<{RDF_FIRST}>", build(x) if isinstance(x, list) else render_item(x))
            add(node, f"<{RDF_REST}>", head)
            head = node
        return head

    return {"head": build(items), "links": links}


def list_argument(text: Column, a: ArgumentMap, prefixes: Prefixes, label: Column) -> tuple[Val, Column | None, str]:
    sep = a.list_separator
    inner = F.trim(text)
    bare = F.regexp_replace(inner, r"^\((.*)\)$", "$1")
    bracketed = inner.startswith("(") & inner.endswith(")")
    items = F.when(bracketed & (F.trim(bare) == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(bare, re.escape(sep), -1), lambda x: F.trim(x)))
    item, bad, what = read_as(F.lit(None).cast("string"), a.list_of, a, prefixes)
    read = F.transform(items, lambda x: read_as(x, a.list_of, a, prefixes)[0].text)
    wrong = None if bad is None else F.exists(items, lambda x: read_as(x, a.list_of, a, prefixes)[1])
    broken = text.isNotNull() & bad_brackets(text)
    wrong = broken if wrong is None else broken | F.coalesce(wrong, F.lit(False))
    nested = nested_list(label, F.when(~broken, text), sep, a.list_of, prefixes)
    return Val("list", F.when(text.isNotNull(), read), item=item, native=nested), wrong, f"a list of items {what}"


def argument_value(text: Column, terms: bool, a: ArgumentMap, prefixes: Prefixes, record: Column, position: int) -> tuple[Val, Column | None, str]:
    """(value, is it invalid?, what it should be)."""
    if a.list_of is not None:
        return list_argument(text, a, prefixes, F.concat(F.lit("l"), record, F.lit(f"a{position}")))
    if terms:
        term = parsed(text)
        cell = F.when(term.text["k"] != "bnode", term.text["v"])
        value, bad, what = read_as(cell, a.type, a, prefixes)
        if a.type is None:
            return term, None, ""
        fits = term.text["k"] == "iri" if a.type in IRI_TYPES else functools.reduce(operator.or_, [term.text["dt"] == dt for dt in subtypes(a.type)])
        merged = F.when(F.coalesce(fits, F.lit(False)), term.text).otherwise(dyn(value).text)
        return Val("dyn", merged), None if bad is None else bad & ~F.coalesce(fits, F.lit(False)), what
    value, bad, what = read_as(text, a.type, a, prefixes)
    special: list[tuple[Column, Val]] = []
    if a.fresh:
        special.append((text.isin(*a.fresh), Val("bnode", F.concat(F.lit("f"), record, F.lit(f"a{position}")))))
    special.append((text.startswith("_:"), Val("bnode", F.concat(F.lit("c"), F.md5(text)))) if a.type is None or a.type in IRI_TYPES else (F.lit(False), value))
    for given, out in a.translations:
        special.append((text == given, constant(out) if out is not None and out != NONE else null_value()))
    if a.null_value is not None:
        special.insert(0, (text.isNull(), constant(a.null_value)))
    usual = F.lit(True)
    for cond, _ in special:
        usual = usual & ~F.coalesce(cond, F.lit(False))
    merged = dyn(value).text
    for cond, v in reversed(special):
        merged = F.when(F.coalesce(cond, F.lit(False)), dyn(v).text).otherwise(merged)
    simple = not (a.fresh or a.translations or a.null_value is not None)
    if simple and value.kind != "dyn" and not (a.type is None or a.type in IRI_TYPES):
        return value, bad, what
    return Val("dyn", merged), None if bad is None else bad & usual, what


def subtypes(name: str) -> list[str]:
    from graphloom.ottr.types import PARENT

    return [name, *(t for t in PARENT if t != name and basic_subtype(t, name))]


def kind_problem(v: Val, p: Parameter) -> Column | None:
    """Does a value not fit the parameter's type?"""
    want = p.type
    while isinstance(want, Type) and want.name == "LUB":
        want = want.of
    if want is None or want.name == RESOURCE:
        return None
    if want.of is not None:
        if v.kind != "list":
            return v.text.isNotNull()
        return (F.size(v.text) == 0) if want.name == "NEList" else None
    if v.kind == "list":
        return v.text.isNotNull()
    wants_iri = want.name in IRI_TYPES
    if v.kind == "dyn":
        s = v.text
        if wants_iri:
            return s["k"] == "lit"
        bad = s["k"] != "lit"
        return bad if want.name == LITERAL else bad | ~s["dt"].isin(*subtypes(want.name))
    if wants_iri:
        return v.text.isNotNull() if v.kind == "lit" else None
    if v.kind != "lit":
        return v.text.isNotNull()
    if want.name == LITERAL or (v.lang is None and basic_subtype(v.datatype, want.name)) or (v.lang is not None and basic_subtype(RDF + "langString", want.name)):
        return None
    return v.text.isNotNull()


@dataclass
class BottrResult:
    triples: DataFrame
    left_out: DataFrame  # map, row, message


def run_map(spark: SparkSession, library: Library, m: InstanceMap, number: int, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples, what was left out) of one map; ``given`` stands for its source, with text columns in the arguments' order."""
    template = library.get(m.template)
    rows, terms = (given.toDF(*[f"c{i}" for i in range(len(given.columns))]), False) if given is not None else source_rows(spark, m)
    if len(rows.columns) != len(template.parameters):
        raise MapError(f"the query gives {len(rows.columns)} columns, but the template takes {len(template.parameters)}")
    arguments = m.arguments if m.arguments is not None else [ArgumentMap() for _ in template.parameters]
    if len(arguments) != len(template.parameters):
        raise MapError(f"{len(arguments)} argument maps, but the template takes {len(template.parameters)}")
    rows = number_rows(rows, "_row")
    prefixes = Prefixes(library.prefixes | m.prefixes)
    record = F.concat(F.lit(f"m{number}r"), F.col("_row").cast("string"))
    rows = rows.withColumn("_record", record)
    values, problems = {}, []
    for i, (p, a) in enumerate(zip(template.parameters, arguments, strict=True)):
        text = F.col(f"c{i}")
        v, bad, what = argument_value(text, terms, a, prefixes, F.col("_record"), i)
        values[p.name] = v
        say = F.concat(F.lit("row "), (F.col("_row") + 1).cast("string"), F.lit(f": argument {i + 1}: '"), F.coalesce(text, F.lit("")), F.lit("' is not " + (what or "of the parameter's type")))
        tests = [t for t in (bad, kind_problem(v, p)) if t is not None]
        if tests:
            problems.append(F.when(F.coalesce(functools.reduce(operator.or_, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)), say))
    found = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    columns = [v.text.alias(f"_v{i}") for i, v in enumerate(values.values())] + [v.native.alias(f"_n{i}") for i, v in enumerate(values.values()) if v.kind == "list" and v.native is not None]
    lifted = rows.select("_record", "_row", found.alias("_problems"), *columns)
    bound = {}
    for i, (name, v) in enumerate(values.items()):
        bound[name] = Val(v.kind, F.col(f"_v{i}"), v.datatype, v.lang, v.item, F.col(f"_n{i}") if v.kind == "list" and v.native is not None else None, v.safe)
    block = Expander(library).apply(template.iri, [VarPat(p.name) for p in template.parameters], frozenset(), 0, 0)
    good = lifted.filter(F.size("_problems") == 0)
    made = emit(good, Shaper(F.col("_record"), bound).triples(block))
    bad_rows = lifted.select(F.lit(number).alias("map"), (F.col("_row") + 1).alias("row"), F.explode("_problems").alias("message"))
    return made, bad_rows


def run_maps(spark: SparkSession, library: Library | str | list[str], *documents: str) -> BottrResult:
    """All instance maps of Turtle documents (paths or text): the triples of every row that fits, and why others do not."""
    ship(spark)
    lib = library if isinstance(library, Library) else Library.load(*([library] if isinstance(library, str) else library))
    maps: list[InstanceMap] = []
    for d in documents:
        if "\n" in d:
            maps += parse_maps(d)
        else:
            with open(d, encoding="utf-8") as f:
                maps += parse_maps(f.read(), os.path.dirname(os.path.abspath(d)))
    for m in maps:
        lib.get(m.template)  # all maps are checked before any runs
    parts = [run_map(spark, lib, m, k) for k, m in enumerate(maps)]
    union = lambda frames: functools.reduce(lambda a, b: a.union(b), frames)
    return BottrResult(union([t for t, _ in parts]), union([b for _, b in parts]))
