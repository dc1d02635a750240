"""Statically typed RDF values as Spark columns.

A value's kind (IRI, blank node, literal of a datatype, list, or dynamic) is known while the plan is
compiled, so most variables are one native string column.  Null means unbound.  Only a
variable that may hold several kinds becomes a ``dyn`` struct (k, v, dt, lang).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import literals as L

from .rdf import IRI, LANG_STRING, NUMERIC, STRING, BNode, ListTerm, Literal, Term, nt

DYN = "struct<k:string,v:string,dt:string,lang:string>"


@dataclass(frozen=True)
class Val:
    """kind: iri, bnode, lit, list or dyn.

    text: the IRI, label or lexical form (dyn: the struct; list: an array of the item's columns).
    datatype: of a literal.  lang: language tag, static text or a column.  item: kind of a list's elements.
    native: the value as a Spark number or boolean, if known.  safe: the lexical form needs no escapes.
    """

    kind: str
    text: Column
    datatype: str = STRING
    lang: str | Column | None = None
    item: "Val | None" = None
    native: Column | None = None
    safe: bool = False

    @property
    def bound(self) -> Column:
        return self.text.isNotNull()

    def at(self, column: Column) -> "Val":
        """The same kind of value in another column."""
        lang = None if isinstance(self.lang, Column) else self.lang
        if isinstance(self.lang, Column):
            raise ValueError("a value with a language column is kept as dyn")
        return replace(self, text=column, native=None, lang=lang)

    def only(self, cond: Column) -> "Val":
        """Unbound unless cond is true."""
        native = None if self.native is None else F.when(cond, self.native)
        return replace(self, text=F.when(cond, self.text), native=native)


def string(text: Column) -> Val:
    return Val("lit", text)


def boolean(native: Column) -> Val:
    from .rdf import BOOLEAN

    return Val("lit", native.cast("string"), BOOLEAN, native=native, safe=True)


def null_value() -> Val:
    return string(F.lit(None).cast("string"))


def constant(term: Term) -> Val:
    if isinstance(term, IRI):
        return Val("iri", F.lit(term.value))
    if isinstance(term, BNode):
        return Val("bnode", F.lit(term.label))
    if isinstance(term, Literal):
        return Val("lit", F.lit(term.lexical), term.datatype, term.lang)
    items = [constant(t) for t in term]
    return list_of(items)


def same_kind(a: Val, b: Val) -> bool:
    if a.kind != b.kind or a.kind == "dyn":
        return a.kind == b.kind
    if a.kind == "list":
        return a.item is not None and b.item is not None and same_kind(a.item, b.item)
    if a.kind == "lit":
        return a.datatype == b.datatype and not isinstance(a.lang, Column) and not isinstance(b.lang, Column) and a.lang == b.lang
    return True


def list_of(items: list[Val]) -> Val:
    if not items:
        return Val("list", F.array().cast("array<string>"), item=string(F.lit("")))
    if not all(same_kind(items[0], x) for x in items) or items[0].kind == "list" or isinstance(items[0].lang, Column):
        items = [dyn(x) for x in items]
    text = F.array(*[x.text for x in items])
    missing = items[0].text.isNull()
    for x in items[1:]:
        missing = missing | x.text.isNull()
    return Val("list", F.when(~missing, text), item=items[0])


def dyn(v: Val) -> Val:
    """As a dyn struct (null where unbound)."""
    if v.kind == "dyn":
        return v
    if v.kind == "list":
        raise ValueError("a list cannot stand where a single value is wanted")
    null = F.lit(None).cast("string")
    if v.kind == "lit":
        lang = v.lang if isinstance(v.lang, Column) else F.lit(v.lang).cast("string")
        s = F.struct(F.lit("lit").alias("k"), v.text.alias("v"), F.lit(LANG_STRING if v.lang is not None else v.datatype).alias("dt"), lang.alias("lang"))
    else:
        s = F.struct(F.lit(v.kind).alias("k"), v.text.alias("v"), null.alias("dt"), null.alias("lang"))
    return Val("dyn", F.when(v.text.isNotNull(), s).cast(DYN))


def unify(values: list[Val]) -> list[Val]:
    """The values in one kind: unchanged if they agree, else all dyn."""
    if all(same_kind(values[0], v) for v in values[1:]):
        return values
    return [dyn(v) for v in values]


def render(v: Val) -> Column:
    """N-Triples text; null where unbound."""
    if v.kind == "iri":
        return F.concat(F.lit("<"), v.text, F.lit(">"))
    if v.kind == "bnode":
        return F.concat(F.lit("_:"), v.text)
    if v.kind == "lit":
        if v.lang is not None:
            tag = v.lang if isinstance(v.lang, Column) else F.lit(v.lang)
            return F.concat(F.lit('"'), L.escaped(v.text), F.lit('"@'), tag)
        return L.literal_nt(v.text, v.datatype, v.safe)
    if v.kind == "dyn":
        s = v.text
        tail = F.when(s["lang"].isNotNull(), F.concat(F.lit('"@'), s["lang"])).when(s["dt"] == STRING, F.lit('"')).otherwise(F.concat(F.lit('"^^<'), s["dt"], F.lit(">")))
        return (
            F.when(s["k"] == "iri", F.concat(F.lit("<"), s["v"], F.lit(">")))
            .when(s["k"] == "bnode", F.concat(F.lit("_:"), s["v"]))
            .when(s["k"] == "lit", F.concat(F.lit('"'), L.escaped(s["v"]), tail))
        )
    raise ValueError("a list has no N-Triples text of its own")


def render_constant(term: Term) -> Column:
    return F.lit(nt(term))


def can_be(v: Val, *kinds: str) -> Column | bool:
    """Is the value of one of the kinds?  True or False where static."""
    if v.kind != "dyn":
        return v.kind in kinds
    return v.text["k"].isin(*kinds)


def plain_text(v: Val) -> Column:
    """STR(): the IRI or lexical form; null for a blank node."""
    if v.kind == "dyn":
        return F.when(v.text["k"] != "bnode", v.text["v"])
    if v.kind == "bnode":
        return F.lit(None).cast("string")
    return v.text


def is_numeric(v: Val) -> bool:
    return v.kind == "lit" and v.datatype in NUMERIC and v.lang is None


def list_term(items) -> ListTerm:
    return ListTerm(tuple(items))
