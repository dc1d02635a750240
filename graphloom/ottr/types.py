"""The OTTR type lattice."""

from __future__ import annotations

from graphloom.plans.rdf import LANG_STRING, OTTR, OWL, RDF, RDFS, STRING, XSD, BNode, Literal, ListTerm
from graphloom.plans.rdf import IRI as Iri

from .syntax import Type

RESOURCE, LITERAL, BOT, ANY_IRI = RDFS + "Resource", RDFS + "Literal", OTTR + "Bot", OTTR + "IRI"

#: Fixed values of the type system: each type's direct supertype (x: xsd, o: owl, r: rdf, s: rdfs, t: ottr).
_TREE = """
s:Resource > t:IRI s:Literal
t:IRI > o:Class o:NamedIndividual o:ObjectProperty o:DatatypeProperty o:AnnotationProperty s:Datatype
s:Literal > t:string o:real x:double x:float x:boolean x:dateTime x:date x:time x:duration x:gDay x:gMonth x:gMonthDay x:gYear x:gYearMonth x:hexBinary x:base64Binary x:anyURI r:HTML r:XMLLiteral
t:string > x:string r:langString
x:string > x:normalizedString
x:normalizedString > x:token
x:token > x:language x:Name
x:Name > x:NCName x:NMTOKEN
o:real > o:rational
o:rational > x:decimal
x:decimal > x:integer
x:integer > x:long x:nonNegativeInteger x:nonPositiveInteger
x:long > x:int
x:int > x:short
x:short > x:byte
x:nonNegativeInteger > x:positiveInteger
x:positiveInteger > x:unsignedLong
x:unsignedLong > x:unsignedInt
x:unsignedInt > x:unsignedShort
x:unsignedShort > x:unsignedByte
x:nonPositiveInteger > x:negativeInteger
x:dateTime > x:dateTimeStamp
x:duration > x:dayTimeDuration x:yearMonthDuration
"""
_SPACES = {"x": XSD, "o": OWL, "r": RDF, "s": RDFS, "t": OTTR}


def _iri(short: str) -> str:
    space, name = short.split(":")
    return _SPACES[space] + name


PARENT = {_iri(child): _iri(line.split(" > ")[0]) for line in _TREE.strip().splitlines() for child in line.split(" > ")[1].split()}
KNOWN = {RESOURCE, BOT, *PARENT}


def ancestors(name: str) -> list[str]:
    out = [name]
    while out[-1] in PARENT:
        out.append(PARENT[out[-1]])
    return out


def basic_subtype(a: str, b: str) -> bool:
    if a == BOT or a == b or b == RESOURCE:
        return True
    return b in (ancestors(a) if a in KNOWN else [a, RESOURCE])


def subtype(a: Type, b: Type) -> bool:
    """Is every a a b?"""
    if b.name == RESOURCE:
        return True
    if a.name == "LUB":
        return b.name == "LUB" and subtype(a.of, b.of) or (b.of is None and subtype(a.of, b))
    if b.name == "LUB":
        return subtype(a, b.of) if b.of else False
    if b.of is not None:
        return a.of is not None and (a.name == b.name or (a.name, b.name) == ("NEList", "List")) and subtype(a.of, b.of)
    return a.of is None and basic_subtype(a.name, b.name)


def compatible(a: Type, b: Type) -> bool:
    """May a value of type a be given where b is wanted?  LUB<T> may be any subtype of T."""
    if a.name == "LUB":
        return compatible(a.of, b) or subtype(b, a.of)
    return subtype(a, b)


def consistent(a: Type, b: Type) -> bool:
    """Can one value have both types?"""
    if a.of is not None and a.name == "LUB":
        a = a.of
    if b.of is not None and b.name == "LUB":
        b = b.of
    if RESOURCE in (a.name, b.name):
        return True
    if (a.of is None) != (b.of is None):
        return False
    if a.of is not None:
        return consistent(a.of, b.of)
    return basic_subtype(a.name, b.name) or basic_subtype(b.name, a.name)


def join(a: Type, b: Type) -> Type:
    """The least type above both."""
    if a.name == BOT:
        return b
    if b.name == BOT:
        return a
    if a.of is not None and b.of is not None:
        name = "NEList" if a.name == b.name == "NEList" else "List"
        return Type(name, join(a.of, b.of))
    if a.of is not None or b.of is not None:
        return Type(RESOURCE)
    above = ancestors(b.name) if b.name in KNOWN else [b.name, RESOURCE]
    return Type(next((x for x in (ancestors(a.name) if a.name in KNOWN else [a.name, RESOURCE]) if x in above), RESOURCE))


def type_of(term) -> Type:
    """The type of a constant."""
    if isinstance(term, Iri):
        return Type("LUB", Type(ANY_IRI))
    if isinstance(term, BNode):
        return Type("LUB", Type(RESOURCE))
    if isinstance(term, Literal):
        if term.lang:
            return Type(LANG_STRING)
        return Type(term.datatype if term.datatype in KNOWN else LITERAL)
    if isinstance(term, ListTerm):
        if not term.items:
            return Type("List", Type(BOT))
        out = type_of(term.items[0])
        for x in term.items[1:]:
            out = join(out.of if out.name == "LUB" else out, (t := type_of(x)).of if t.name == "LUB" else t)
        return Type("NEList", out)
    raise TypeError(term)


__all__ = ["ANY_IRI", "BOT", "KNOWN", "LITERAL", "RESOURCE", "STRING", "ancestors", "compatible", "consistent", "join", "subtype", "type_of"]
