"""RDF terms, namespaces, prefixes and N-Triples text, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
OTTR = "http://ns.ottr.xyz/0.4/"

STRING, BOOLEAN, INTEGER, DECIMAL = XSD + "string", XSD + "boolean", XSD + "integer", XSD + "decimal"
DOUBLE, FLOAT, DATETIME, DATE, TIME, DURATION = XSD + "double", XSD + "float", XSD + "dateTime", XSD + "date", XSD + "time", XSD + "duration"
LANG_STRING, TYPE, NIL, FIRST, REST = RDF + "langString", RDF + "type", RDF + "nil", RDF + "first", RDF + "rest"

#: Derived integer datatypes with their value ranges (None: unbounded).
INTEGER_RANGES: dict[str, tuple[int | None, int | None]] = {
    XSD + "long": (-(2**63), 2**63 - 1),
    XSD + "int": (-(2**31), 2**31 - 1),
    XSD + "short": (-(2**15), 2**15 - 1),
    XSD + "byte": (-128, 127),
    XSD + "nonNegativeInteger": (0, None),
    XSD + "positiveInteger": (1, None),
    XSD + "unsignedLong": (0, 2**64 - 1),
    XSD + "unsignedInt": (0, 2**32 - 1),
    XSD + "unsignedShort": (0, 2**16 - 1),
    XSD + "unsignedByte": (0, 255),
    XSD + "nonPositiveInteger": (None, 0),
    XSD + "negativeInteger": (None, -1),
}
NUMERIC = {INTEGER, DECIMAL, DOUBLE, FLOAT, *INTEGER_RANGES}

#: An absolute IRI, as a pattern that Python and Java read alike.
IRI_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?:[^\x00-\x20<>\"{}|\\^`%]|%[0-9A-Fa-f]{2})*$"
_IRI = re.compile(IRI_PATTERN)


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Literal:
    lexical: str
    datatype: str = STRING
    lang: str | None = None


@dataclass(frozen=True)
class ListTerm:
    """A list argument (OTTR) or an RDF collection."""

    items: tuple

    def __iter__(self):
        return iter(self.items)


@dataclass(frozen=True)
class Var:
    name: str


Term = IRI | BNode | Literal | ListTerm


def is_iri(text: str) -> bool:
    return bool(_IRI.match(text)) and not text.endswith("\n")


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escaped(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def nt(term: Term) -> str:
    """N-Triples text of a term."""
    if isinstance(term, IRI):
        return f"<{term.value}>"
    if isinstance(term, BNode):
        return f"_:{term.label}"
    body = f'"{escaped(term.lexical)}"'
    if term.lang:
        return f"{body}@{term.lang}"
    return body if term.datatype == STRING else f"{body}^^<{term.datatype}>"


_NT = re.compile(r'\s*(?:<([^>]*)>|_:([^\s]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)')
_UNESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def parse_nt_term(text: str, at: int = 0) -> tuple[Term, int]:
    m = _NT.match(text, at)
    if not m:
        raise ValueError(f"no N-Triples term at {text[at : at + 40]!r}")
    if m[1] is not None:
        return IRI(unescaped(m[1])), m.end()
    if m[2] is not None:
        return BNode(m[2].rstrip(".") if m[2].endswith(".") else m[2]), m.end()
    return Literal(unescaped(m[3]), LANG_STRING if m[4] else (m[5] or STRING), m[4]), m.end()


def parse_ntriples(text: str) -> list[tuple[Term, Term, Term]]:
    """Triples of N-Triples or N-Quads text (graphs are dropped)."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            s, at = parse_nt_term(line)
            p, at = parse_nt_term(line, at)
            o, _ = parse_nt_term(line, at)
            out.append((s, p, o))
    return out


class Prefixes(dict):
    """prefix -> namespace, in order of declaration; a later declaration replaces."""

    def expand(self, text: str) -> str | None:
        """IRI of a prefixed name whose prefix is declared; else None."""
        prefix, colon, local = text.partition(":")
        return self[prefix] + local if colon and prefix in self else None

    def cell(self, text: str) -> str:
        """A cell read as an IRI: a prefixed name (not prefix://...), or the text as it is."""
        prefix, colon, local = text.partition(":")
        return self[prefix] + local if colon and prefix in self and not local.startswith("//") else text
