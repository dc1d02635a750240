"""The plan that every mapping language compiles to: how a row binds variables, and the shape of its triples."""

from __future__ import annotations

from dataclasses import dataclass, field

from .rdf import Prefixes, Term


@dataclass(frozen=True)
class VarPat:
    """The value of a variable, or ``fallback`` where it has none."""

    name: str
    fallback: Term | None = None


@dataclass(frozen=True)
class ConstPat:
    term: Term


@dataclass(frozen=True)
class BNodePat:
    """A blank node, fresh for each solution, or for each repetition of the Repeat ``scope`` it is made in."""

    id: int
    scope: int = 0


@dataclass(frozen=True)
class ListPat:
    items: tuple


TermPat = VarPat | ConstPat | BNodePat | ListPat


@dataclass(frozen=True)
class Pattern:
    """One triple, made if its own terms and all of ``requires`` have values."""

    subject: TermPat
    predicate: TermPat
    object: TermPat
    requires: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Repeat:
    """The body once for each tuple of elements of the lists; ``mode`` is cross, zipMin or zipMax."""

    mode: str
    lists: tuple[tuple[str, str], ...]  # (list variable, element variable)
    body: "Block"
    id: int = 0
    requires: frozenset[str] = frozenset()


@dataclass
class Block:
    patterns: list[Pattern] = field(default_factory=list)
    repeats: list[Repeat] = field(default_factory=list)

    def all_patterns(self):
        yield from self.patterns
        for r in self.repeats:
            yield from r.body.all_patterns()


@dataclass(frozen=True)
class Conversion:
    """How a cell becomes a term: plain, iri, typed or lang."""

    kind: str
    argument: str = ""


@dataclass(frozen=True)
class Binding:
    """A variable read from a column; ``depth`` > 0 makes a list, split at ``separator`` if the column is text."""

    var: str
    column: str
    conversion: Conversion
    depth: int = 0
    separator: str | None = None
    optional: bool = False


@dataclass
class Plan:
    """``bindings`` (column lifting) or ``query`` (a parsed WHERE group) binds the variables of ``root``."""

    name: str
    prefixes: Prefixes
    root: Block
    bindings: list[Binding] = field(default_factory=list)
    query: object | None = None
    mandatory: frozenset[str] = frozenset()  # variables without which a row makes nothing
