"""Symbolic expansion of templates down to triples, once per plan."""

from __future__ import annotations

import itertools
import re

from graphloom.plans.model import Binding, Block, BNodePat, ConstPat, Conversion, ListPat, Pattern, Plan, Repeat, VarPat
from graphloom.plans.rdf import LANG_STRING, OTTR, OWL, RDF, RDFS, STRING, XSD, BNode, Literal, ListTerm, Prefixes, Var
from graphloom.plans.rdf import IRI as Iri

from .syntax import NONE, NULLABLE_TRIPLE, TRIPLE, Instance, Library, OttrError, Template, Type

MAX_DEPTH = 64

#: Types whose cells are read as IRIs.
IRI_TYPES = {
    OTTR + "IRI",
    *(OWL + x for x in ("Class", "NamedIndividual", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Ontology")),
    RDFS + "Datatype",
    RDFS + "Class",
    RDF + "Property",
}


class Expander:
    def __init__(self, library: Library):
        self.library = library
        self.ids = itertools.count(1)

    def instance(self, inst: Instance, values: dict, bnodes: dict, requires: frozenset, scope: int, depth: int) -> Block:
        """One instance in a template's body (or a root), with the enclosing template's values."""
        if depth > MAX_DEPTH:
            raise OttrError(f"templates nest deeper than {MAX_DEPTH}: is <{inst.template}> cyclic?")
        args = [(self.symbolic(a.term, values, bnodes, scope), a.expand) for a in inst.arguments]
        if inst.expander is None:
            if any(e for _, e in args):
                raise OttrError(f"<{inst.template}>: an argument is marked ++ without an expander")
            return self.apply(inst.template, [t for t, _ in args], requires, scope, depth)
        marked = [k for k, (_, e) in enumerate(args) if e]
        if not marked:
            raise OttrError(f"<{inst.template}>: {inst.expander} without an argument marked ++")
        plain = [t for t, _ in args]
        if any(plain[k] is None for k in marked):
            return Block()
        if all(isinstance(plain[k], ListPat) for k in marked):
            lists = [plain[k].items for k in marked]
            out = Block()
            for row in combine(inst.expander, lists):
                now = list(plain)
                for k, x in zip(marked, row, strict=True):
                    now[k] = x
                part = self.apply(inst.template, now, requires, scope, depth)
                out.patterns += part.patterns
                out.repeats += part.repeats
            return out
        if not all(isinstance(plain[k], VarPat) for k in marked):
            raise OttrError(f"<{inst.template}>: constant lists and lists from values cannot be expanded together")
        number = next(self.ids)
        lists, now = [], list(plain)
        for k in marked:
            if plain[k].fallback is not None:
                raise OttrError(f"<{inst.template}>: a list with a default cannot be expanded")
            element = f"{plain[k].name}#{number}.{k}"
            lists.append((plain[k].name, element))
            now[k] = VarPat(element)
        body = self.apply(inst.template, now, requires, number, depth)
        return Block([], [Repeat(inst.expander, tuple(lists), body, number, requires)]) if body.patterns or body.repeats else Block()

    def symbolic(self, term, values: dict, bnodes: dict, scope: int):
        """A term of a body: a pattern, or None for none."""
        if term == NONE:
            return None
        if isinstance(term, Var):
            if term.name not in values:
                raise OttrError(f"variable ?{term.name} is not a parameter")
            return values[term.name]
        if isinstance(term, BNode):
            if term.label not in bnodes:
                bnodes[term.label] = BNodePat(next(self.ids), scope)
            return bnodes[term.label]
        if isinstance(term, ListTerm):
            items = [self.symbolic(x, values, bnodes, scope) for x in term.items]
            if any(x is None for x in items):
                raise OttrError("none stands in a list")
            return ListPat(tuple(items))
        return ConstPat(term)

    def apply(self, iri: str, args: list, requires: frozenset, scope: int, depth: int) -> Block:
        template = self.library.get(iri)
        if len(args) != len(template.parameters):
            raise OttrError(f"<{iri}> takes {len(template.parameters)} arguments, not {len(args)}")
        values = {}
        for p, a in zip(template.parameters, args, strict=True):
            if p.default is not None and p.default != NONE:
                default = self.symbolic(p.default, {}, {}, scope)
                if a is None:
                    a = default
                elif isinstance(a, VarPat) and a.fallback is None and isinstance(default, ConstPat):
                    a = VarPat(a.name, default.term)
            elif not p.optional:
                if a is None:
                    return Block()
                requires = requires | needed(a)
            values[p.name] = a
        if iri in (TRIPLE, NULLABLE_TRIPLE):
            s, pr, o = (values[p.name] for p in template.parameters)
            if s is None or pr is None or o is None:
                return Block()
            if isinstance(s, ConstPat) and isinstance(s.term, (Literal, ListTerm)) or isinstance(s, ListPat):
                return Block()
            if isinstance(pr, ConstPat) and not isinstance(pr.term, Iri) or isinstance(pr, (ListPat, BNodePat)):
                return Block()
            return Block([Pattern(s, pr, o, requires)])
        if template.kind != "template":
            raise OttrError(f"template <{iri}> is not defined, only its signature")
        out, bnodes = Block(), {}
        for inst in template.body:
            part = self.instance(inst, values, bnodes, requires, scope, depth + 1)
            out.patterns += part.patterns
            out.repeats += part.repeats
        return out


def needed(a) -> frozenset:
    if isinstance(a, VarPat):
        return frozenset() if a.fallback is not None else frozenset([a.name])
    if isinstance(a, ListPat):
        return frozenset().union(*(needed(x) for x in a.items)) if a.items else frozenset()
    return frozenset()


def combine(mode: str, lists: list) -> list[tuple]:
    if mode == "cross":
        return list(itertools.product(*lists))
    if mode == "zipMin":
        return list(zip(*lists))  # noqa: B905  (to the shortest)
    return list(itertools.zip_longest(*lists))


def conversion(kind: Type | None, parameter: str, languages: dict[str, str]) -> tuple[Conversion, int]:
    """(how a cell of the type is read, list depth)."""
    depth = 0
    while kind is not None and kind.of is not None:
        depth += kind.name != "LUB"
        kind = kind.of
    if parameter in languages:
        return Conversion("lang", languages[parameter].lower()), depth
    if kind is None or kind.name == STRING:
        return Conversion("plain"), depth
    if kind.name in IRI_TYPES:
        return Conversion("iri"), depth
    if kind.name == LANG_STRING:
        raise OttrError(f"parameter ?{parameter} is an rdf:langString: name its language")
    if kind.name.startswith(XSD):
        return Conversion("typed", kind.name), depth
    return Conversion("plain"), depth


def compile_templates(library: Library, roots: list[str], lists: dict[str, str] | None = None, languages: dict[str, str] | None = None, prefixes: Prefixes | None = None) -> Plan:
    """One plan for root templates whose parameters are columns of the same names."""
    lists, languages = lists or {}, languages or {}
    expander, root = Expander(library), Block()
    bindings: dict[tuple, Binding] = {}
    known: set[str] = set()
    mandatory: list[frozenset] = []
    for name in roots:
        template = library.get(library.resolve(name))
        if template.kind != "template":
            raise OttrError(f"<{template.iri}> has no pattern to expand")
        args = []
        known |= {p.name for p in template.parameters}
        for p in template.parameters:
            how, depth = conversion(p.type, p.name, languages)
            separator = lists.get(p.name)
            if separator is not None and not depth:
                raise OttrError(f"parameter ?{p.name} is not a list")
            key = (p.name, how, depth, separator)
            optional = p.optional or p.default is not None
            if key not in bindings:
                var = p.name if all(b.var != p.name for b in bindings.values()) else f"{p.name}@{len(bindings)}"
                bindings[key] = Binding(var, p.name, how, depth, separator, optional)
            elif not optional and bindings[key].optional:
                old = bindings[key]
                bindings[key] = Binding(old.var, old.column, how, depth, separator, False)
            args.append(VarPat(bindings[key].var))
        part = expander.apply(template.iri, args, frozenset(), 0, 0)
        root.patterns += part.patterns
        root.repeats += part.repeats
        mandatory.append(required(part))
    if unknown := ({*lists} | {*languages}) - known:
        raise OttrError(f"no parameter is called {', '.join('?' + x for x in sorted(unknown))}")
    every = frozenset.intersection(*mandatory) if mandatory else frozenset()
    return Plan(", ".join(roots), Prefixes(library.prefixes | (prefixes or {})), root, list(bindings.values()), mandatory=every)


def required(block: Block) -> frozenset:
    """Variables that every pattern of the block needs."""
    sets = [p.requires for p in block.patterns] + [r.requires for r in block.repeats]
    return frozenset.intersection(*sets) if sets else frozenset()


def query_annotations(template: Template) -> dict[str, list] | None:
    """The parts of a row query in a template's annotations (Prefix, Base, Bind, Where, Modifiers), or None."""
    out: dict[str, list] = {}
    for a in template.annotations:
        local = re.split(r"[#/]", a.template)[-1]
        if local in ("Prefix", "Base", "Bind", "Where", "Modifiers", "Source"):
            out.setdefault(local, []).append([x.term.lexical if isinstance(x.term, Literal) else getattr(x.term, "value", "") for x in a.arguments])
    return out if any(k in out for k in ("Prefix", "Bind", "Where", "Modifiers")) else None


