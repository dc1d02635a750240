"""SHACL shapes that a mapping's output conforms to, derived from its plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.plans.model import Block, BNodePat, ConstPat, ListPat, Pattern, Plan, VarPat
from graphloom.plans.rdf import FIRST, IRI, LANG_STRING, NIL, REST, SH, STRING, TYPE, XSD, BNode, ListTerm, Literal, nt


@dataclass
class PropertyShape:
    path: str
    min_count: int = 0
    datatypes: set[str] = field(default_factory=set)
    node_kinds: set[str] = field(default_factory=set)  # iri, bnode, lit
    classes: set[str] | None = None  # None: not known
    # of shapes that users write
    max_count: int | None = None
    pattern: tuple[str, str] | None = None  # expression, flags
    among: tuple | None = None  # terms
    has_values: tuple = ()

    def add(self, other: "PropertyShape") -> None:
        self.min_count = min(self.min_count, other.min_count)
        self.datatypes |= other.datatypes
        self.node_kinds |= other.node_kinds
        self.classes = None if self.classes is None or other.classes is None else self.classes | other.classes


@dataclass
class NodeShape:
    target_class: str | None
    target_node: str | None
    properties: dict[str, PropertyShape] = field(default_factory=dict)
    node_kinds: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class Kind:
    """What a term can be; ``datatypes`` empty: any."""

    kinds: frozenset
    datatypes: frozenset = frozenset()


UNKNOWN = Kind(frozenset({"iri", "bnode", "lit"}))


def term_kind(t, plan: Plan) -> Kind:
    if isinstance(t, ConstPat):
        return constant_kind(t.term)
    if isinstance(t, BNodePat):
        return Kind(frozenset({"bnode"}))
    if isinstance(t, ListPat):
        return Kind(frozenset({"iri", "bnode"}))
    own = variable_kind(t.name, plan)
    if t.fallback is None:
        return own
    other = constant_kind(t.fallback)
    return Kind(own.kinds | other.kinds, own.datatypes | other.datatypes if own.datatypes and other.datatypes else frozenset())


def constant_kind(term) -> Kind:
    if isinstance(term, IRI):
        return Kind(frozenset({"iri"}))
    if isinstance(term, BNode):
        return Kind(frozenset({"bnode"}))
    if isinstance(term, Literal):
        return Kind(frozenset({"lit"}), frozenset({LANG_STRING if term.lang else term.datatype}))
    return Kind(frozenset({"iri", "bnode"}))


def variable_kind(name: str, plan: Plan) -> Kind:
    base = name.split("#")[0]
    for b in plan.bindings:
        if b.var == base:
            if b.depth and "#" not in name:
                return Kind(frozenset({"iri", "bnode"}))
            if b.conversion.kind == "iri":
                return Kind(frozenset({"iri"}))
            if b.conversion.kind == "lang":
                return Kind(frozenset({"lit"}), frozenset({LANG_STRING}))
            if b.column == "ROWNUM" and b.conversion.kind == "plain":
                return Kind(frozenset({"lit"}))
            # an invalid cell keeps its text and its datatype
            return Kind(frozenset({"lit"}), frozenset({b.conversion.argument if b.conversion.kind == "typed" else STRING}))
    if plan.query is not None:
        return query_kind(name, plan)
    return UNKNOWN


STRING_FUNCTIONS = {"str", "lang", "encode_for_uri", "tz", "struuid", "md5", "sha1", "sha256", "sha384", "sha512"}
BOOLEANS = {"||", "&&", "!", "=", "!=", "<", ">", "<=", ">=", "in", "sameterm", "bound", "langmatches", "contains", "strstarts", "strends", "regex", "isiri", "isblank", "isliteral", "isnumeric"}
INTEGERS = {"strlen", "year", "month", "day", "hours", "minutes"}


def query_kind(name: str, plan: Plan) -> Kind:
    from graphloom.sparql.compile import mentioned, spine_binds, staged

    steps = staged(plan.query.select.where)
    for s in steps:
        if s[0] == "bind" and s[2] == name:
            return expression_kind(s[1], plan)
        if s[0] == "property" or s[0] not in ("bind", "filter", "minus"):
            continue
    if name == "ROWNUM":
        return Kind(frozenset({"lit"}), frozenset({XSD + "integer"}))
    if name in mentioned(plan.query) and name not in spine_binds(plan.query.select.where) and all(s[0] in ("bind", "filter", "minus") for s in steps):
        return Kind(frozenset({"lit"}), frozenset({STRING}))
    return UNKNOWN


def expression_kind(e, plan: Plan) -> Kind:
    lit = lambda *dts: Kind(frozenset({"lit"}), frozenset(dts))
    if e[0] == "term":
        return constant_kind(e[1])
    if e[0] == "var":
        return query_kind(e[1], plan)
    if e[0] == "exists":
        return lit(XSD + "boolean")
    name, args = e[1], e[2]
    if name in ("iri", "uuid") or name.endswith("expandPrefixedName"):
        return Kind(frozenset({"iri"}))
    if name == "datatype":
        return Kind(frozenset({"iri"}))
    if name == "bnode":
        return Kind(frozenset({"bnode"}))
    if name in BOOLEANS:
        return lit(XSD + "boolean")
    if name in STRING_FUNCTIONS or name.endswith("expandPrefix"):
        return lit(STRING)
    if name in INTEGERS:
        return lit(XSD + "integer")
    if name == "seconds":
        return lit(XSD + "decimal")
    if name in ("now",):
        return lit(XSD + "dateTime")
    if name == "strlang":
        return lit(LANG_STRING)
    if name == "strdt" and args[1][0] == "term":
        from graphloom.plans.rdf import INTEGER, INTEGER_RANGES

        dt = args[1][1].value
        return lit(INTEGER if dt in INTEGER_RANGES else dt)
    if name.startswith(XSD):
        return lit(name)
    if name in ("if", "coalesce"):
        parts = [expression_kind(a, plan) for a in (args[1:] if name == "if" else args) if not (a[0] == "var" and unbound(a[1], plan))]
        if not parts:
            return UNKNOWN
        kinds = frozenset().union(*(p.kinds for p in parts))
        literal = [p for p in parts if "lit" in p.kinds]
        return Kind(kinds, frozenset().union(*(p.datatypes for p in literal)) if literal and all(p.datatypes for p in literal) else frozenset())
    return Kind(frozenset({"lit"}))


def unbound(name: str, plan: Plan) -> bool:
    """A variable that only marks 'no value', as ?none."""
    return name.lower() in ("none", "_u", "_", "unbound")


def derive(plan: Plan, base: str = "urn:shapes:") -> list[NodeShape]:
    """One shape per constant class, and one per untyped constant subject."""
    by_subject: dict = {}
    for block, repeated in blocks(plan.root):
        for p in block.patterns:
            by_subject.setdefault(p.subject, []).append((p, repeated))
    typed: dict = {}
    for s, patterns in by_subject.items():
        for p, _ in patterns:
            if p.predicate == ConstPat(IRI(TYPE)) and isinstance(p.object, ConstPat) and isinstance(p.object.term, IRI):
                typed.setdefault(s, []).append((p, p.object.term.value))
    classes = {c for found in typed.values() for _, c in found}
    dynamic_type = any(isinstance(p.predicate, ConstPat) and p.predicate.term == IRI(TYPE) and not isinstance(p.object, ConstPat) for b, _ in blocks(plan.root) for p in b.patterns)
    dynamic_predicate = any(not isinstance(p.predicate, ConstPat) for b, _ in blocks(plan.root) for p in b.patterns)
    out = []
    for cls in sorted(classes):
        shape = NodeShape(cls, None)
        # a subject may get its class from any block that names it; all their triples can meet on one node
        sources = [s for s, found in typed.items() if any(c == cls for _, c in found)]
        for s in sources:
            shape.node_kinds |= term_kind(s, plan).kinds
        merge = any(isinstance(s, (VarPat, ConstPat)) for s in sources)
        first = True
        for s in sources:
            marker = next(p for p, c in typed[s] if c == cls)
            own: dict[str, PropertyShape] = {}
            for p, repeated in by_subject[s]:
                if isinstance(p.predicate, ConstPat):
                    made = property_shape(p, marker, repeated, plan, typed)
                    if p.predicate.term.value in own:
                        old = own[p.predicate.term.value]
                        low = max(old.min_count, made.min_count)
                        old.add(made)
                        old.min_count = low
                    else:
                        own[p.predicate.term.value] = made
            for path in {*shape.properties, *own}:
                if path in shape.properties and path in own:
                    shape.properties[path].add(own[path])
                elif path in own:
                    shape.properties[path] = own[path]
                    if not first:
                        shape.properties[path].min_count = 0
                else:
                    shape.properties[path].min_count = 0
            first = False
        if merge:
            widen(shape, sources, by_subject, plan)
        if dynamic_type or dynamic_predicate:
            for p in shape.properties.values():
                p.classes = None
        out.append(shape)
    for s in by_subject:
        if isinstance(s, ConstPat) and s not in typed and isinstance(s.term, IRI):
            shape = NodeShape(None, s.term.value)
            for p, repeated in by_subject[s]:
                if isinstance(p.predicate, ConstPat):
                    made = property_shape(p, None, repeated, plan, typed)
                    made.min_count = 0
                    path = p.predicate.term.value
                    if path in shape.properties:
                        shape.properties[path].add(made)
                    else:
                        shape.properties[path] = made
            out.append(shape)
    return out


def blocks(block: Block, repeated: bool = False):
    yield block, repeated
    for r in block.repeats:
        yield from blocks(r.body, True)


def property_shape(p: Pattern, marker: Pattern | None, repeated: bool, plan: Plan, typed: dict) -> PropertyShape:
    kind = term_kind(p.object, plan)
    needs = p.requires | {t.name for t in (p.subject, p.predicate, p.object) if isinstance(t, VarPat) and t.fallback is None}
    has = marker.requires | {t.name for t in (marker.subject, marker.object) if isinstance(t, VarPat) and t.fallback is None} if marker is not None else frozenset()
    always = marker is not None and needs <= has and not repeated and not isinstance(p.object, ListPat)
    classes = {c for _, c in typed[p.object]} if p.object in typed and isinstance(p.object, BNodePat) else None
    return PropertyShape(p.predicate.term.value, int(always), set(kind.datatypes) if "lit" in kind.kinds else set(), set(kind.kinds), classes)


def widen(shape: NodeShape, sources: list, by_subject: dict, plan: Plan) -> None:
    """Other blocks may write to the same IRI: their properties join in, so constraints that they may break go."""
    for s, patterns in by_subject.items():
        if s in sources or not isinstance(s, (VarPat, ConstPat)):
            continue
        for p, _ in patterns:
            if isinstance(p.predicate, ConstPat) and p.predicate.term.value in shape.properties:
                kind = term_kind(p.object, plan)
                old = shape.properties[p.predicate.term.value]
                old.datatypes = old.datatypes | kind.datatypes if old.datatypes and (kind.datatypes or "lit" not in kind.kinds) else set()
                old.node_kinds |= kind.kinds
                old.classes = None


NODE_KINDS = {
    frozenset({"iri"}): "IRI", frozenset({"bnode"}): "BlankNode", frozenset({"lit"}): "Literal",
    frozenset({"iri", "bnode"}): "BlankNodeOrIRI", frozenset({"iri", "lit"}): "IRIOrLiteral", frozenset({"bnode", "lit"}): "BlankNodeOrLiteral",
}


def shape_triples(shapes: list[NodeShape], base: str = "urn:shapes:") -> list[tuple]:
    """The shapes as RDF triples."""
    out, count = [], 0
    for i, s in enumerate(shapes):
        node = IRI(f"{base}shape{i}")
        out.append((node, IRI(TYPE), IRI(SH + "NodeShape")))
        if s.target_class:
            out.append((node, IRI(SH + "targetClass"), IRI(s.target_class)))
        if s.target_node:
            out.append((node, IRI(SH + "targetNode"), IRI(s.target_node)))
        for path in sorted(s.properties):
            p, count = s.properties[path], count + 1
            prop = BNode(f"p{count}")
            out += [(node, IRI(SH + "property"), prop), (prop, IRI(SH + "path"), IRI(path))]
            if p.min_count:
                out.append((prop, IRI(SH + "minCount"), Literal(str(p.min_count), XSD + "integer")))
            if p.node_kinds == {"lit"} and len(p.datatypes) == 1:
                out.append((prop, IRI(SH + "datatype"), IRI(next(iter(p.datatypes)))))
            elif frozenset(p.node_kinds) in NODE_KINDS:
                out.append((prop, IRI(SH + "nodeKind"), IRI(SH + NODE_KINDS[frozenset(p.node_kinds)])))
            for c in sorted(p.classes or ()):
                out.append((prop, IRI(SH + "class"), IRI(c)))
    return out


def turtle(shapes: list[NodeShape], base: str = "urn:shapes:") -> str:
    """The shapes as N-Triples text (which is Turtle)."""
    return "".join(f"{nt(s)} {nt(p)} {nt(o)} .\n" for s, p, o in shape_triples(shapes, base))


#: What constrains nothing, and what is read, of node shapes and property shapes.
ANNOTATIONS = {SH + x for x in ("name", "description", "order", "group", "message", "severity", "defaultValue")}
ON_NODES = ANNOTATIONS | {SH + x for x in ("targetClass", "targetNode", "property")}
ON_PROPERTIES = ANNOTATIONS | {SH + x for x in ("path", "minCount", "maxCount", "datatype", "nodeKind", "class", "pattern", "flags", "in", "hasValue")}


def refuse_unknown(pairs, known: set[str]) -> None:
    for p, _ in pairs:
        if p.startswith(SH) and p not in known:
            raise ValueError(f"the constraint sh:{p.removeprefix(SH)} is not supported here")


def members(head, about: dict):
    """Terms of an RDF collection."""
    if isinstance(head, ListTerm):
        yield from head.items
        return
    seen = set()
    while head != IRI(NIL):
        links = dict(about.get(head, ()))
        if head in seen or FIRST not in links or REST not in links:
            raise ValueError("sh:in needs a well-formed list")
        seen.add(head)
        yield links[FIRST]
        head = links[REST]


def shapes_from(triples: list[tuple]) -> list[NodeShape]:
    """Shapes read from RDF triples; a document without shapes, or with constraints that are not checked, is refused."""
    about: dict = {}
    for s, p, o in triples:
        about.setdefault(s, []).append((p.value, o))
    kinds = {SH + v: set(k) for k, v in NODE_KINDS.items()}
    out = []
    for node, pairs in about.items():
        targets = [(p, o) for p, o in pairs if p in (SH + "targetClass", SH + "targetNode")]
        if targets:
            refuse_unknown(pairs, ON_NODES)
        for p, target in targets:
            shape = NodeShape(target.value, None) if p.endswith("targetClass") else NodeShape(None, target.value)
            for q, prop in pairs:
                if q != SH + "property":
                    continue
                facts = dict(about.get(prop, ()))
                refuse_unknown(about.get(prop, ()), ON_PROPERTIES)
                if not isinstance(facts.get(SH + "path"), IRI):
                    raise ValueError("a property shape needs a path that is one IRI")
                path = facts[SH + "path"].value
                if path in shape.properties:
                    raise ValueError(f"two property shapes of one node shape have the path <{path}>")
                made = PropertyShape(path)
                if SH + "maxCount" in facts:
                    made.max_count = int(facts[SH + "maxCount"].lexical)
                if SH + "pattern" in facts:
                    made.pattern = facts[SH + "pattern"].lexical, facts[SH + "flags"].lexical if SH + "flags" in facts else ""
                if SH + "in" in facts:
                    made.among = tuple(members(facts[SH + "in"], about))
                made.has_values = tuple(o for k, o in about.get(prop, ()) if k == SH + "hasValue")
                if SH + "minCount" in facts:
                    made.min_count = int(facts[SH + "minCount"].lexical)
                if SH + "datatype" in facts:
                    made.node_kinds, made.datatypes = {"lit"}, {facts[SH + "datatype"].value}
                if SH + "nodeKind" in facts:
                    made.node_kinds = kinds[facts[SH + "nodeKind"].value]
                made.classes = {o.value for k, o in about.get(prop, ()) if k == SH + "class"} or None
                shape.properties[path] = made
            out.append(shape)
    if not out:
        raise ValueError("the document holds no shapes with a target")
    return out


