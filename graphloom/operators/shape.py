"""The shape layer: bound variables to triples, one native expression per plan.

A row's triples form one array that a single ``explode`` emits: one scan, no shuffle, no UDF.
Blank-node labels are ``b{record}x{number}`` with a static number per node of the plan (and
the element position in a repetition), so they do not depend on partitioning or order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.plans.model import Block, BNodePat, ConstPat, ListPat, Pattern, Repeat, TermPat, VarPat
from graphloom.plans.rdf import FIRST, IRI, NIL, REST, ListTerm, Literal
from graphloom.plans.typed import Val, constant, dyn, list_of, render, same_kind

TRIPLE = "struct<subject:string,predicate:string,object:string>"


class Place:
    """Where in the plan's repetitions a term is made: the current Repeat and the element paths of all around it."""

    def __init__(self, scope: int = 0, paths: dict[int, Column] | None = None):
        self.scope, self.paths = scope, paths or {}

    @property
    def path(self) -> Column | None:
        return self.paths.get(self.scope)

    def inside(self, scope: int, path: Column) -> "Place":
        return Place(scope, self.paths | {scope: path})


class Shaper:
    """Builds the triple array of a block.  ``record`` labels the row; ``values`` are the bound variables."""

    def __init__(self, record: Column, values: dict[str, Val]):
        self.record, self.values = record, values
        self.lists = 0

    def triples(self, block: Block, place: Place | None = None, values: dict[str, Val] | None = None) -> Column | None:
        """array<struct<subject, predicate, object>> with null for what is not made, or None where nothing can be made."""
        values = self.values if values is None else values
        place = place or Place()
        parts, single = [], []
        for p in block.patterns:
            one, more = self.pattern(p, place, values)
            if one is not None:
                single.append(one)
            parts += more
        if single:
            parts.insert(0, F.array(*single))
        for r in block.repeats:
            if (made := self.repeat(r, place, values)) is not None:
                parts.append(made)
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def label(self, number: str, path: Column | None) -> Column:
        tail = [F.lit("_"), path] if path is not None else []
        return F.concat(F.lit("b"), self.record, F.lit(f"x{number}"), *tail)

    def term(self, t: TermPat, place: Place, values: dict[str, Val]) -> Val:
        if isinstance(t, ConstPat):
            return constant(t.term)
        if isinstance(t, BNodePat):
            return Val("bnode", self.label(str(t.id), place.paths.get(t.scope)))
        if isinstance(t, ListPat):
            return list_of([self.term(x, place, values) for x in t.items])
        v = values.get(t.name)
        if t.fallback is None:
            return v if v is not None else Val("lit", F.lit(None).cast("string"))
        fallback = constant(t.fallback)
        if v is None:
            return fallback
        if same_kind(v, fallback):
            return v.at(F.coalesce(v.text, fallback.text)) if v.kind != "list" else Val("list", F.coalesce(v.text, fallback.text), item=v.item)
        if v.kind == "list" or fallback.kind == "list":
            raise ValueError(f"the default of ?{t.name} is of another kind than its values")
        return Val("dyn", F.coalesce(dyn(v).text, dyn(fallback).text))

    def pattern(self, p: Pattern, place: Place, values: dict[str, Val]) -> tuple[Column | None, list[Column]]:
        s, pr = self.term(p.subject, place, values), self.term(p.predicate, place, values)
        fixed = isinstance(p.object, ListPat) or isinstance(p.object, ConstPat) and isinstance(p.object.term, ListTerm)
        o = Val("iri", F.lit(NIL)) if fixed else self.term(p.object, place, values)
        if s.kind in ("lit", "list") or pr.kind in ("lit", "list", "bnode"):
            return None, []
        conditions = []
        for name in sorted(p.requires):
            v = values.get(name)
            if v is None:
                return None, []
            conditions.append(v.bound)
        if s.kind == "dyn":
            conditions.append(s.text["k"] != "lit")
        if pr.kind == "dyn":
            conditions.append(pr.text["k"] == "iri")
        subject, predicate = render(s), render(pr)
        if fixed:
            return None, [self.fixed_collection(subject, predicate, p.object, place, values, conditions)]
        if o.kind == "list":
            return None, [self.collection(subject, predicate, o, place, conditions)]
        obj = render(o)
        # rendered text is null where a value is missing; constants and fresh nodes never are
        for t, text in ((p.subject, subject), (p.predicate, predicate), (p.object, obj)):
            if isinstance(t, VarPat) and t.name not in p.requires or isinstance(t, ListPat):
                conditions.append(text.isNotNull())
        made = F.struct(subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"))
        if conditions:
            every = conditions[0]
            for c in conditions[1:]:
                every = every & c
            made = F.when(every, made)
        return made, []

    def fixed_collection(self, subject: Column, predicate: Column, pattern: TermPat, place: Place, values: dict[str, Val], conditions: list[Column]) -> Column:
        """A list written in the plan, of any nesting; made if all its variables have values."""
        struct = lambda a, b, c: F.struct(a.alias("subject"), b.alias("predicate"), c.alias("object"))
        links: list[Column] = []
        more: list[Column] = []

        def build(t: TermPat) -> Column:
            items = t.items if isinstance(t, ListPat) else tuple(ConstPat(x) for x in t.term.items)
            head = F.lit(f"<{NIL}>")
            for item in reversed(items):
                self.lists += 1
                node = F.concat(F.lit("_:"), self.label(f"l{self.lists}", place.path))
                if isinstance(item, ListPat) or isinstance(item, ConstPat) and isinstance(item.term, ListTerm):
                    links.append(struct(node, F.lit(f"<{FIRST}>"), build(item)))
                else:
                    v = self.term(item, place, values)
                    if isinstance(item, VarPat):
                        conditions.append(v.bound)
                    if v.kind == "list":
                        more.append(self.collection(node, F.lit(f"<{FIRST}>"), v, place, []))
                    else:
                        links.append(struct(node, F.lit(f"<{FIRST}>"), render(v)))
                links.append(struct(node, F.lit(f"<{REST}>"), head))
                head = node
            return head

        head = build(pattern)
        every = subject.isNotNull() & predicate.isNotNull()
        for c in conditions:
            every = every & c
        made = F.concat(F.array(struct(subject, predicate, head), *links), *more)
        return F.when(every, made).otherwise(F.array().cast(f"array<{TRIPLE}>"))

    def collection(self, subject: Column, predicate: Column, o: Val, place: Place, conditions: list[Column]) -> Column:
        """The triple and the rdf:first / rdf:rest chain; an empty list is rdf:nil."""
        self.lists += 1
        number = f"l{self.lists}"
        node = lambda i: F.concat(F.lit("_:"), self.label(number, place.path), F.lit("_"), i.cast("string"))
        items, nil = o.text, F.lit(f"<{NIL}>")
        every = items.isNotNull() & subject.isNotNull() & predicate.isNotNull()
        for c in conditions:
            every = every & c
        if o.native is not None:  # the collection was built from the cell, with any nesting
            first = F.struct(subject.alias("subject"), predicate.alias("predicate"), o.native["head"].alias("object"))
            return F.when(every, F.concat(F.array(first), o.native["links"])).otherwise(F.array().cast(f"array<{TRIPLE}>"))
        struct = lambda a, b, c: F.struct(a.alias("subject"), b.alias("predicate"), c.alias("object"))
        head = F.when(F.size(items) == 0, nil).otherwise(node(F.lit(0)))

        def chain(x: Column, i: Column) -> Column:
            rest = F.when(i == F.size(items) - 1, nil).otherwise(node(i + 1))
            links = [struct(node(i), F.lit(f"<{REST}>"), rest)]
            if o.item.kind == "list":
                inner = Val("list", x, item=o.item.item)
                around = [place.path, F.lit(".")] if place.path is not None else []
                deeper = place.inside(place.scope, F.concat(*around, F.lit(number), F.lit("."), i.cast("string")))
                return F.concat(self.collection(node(i), F.lit(f"<{FIRST}>"), inner, deeper, []), F.array(*links))
            links.insert(0, struct(node(i), F.lit(f"<{FIRST}>"), render(o.item.at(x) if o.item.kind != "dyn" else Val("dyn", x))))
            return F.array(*links)

        made = F.concat(F.array(struct(subject, predicate, head)), F.flatten(F.transform(items, chain)))
        return F.when(every, made).otherwise(F.array().cast(f"array<{TRIPLE}>"))

    def repeat(self, r: Repeat, place: Place, values: dict[str, Val]) -> Column | None:
        lists = [values.get(name) for name, _ in r.lists]
        if any(v is None for v in lists):
            return None
        arrays = [v if v.kind == "list" else Val("list", F.when(v.text.isNotNull(), F.array(v.text)), item=v) for v in lists]
        names = [element for _, element in r.lists]
        empty = F.array().cast(f"array<{TRIPLE}>")

        def element(v: Val, x: Column) -> Val:
            item = v.item
            return Val("list", x, item=item.item) if item.kind == "list" else Val("dyn", x) if item.kind == "dyn" else item.at(x)

        def body(found: dict[str, Val], at: Column) -> Column:
            around = [place.path, F.lit(".")] if place.path is not None else []
            made = self.triples(r.body, place.inside(r.id, F.concat(*around, F.lit(f"r{r.id}."), at)), values | found)
            return empty if made is None else made

        if r.mode == "cross":

            def level(k: int, found: dict[str, Val], at: Column | None) -> Column:
                def one(x: Column, i: Column) -> Column:
                    here = i.cast("string") if at is None else F.concat(at, F.lit("-"), i.cast("string"))
                    now = found | {names[k]: element(arrays[k], x)}
                    return body(now, here) if k == len(arrays) - 1 else level(k + 1, now, here)

                return F.flatten(F.transform(arrays[k].text, one))

            made = level(0, {}, None)
        else:
            sizes = [F.size(v.text) for v in arrays]
            bound = (F.least if r.mode == "zipMin" else F.greatest)(*sizes) if len(sizes) > 1 else sizes[0]
            positions = F.when(bound > 0, F.sequence(F.lit(0), bound - 1)).otherwise(F.array().cast("array<int>"))
            made = F.flatten(F.transform(positions, lambda i: body({n: element(v, F.get(v.text, i)) for n, v in zip(names, arrays, strict=True)}, i.cast("string"))))
        every = arrays[0].text.isNotNull()
        for v in arrays[1:]:
            every = every & v.text.isNotNull()
        return F.when(every, made).otherwise(empty)


def surely_distinct(block: Block, values: dict[str, Val]) -> bool:
    """Can no two triples of a row be equal?  Every two patterns differ in a term that is fixed or of another kind."""

    def sort(t: TermPat) -> tuple:
        """What is known of the term: ("term", it), ("node", its id) or ("kind", ...)."""
        if isinstance(t, ConstPat):
            return "term", t.term
        if isinstance(t, BNodePat):
            return "node", (t.id, t.scope)
        v = values.get(t.name) if isinstance(t, VarPat) else None
        if v is None or t.fallback is not None or v.kind not in ("iri", "lit"):
            return "any", None
        return "kind", ("iri",) if v.kind == "iri" else ("lit", v.datatype, v.lang if isinstance(v.lang, str) else "" if v.lang is None else None)

    def of(term) -> tuple | None:
        return ("iri",) if isinstance(term, IRI) else ("lit", term.datatype, term.lang or "") if isinstance(term, Literal) else None

    def differ(a: tuple, b: tuple) -> bool:
        if "any" in (a[0], b[0]):
            return False
        if a[0] == b[0]:
            if a[0] == "kind" and a[1][0] == b[1][0] == "lit" and None in (a[1][2], b[1][2]):
                return a[1][1] != b[1][1]
            return a[1] != b[1]
        if "node" in (a[0], b[0]):
            other = b if a[0] == "node" else a
            return other[0] == "kind" or of(other[1]) is not None
        kind, term = (a[1], of(b[1])) if a[0] == "kind" else (b[1], of(a[1]))
        return term is not None and (term[0] != kind[0] or kind[0] == "lit" and term[1] != kind[1])

    if block.repeats or any(isinstance(p.object, ListPat) or isinstance(p.object, ConstPat) and isinstance(p.object.term, ListTerm) for p in block.patterns):
        return False
    known = [tuple(sort(t) for t in (p.subject, p.predicate, p.object)) for p in block.patterns]
    if any(isinstance(p.object, VarPat) and (v := values.get(p.object.name)) is not None and v.kind == "list" for p in block.patterns):
        return False
    return all(any(differ(x, y) for x, y in zip(a, b, strict=True)) for i, a in enumerate(known) for b in known[:i])


def always(block: Block) -> list[Pattern]:
    """Patterns without variables: equal for every row."""
    return [p for p in block.patterns if not p.requires and all(isinstance(t, ConstPat) for t in (p.subject, p.predicate, p.object))]
