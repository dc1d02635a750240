"""Row queries: a CONSTRUCT evaluated once for each row, as column expressions.

The WHERE group is a list of steps in text order.  The row is visible on its left-most spine; any
other group is a constant relation (the dataset is empty), computed once, that each row joins with
as an array.  BIND is a projection, FILTER a filter after all steps, and a step with several solutions an
``explode``.  With ORDER BY, LIMIT, DISTINCT or OFFSET the solutions stay an array of the row, so the
modifiers hold per row without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import literals as L
from graphloom.functions.sparql import Context, QueryError, ebv, equal, local_name, static_text
from graphloom.operators.lift import record_label
from graphloom.plans.model import Block, BNodePat, ConstPat, Pattern, Plan, VarPat
from graphloom.plans.rdf import FIRST, INTEGER, NIL, REST, BNode, Prefixes, Var, parse_nt_term
from graphloom.plans.rdf import IRI as Iri
from graphloom.plans.typed import DYN, Val, constant, dyn, plain_text, render, same_kind, string

from .dataset import Dataset, parsed, sort_keys
from .syntax import Query, QueryParser, Select

PROPERTY_NAMESPACES = ("http://jena.apache.org/ARQ/property#", "http://jena.hpl.hp.com/ARQ/property#", "java:org.apache.jena.sparql.pfunction.library.")
PROPERTY_FUNCTIONS = {"strSplit", "concat", "splitIRI", "splitURI", "str", "assign"}
DEFAULT_PREFIXES = {"tarql": "http://tarql.github.io/tarql#"}


def property_function(predicate) -> str | None:
    if isinstance(predicate, Iri):
        for ns in PROPERTY_NAMESPACES:
            if predicate.value.startswith(ns):
                name = predicate.value[len(ns) :]
                if name not in PROPERTY_FUNCTIONS:
                    raise QueryError(f"property function {name} is not supported")
                return name
        if predicate.value.startswith("http://jena.apache.org/ARQ/list#") or predicate.value == "http://www.w3.org/2000/01/rdf-schema#member":
            raise QueryError(f"property function <{predicate.value}> is not supported")
    return None


def parse_row_query(text: str, name: str = "query") -> Plan:
    """A CONSTRUCT query as a plan; everything that is refused is refused here."""
    parser = QueryParser(text, prefixes=Prefixes(DEFAULT_PREFIXES))
    query = parser.parse()
    if query.form != "construct":
        raise QueryError("a row query is a CONSTRUCT")
    declared = re.findall(r"(?i)\bprefix\s+([\w.\-]*):", text)
    query.prefixes = Prefixes({k: v for k, v in query.prefixes.items() if k not in DEFAULT_PREFIXES or k in declared})
    if query.select.group or query.select.having:
        raise QueryError("a row query cannot be grouped: a row is one solution or several")
    root, nodes = Block(), {}

    def term(t):
        if isinstance(t, Var):
            return VarPat(t.name)
        if isinstance(t, BNode):
            return nodes.setdefault(t.label, BNodePat(len(nodes) + 1))
        return ConstPat(t)

    for s, p, o in query.template:
        root.patterns.append(Pattern(term(s), term(p), term(o)))
    plan = Plan(name, query.prefixes, root, query=query)
    staged(query.select.where)  # property functions are checked before any input
    return plan


def staged(elements: list) -> list:
    """Steps of the spine: property functions are taken out of the triples."""
    steps = []
    for k, e in enumerate(elements):
        if e[0] == "group" and k == 0:
            steps += staged(e[1])  # a group that starts the spine sees the row
        elif e[0] == "triples":
            steps += triples_steps(e[1])
        else:
            steps.append(e)
    return steps


def triples_steps(triples: list) -> list:
    lists = {s: {} for s, p, _ in triples if isinstance(p, Iri) and p.value in (FIRST, REST)}
    for s, p, o in triples:
        if isinstance(p, Iri) and p.value in (FIRST, REST):
            lists[s][p.value] = o
    used: set = set()

    def items(node) -> list:
        out = []
        while node != Iri(NIL):
            if node not in lists or len(lists[node]) != 2:
                raise QueryError("a property function takes a list of arguments")
            used.add(node)
            out.append(lists[node][FIRST])
            node = lists[node][REST]
        return out

    steps, plain = [], []
    for s, p, o in triples:
        name = property_function(p)
        if name is None:
            plain.append((s, p, o))
            continue
        args = items(o) if o in lists or o == Iri(NIL) else [o]
        if name in ("strSplit", "splitIRI", "splitURI") and len(args) != 2:
            raise QueryError(f"apf:{name} takes two arguments")
        if name in ("str", "assign") and len(args) != 1:
            raise QueryError(f"apf:{name} takes one argument")
        steps.append(("property", name, s, args))
    rest = [t for t in plain if not (t[0] in used and isinstance(t[1], Iri) and t[1].value in (FIRST, REST))]
    return ([("triples", rest)] if rest else []) + steps


def mentioned(query: Query) -> set[str]:
    """Variables that the query's text names."""
    return set(query.variables)


def spine_binds(elements: list) -> set[str]:
    out = set()
    for e in elements:
        if e[0] == "bind":
            out.add(e[2])
        elif e[0] == "group" and e is elements[0]:
            out |= spine_binds(e[1])
    return out


class RowQuery:
    """Applies the steps to a DataFrame whose variables are columns, or to arrays of solutions."""

    def __init__(self, spark: SparkSession, plan: Plan, record: Column):
        self.spark, self.plan, self.query = spark, plan, plan.query
        self.record = record
        self.sites = 0
        self.now = Context({}, Prefixes()).now

    def label(self, solution: Column | None):
        """Labels of BNODE(): by record, call site, and solution where a row has several."""

        def make(site: str) -> Column:
            if site != "s":
                self.sites += 1
                site = str(self.sites)
            tail = [F.lit("_"), solution] if solution is not None and site != "s" else []
            head = F.lit("s") if site == "s" else F.lit("v")
            return F.concat(head, self.record, F.lit(f"x{site}"), *tail)

        return make

    def context(self, values: dict[str, Val], solution: Column | None) -> Context:
        return Context(values, self.plan.prefixes, self.query.base, self.label(solution), self.exists, self.now)

    def relation(self, elements: list) -> tuple[list[dict], list[str]]:
        """A group that does not see the row, as solutions of N-Triples text."""
        df, _ = Dataset(self.spark, None, self.plan.prefixes, self.query.base, self.now).group(elements)
        names = df.columns
        return ([r.asDict() for r in df.collect()] if names else [{} for _ in range(df.count())]), names

    def exists(self, elements: list, ctx: Context) -> Column:
        rows, names = self.relation(elements)
        out = F.lit(False)
        for row in rows:
            out = out | self.fits(row, names, ctx.values)
        return out

    def fits(self, row: dict, names: list[str], values: dict[str, Val]) -> Column:
        """Is a constant solution compatible with the row's?"""
        cond = F.lit(True)
        for n in names:
            if row[n] is not None and n in values:
                text = render(values[n])
                cond = cond & (text.isNull() | (text == F.lit(row[n])))
        return cond

    def candidates(self, rows: list[dict], names: list[str], values: dict[str, Val], conditions=(), solution=None) -> tuple[Column, list[str]]:
        """Array of the constant solutions that fit the row (and the conditions); structs of N-Triples text."""
        fields = [n for n in names]
        kind = "array<struct<" + ",".join(f"`{n}`:string" for n in fields) + ">>" if fields else "array<struct<_none:string>>"
        structs = []
        for row in rows:
            s = F.struct(*[F.lit(row[n]).cast("string").alias(n) for n in fields]) if fields else F.struct(F.lit(None).cast("string").alias("_none"))
            cond = self.fits(row, names, values)
            if conditions:
                here = dict(values)
                for n in names:
                    if row[n] is not None:
                        here[n] = constant(parse_nt_term(row[n])[0])
                for c in conditions:
                    cond = cond & F.coalesce(ebv(self.context(here, solution).compile(c)), F.lit(False))
            structs.append(F.when(cond, s))
        return (F.array_compact(F.array(*structs)) if structs else F.array()).cast(kind), fields

    def generator(self, step, values: dict[str, Val], solution: Column | None):
        """(array of structs, {variable: value from a struct}, keep rows without any, condition) for a step with several solutions."""
        kind = step[0]
        if kind in ("values", "union", "group", "triples", "select", "graph", "service"):
            rows, names = self.relation([step])
            array, fields = self.candidates(rows, names, values, (), solution)
            return array, fields, rows, False
        if kind == "optional":
            own = [x for x in step[1] if x[0] != "filter"]
            rows, names = self.relation(own)
            array, fields = self.candidates(rows, names, values, [x[1] for x in step[1] if x[0] == "filter"], solution)
            return array, fields, rows, True
        return None

    def bound_from(self, name: str, x: Column, rows: list[dict], values: dict[str, Val]) -> Val:
        """The variable's value after a constant solution x was joined."""
        terms = [constant(parse_nt_term(r[name])[0]) for r in rows if r[name] is not None]
        text = x[name]
        if terms and all(same_kind(terms[0], t) for t in terms[1:]) and terms[0].kind in ("iri", "lit") and not isinstance(terms[0].lang, Column):
            fresh = terms[0].at(parsed(text).text["v"])
        else:
            fresh = parsed(text)
        old = values.get(name)
        if old is None:
            return fresh
        if same_kind(old, fresh) and old.kind != "dyn":
            return old.at(F.coalesce(old.text, fresh.text))
        return Val("dyn", F.coalesce(dyn(old).text, dyn(fresh).text))

    def argument(self, t, values: dict[str, Val]) -> Val | None:
        if isinstance(t, Var):
            return values.get(t.name)
        return constant(t)

    def property_step(self, step, values: dict[str, Val]):
        """(array of results or None, {variable: value given the element}, condition given the element)."""
        _, name, subject, args = step
        if name == "strSplit":
            text, pattern = self.argument(args[0], values), self.argument(args[1], values)
            if text is None or pattern is None:
                return F.array().cast("array<string>"), {}, lambda x: F.lit(False)
            parts = java_split(literal_text(text), pattern)
            return parts, *self.bind_or_test(subject, lambda x: string(x), values)
        if name == "concat":
            texts = [self.argument(a, values) for a in args]
            whole = F.concat(*[F.lit(None).cast("string") if v is None else plain_text(v) for v in texts]) if texts else F.lit("")
            return F.array_compact(F.array(whole)), *self.bind_or_test(subject, lambda x: string(x), values)
        if name in ("splitIRI", "splitURI"):
            source = self.argument(subject, values)
            text = plain_text(source) if source is not None else F.lit(None).cast("string")
            local = local_name(text)
            both = F.struct(text.substr(F.lit(1), F.length(text) - F.length(local)).alias("ns"), local.alias("ln"))
            array = F.when(text.isNotNull(), F.array(both)).otherwise(F.array().cast("array<struct<ns:string,ln:string>>"))
            one, test_one = self.bind_or_test(args[0], lambda x: Val("iri", x["ns"]), values, text_only=True)
            two, test_two = self.bind_or_test(args[1], lambda x: string(x["ln"]), values, text_only=True)
            return array, one | two, lambda x: test_one(x) & test_two(x)
        source = self.argument(args[0], values)
        if name == "str":
            if source is None:
                raise QueryError("apf:str needs a bound argument")
            return F.array_compact(F.array(plain_text(source))), *self.bind_or_test(subject, lambda x: string(x), values)
        left, right = self.argument(subject, values), source
        if left is None and right is None:
            raise QueryError("apf:assign needs a bound side")
        if left is None or right is None:
            target, known = (subject, right) if left is None else (args[0], left)
            return F.array_compact(F.array(known.text)), *self.bind_or_test(target, lambda x: known.at(x) if known.kind != "dyn" else Val("dyn", x), values)
        same = F.coalesce(equal(left, right), render(left) == render(right))
        return F.array_compact(F.array(F.when(same, F.lit("")))), {}, lambda x: F.lit(True)

    def bind_or_test(self, target, make, values: dict[str, Val], text_only: bool = False):
        """A free variable is bound to the element; a bound one, or a constant, is compared with it."""
        old = self.argument(target, values)
        if old is None:
            return {target.name: make}, lambda x: F.lit(True)

        def test(x):
            new = make(x)
            hit = plain_text(old) == plain_text(new) if text_only else render(old) == render(new)
            return old.text.isNull() | hit if isinstance(target, Var) else hit

        return {}, test


def literal_text(v: Val) -> Column:
    if v.kind == "dyn":
        return F.when(v.text["k"] == "lit", v.text["v"])
    return v.text if v.kind == "lit" else F.lit(None).cast("string")


def java_split(text: Column, pattern: Val) -> Column:
    """Parts as Java's String.split gives them, each trimmed; no empty parts at the end."""
    fixed = static_text(pattern)
    parts = F.split(text, fixed if fixed is not None else literal_text(pattern), -1)
    # the last part that is not empty ends the list; an empty input is one empty part
    size = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(0), lambda s, i: F.when(F.element_at(parts, i) != "", i).otherwise(s))
    kept = F.when(text == "", parts).when(size > 0, F.slice(parts, 1, size)).otherwise(F.array().cast("array<string>"))
    return F.transform(kept, lambda x: F.regexp_replace(x, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""))


def bind_columns(df: DataFrame, plan: Plan, bind_empty: bool, row_number: str | None) -> dict[str, Val]:
    """The row's variables: columns that the query mentions and does not BIND itself, as plain strings."""
    query, out = plan.query, {}
    taken = spine_binds(query.select.where)
    for name in mentioned(query) - taken:
        if name in df.columns:
            kind = df.schema[name].dataType
            if isinstance(kind, T.ArrayType):
                raise ValueError(f"column {name!r} holds lists, which a row query cannot read")
            col = F.col(f"`{name}`")
            out[name] = string(col if bind_empty and isinstance(kind, T.StringType) else L.cell_text(col, kind))
    if "ROWNUM" in mentioned(query) and "ROWNUM" not in df.columns and "ROWNUM" not in taken:
        if row_number is None:
            raise ValueError("the query uses ?ROWNUM: number the rows first")
        out["ROWNUM"] = Val("lit", F.col(f"`{row_number}`").cast("string"), INTEGER, safe=True)
    return out


def lift_query(df: DataFrame, plan: Plan, bind_empty: bool = False, row_id: str | None = None, row_number: str | None = None) -> tuple[DataFrame, dict[str, Val]]:
    """(one row per solution with a column for each variable and _record, the variables)."""
    query: Query = plan.query
    if row_number is None and "ROWNUM" in mentioned(query) and "ROWNUM" not in df.columns:
        from graphloom.sources.rows import number_rows

        df, row_number = number_rows(df, "_rownum"), "_rownum"
    steps = staged(query.select.where)
    several = any(s[0] not in ("bind", "filter", "minus", "exists") for s in steps)
    values = bind_columns(df, plan, bind_empty, row_number)
    names = list(values)
    rows = df.select(record_label(df, row_id).alias("_record"), *[values[n].text.alias(f"_c{i}") for i, n in enumerate(names)])
    values = {n: Val(values[n].kind, F.col(f"_c{i}"), values[n].datatype, safe=values[n].safe) for i, n in enumerate(names)}
    runner = RowQuery(df.sparkSession, plan, F.col("_record"))
    s: Select = query.select
    if s.distinct or s.order or s.limit is not None or s.offset:
        rows, values = solutions_in_row(rows, values, steps, s, runner)
    else:
        rows, values = solutions_as_rows(rows, values, steps, runner)
    if several and uses_bnodes(plan.root):
        rows = rows.withColumn("_record", F.concat(F.col("_record"), F.lit("_"), F.col("_solution")))
    return rows, values


def uses_bnodes(block: Block) -> bool:
    return any(isinstance(t, BNodePat) for p in block.all_patterns() for t in (p.subject, p.predicate, p.object))


def solutions_as_rows(rows: DataFrame, values: dict[str, Val], steps: list, runner: RowQuery) -> tuple[DataFrame, dict[str, Val]]:
    fresh = iter(range(10**6))
    generated = False
    rows = rows.withColumn("_solution", F.lit(""))
    filters = []

    def keep(name: str, v: Val) -> None:
        nonlocal rows
        column = f"_s{next(fresh)}"
        if isinstance(v.lang, Column):
            v = dyn(v)
        rows = rows.withColumn(column, v.text)
        values[name] = Val(v.kind, F.col(column), v.datatype, v.lang, v.item, safe=v.safe)

    for step in steps:
        solution = F.col("_solution") if generated else None
        kind = step[0]
        if kind == "filter":
            filters.append(step[1])
        elif kind == "bind":
            keep(step[2], runner.context(values, solution).compile(step[1]))
        elif kind == "minus":
            constants, names = runner.relation(step[1])
            bad = F.lit(False)
            for r in constants:
                meets = F.lit(False)
                for n in names:
                    if r[n] is not None and n in values:
                        meets = meets | values[n].bound
                bad = bad | (runner.fits(r, names, values) & meets)
            rows = rows.filter(~F.coalesce(bad, F.lit(False)))
        elif kind == "property":
            array, binds, test = runner.property_step(step, values)
            at, x = f"_i{next(fresh)}", f"_x{next(fresh)}"
            rows = rows.select("*", F.posexplode(array).alias(at, x)).filter(test(F.col(x)))
            rows = rows.withColumn("_solution", F.concat("_solution", F.lit("."), F.col(at)))
            generated = True
            for name, make in binds.items():
                keep(name, make(F.col(x)))
        else:
            array, fields, constants, outer = runner.generator(step, values, solution)
            at, x = f"_i{next(fresh)}", f"_x{next(fresh)}"
            rows = rows.select("*", (F.posexplode_outer if outer else F.posexplode)(array).alias(at, x))
            rows = rows.withColumn("_solution", F.concat("_solution", F.lit("."), F.coalesce(F.col(at), F.lit(-1))))
            generated = True
            before = dict(values)
            for name in fields:
                keep(name, runner.bound_from(name, F.col(x), constants, before))
    for f in filters:
        rows = rows.filter(ebv(runner.context(values, F.col("_solution") if generated else None).compile(f)))
    return rows, values


def solutions_in_row(rows: DataFrame, values: dict[str, Val], steps: list, s: Select, runner: RowQuery) -> tuple[DataFrame, dict[str, Val]]:
    """All solutions of a row in one array of structs, for modifiers that hold per row."""
    outer = dict(values)
    shape: dict[str, Val] = {}  # variables of the array's structs; text is replaced by the field
    array = F.array(F.struct(F.lit("").alias("_solution")))
    filters = [x[1] for x in steps if x[0] == "filter"]

    def view(x: Column) -> dict[str, Val]:
        return outer | {n: Val(v.kind, x[n], v.datatype, v.lang, v.item, safe=v.safe) for n, v in shape.items()}

    def extended(x: Column, fresh: dict[str, Val], at: Column | None) -> Column:
        tag = x["_solution"] if at is None else F.concat(x["_solution"], F.lit("."), at.cast("string"))
        kept = [x[n].alias(n) for n in shape if n not in fresh]
        return F.struct(tag.alias("_solution"), *kept, *[v.text.alias(n) for n, v in fresh.items()])

    def bound(step):
        sample: dict[str, Val] = {}

        def one(x: Column) -> Column:
            v = runner.context(view(x), x["_solution"]).compile(step[1])
            sample[step[2]] = dyn(v) if isinstance(v.lang, Column) else v
            return extended(x, sample, None)

        return F.transform(array, one), sample

    def computed(step):
        made: dict[str, Val] = {}

        def many(x: Column) -> Column:
            found, binds, test = runner.property_step(step, view(x))

            def element(y: Column, i: Column) -> Column:
                fresh = {n: make(y) for n, make in binds.items()}
                made.update(fresh)
                return F.when(test(y), extended(x, fresh, i))

            return F.array_compact(F.transform(found, element))

        return F.flatten(F.transform(array, many)), made

    def joined(step):
        made: dict[str, Val] = {}

        def many(x: Column) -> Column:
            before = view(x)
            found, fields, constants, left = runner.generator(step, before, x["_solution"])

            def element(y: Column, i: Column) -> Column:
                fresh = {n: runner.bound_from(n, y, constants, before) for n in fields}
                made.update(fresh)
                return extended(x, fresh, i)

            out = F.transform(found, element)
            if not left:
                return out
            empty = {}
            for n, v in made.items():
                old = before.get(n)
                if old is None:
                    empty[n] = Val(v.kind, F.lit(None).cast(DYN if v.kind == "dyn" else "string"), v.datatype, v.lang)
                else:
                    empty[n] = dyn(old) if v.kind == "dyn" else old
            return F.when(F.size(out) > 0, out).otherwise(F.array(extended(x, empty, F.lit(-1))))

        return F.flatten(F.transform(array, many)), made

    def kept(condition):
        return F.filter(array, lambda x: F.coalesce(ebv(runner.context(view(x), x["_solution"]).compile(condition)), F.lit(False)))

    for step in steps:
        kind = step[0]
        if kind == "filter":
            continue
        if kind == "minus":
            raise QueryError("MINUS cannot stand with modifiers")
        array, fresh = (bound if kind == "bind" else computed if kind == "property" else joined)(step)
        shape.update(fresh)
    for f in filters:
        array = kept(f)
    rows = rows.withColumn("_all", array)
    array = F.col("_all")
    if s.order:

        def keyed(x, i):
            keys = []
            for up, e in s.order:
                parts = sort_keys(dyn(runner.context(view(x), x["_solution"]).compile(e)))
                keys.append((up, parts))
            return F.struct(x.alias("x"), i.alias("i"), *[F.struct(*[c.alias(f"p{j}") for j, c in enumerate(parts)]).alias(f"k{n}") for n, (_, parts) in enumerate(keys)])

        def compared(a, b):
            out = None
            for n, (up, _) in reversed(list(enumerate(s.order))):
                low, high = (-1, 1) if up else (1, -1)
                here = F.when(a[f"k{n}"] < b[f"k{n}"], F.lit(low)).when(a[f"k{n}"] > b[f"k{n}"], F.lit(high))
                out = here.otherwise(out if out is not None else F.when(a["i"] < b["i"], F.lit(-1)).otherwise(F.lit(1)))
            return out

        array = F.transform(F.array_sort(F.transform(array, keyed), compared), lambda x: x["x"])
    if s.distinct:
        names = sorted(shape)
        array = F.array_distinct(F.transform(array, lambda x: F.struct(F.lit("").alias("_solution"), *[x[n].alias(n) for n in names])))
    if s.offset or s.limit is not None:
        array = F.slice(array, s.offset + 1, s.limit if s.limit is not None else 2**31 - 1 - s.offset)
    own = [c for c in rows.columns if c != "_all"]
    rows = rows.select(*own, F.explode(array).alias("_x"))
    rows = rows.select(*own, F.col("_x._solution").alias("_solution"), *[F.col("_x").getField(n).alias(f"_y{i}") for i, n in enumerate(shape)])
    return rows, outer | {n: Val(v.kind, F.col(f"_y{i}"), v.datatype, v.lang, v.item, safe=v.safe) for i, (n, v) in enumerate(shape.items())}


def annotated_query(library_prefixes: Prefixes, parts: dict[str, list], name: str) -> Query:
    """The row query that a template's annotations spell: prefixes, BINDs, a WHERE body and modifiers."""
    prefixes = "".join(f"PREFIX {p}: <{ns}>\n" for p, ns in parts.get("Prefix", []))
    base = "".join(f"BASE <{b[0]}>\n" for b in parts.get("Base", []))
    binds = "".join(f"  BIND({e} AS ?{v})\n" for v, e in parts.get("Bind", []))
    where = "".join(f"  {w[0]}\n" for w in parts.get("Where", []))
    modifiers = " ".join(m[0] for m in parts.get("Modifiers", []))
    text = f"{base}{prefixes}CONSTRUCT {{ }} WHERE {{\n{where}{binds}}} {modifiers}"
    plan = parse_row_query(text, name)
    plan.query.prefixes = Prefixes(library_prefixes | plan.query.prefixes)
    return plan.query
