"""Groups and SELECT queries over a DataFrame of triples.

A solution is a row with one N-Triples text column per variable (null: unbound).  Basic graph patterns are joins of
the triples with themselves, which Catalyst orders and AQE picks strategies for.  With no triples the
same evaluator gives the constant relations that row queries join with.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.sparql import Context, QueryError, ebv, number
from graphloom.plans.rdf import DECIMAL, DOUBLE, INTEGER, LANG_STRING, NUMERIC, STRING, BNode, Prefixes, Var, nt
from graphloom.plans.typed import DYN, Val, dyn, render

from .syntax import Query, Select

TERM = r'^(?:<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)$'


def unescaped(text: Column) -> Column:
    marker = "\u0001"
    out = F.replace(text, F.lit("\\\\"), F.lit(marker))
    for code, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit(marker), F.lit("\\"))


def parsed(text: Column) -> Val:
    """A term's N-Triples text as a dyn value."""
    part = lambda i: F.regexp_extract(text, TERM, i)
    null = F.lit(None).cast("string")
    lang = F.when(part(4) != "", part(4))
    s = (
        F.when(text.startswith("<"), F.struct(F.lit("iri").alias("k"), part(1).alias("v"), null.alias("dt"), null.alias("lang")))
        .when(text.startswith("_:"), F.struct(F.lit("bnode").alias("k"), part(2).alias("v"), null.alias("dt"), null.alias("lang")))
        .when(
            text.startswith('"'),
            F.struct(
                F.lit("lit").alias("k"),
                unescaped(part(3)).alias("v"),
                F.when(lang.isNotNull(), F.lit(LANG_STRING)).when(part(5) != "", part(5)).otherwise(F.lit(STRING)).alias("dt"),
                lang.alias("lang"),
            ),
        )
    )
    return Val("dyn", s.cast(DYN))


class Dataset:
    """Evaluates groups; ``triples`` has columns subject, predicate, object, or is None for no triples at all."""

    def __init__(self, spark: SparkSession, triples: DataFrame | None, prefixes: Prefixes, base: str = "", now: str | None = None):
        self.spark, self.triples, self.prefixes, self.base, self.now = spark, triples, prefixes, base, now
        self.numbers = iter(range(10**9))

    def unit(self) -> DataFrame:
        return self.spark.range(1).select()

    def nothing(self, names=()) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names) if names else "_none string").select(*[f"`{n}`" for n in names])

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def context(self, df: DataFrame, exists=None) -> Context:
        values = {n: parsed(self.column(n)) for n in df.columns}
        return Context(values, self.prefixes, self.base, lambda site: F.concat(F.lit(f"c{site}"), F.monotonically_increasing_id().cast("string")), exists, self.now)

    # ---- groups

    def group(self, elements: list) -> tuple[DataFrame, set[str]]:
        """(solutions, variables bound in every solution)."""
        df, certain = self.unit(), set()
        filters = [e[1] for e in elements if e[0] == "filter"]
        for e in elements:
            kind = e[0]
            if kind == "filter":
                continue
            if kind == "bind":
                if e[2] in df.columns:
                    raise QueryError(f"?{e[2]} is bound before its BIND")
                df = df.withColumn(e[2], render(self.compiled(df, certain, e[1])))
            elif kind == "minus":
                df = self.minus(df, certain, *self.group(e[1]))
            elif kind == "optional":
                own = [x for x in e[1] if x[0] != "filter"]
                conditions = [x[1] for x in e[1] if x[0] == "filter"]
                df = self.join(df, certain, *self.group(own), left_join=True, conditions=conditions)
            else:
                right, sure = self.element(e)
                df = self.join(df, certain, right, sure)
                certain = certain | sure
        for f in filters:
            df = self.filtered(df, certain, f)
        return df, certain

    def compiled(self, df: DataFrame, certain: set[str], e) -> Val:
        return self.context(df).compile(e)

    def element(self, e) -> tuple[DataFrame, set[str]]:
        kind = e[0]
        if kind == "triples":
            return self.basic(e[1])
        if kind == "group":
            return self.group(e[1])
        if kind == "union":
            parts = [self.group(arm) for arm in e[1]]
            df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[0] for p in parts])
            return df, set.intersection(*[p[1] for p in parts])
        if kind == "values":
            names, rows = e[1], e[2]
            data = [tuple(None if t is None else nt(t) for t in row) for row in rows]
            df = self.spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names)) if rows else self.nothing(names)
            return df, {n for i, n in enumerate(names) if all(r[i] is not None for r in rows)}
        if kind == "select":
            return self.select(e[1])
        if kind == "graph":
            return self.nothing(), set()
        raise QueryError(f"{kind.upper()} is not supported")

    def basic(self, triples: list) -> tuple[DataFrame, set[str]]:
        df, certain = self.unit(), set()
        for s, p, o in triples:
            s, o = (Var(f" {t.label}") if isinstance(t, BNode) else t for t in (s, o))
            right, sure = self.pattern(s, p, o)
            df = self.join(df, certain, right, sure)
            certain |= sure
        hidden = [n for n in df.columns if n.startswith(" ")]
        return df.drop(*hidden) if hidden else df, {n for n in certain if not n.startswith(" ")}

    def pattern(self, s, p, o) -> tuple[DataFrame, set[str]]:
        if isinstance(p, tuple):
            return self.path(s, p, o)
        names = list(dict.fromkeys(t.name for t in (s, p, o) if isinstance(t, Var)))
        if self.triples is None:
            return self.nothing(names), set(names)
        df, seen, columns = self.triples, {}, []
        for t, c in ((s, "subject"), (p, "predicate"), (o, "object")):
            if not isinstance(t, Var):
                df = df.filter(F.col(c) == nt(t))
            elif t.name in seen:
                df = df.filter(F.col(c) == F.col(seen[t.name]))
            else:
                seen[t.name] = c
                columns.append(F.col(c).alias(t.name))
        return df.select(*columns), set(names)

    def path(self, s, p, o) -> tuple[DataFrame, set[str]]:
        kind = p[0]
        if kind == "inverse":
            return self.pattern(o, p[1], s)
        if kind == "alt":
            parts = [self.pattern(s, x, o) for x in p[1]]
            return functools.reduce(lambda a, b: a.unionByName(b), [x[0] for x in parts]), parts[0][1]
        if kind == "seq":
            places = [s, *(Var(f" path{next(self.numbers)}") for _ in p[1][1:]), o]
            df, certain = self.unit(), set()
            for a, step, b in zip(places, p[1], places[1:], strict=False):
                right, sure = self.pattern(a, step, b)
                df = self.join(df, certain, right, sure)
                certain |= sure
            return df.drop(*[v.name for v in places[1:-1]]), certain - {v.name for v in places[1:-1]}
        if p[1] == "?" or self.triples is None:
            raise QueryError("this property path is not supported")
        return self.closure(s, p, o)

    def closure(self, s, p, o) -> tuple[DataFrame, set[str]]:
        """+ and *: pairs reached, by repeated joins until no new pair appears."""
        x, y = Var(" from"), Var(" to")
        step, _ = self.pattern(x, p[2], y)
        step = step.select(F.col("` from`").alias("a"), F.col("` to`").alias("b")).distinct()
        found = step
        while True:
            more = found.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").select("a", "b").subtract(found)
            if more.isEmpty():
                break
            found = found.union(more).distinct()
        if p[1] == "*":
            nodes = self.triples.select(F.col("subject").alias("a")).union(self.triples.select("object")).distinct()
            found = found.union(nodes.select("a", F.col("a").alias("b"))).distinct()
        for t, c in ((s, "a"), (o, "b")):
            if not isinstance(t, Var):
                found = found.filter(F.col(c) == nt(t))
        names = [(c, t.name) for t, c in ((s, "a"), (o, "b")) if isinstance(t, Var)]
        if len(names) == 2 and names[0][1] == names[1][1]:
            found, names = found.filter("a = b"), names[:1]
        return found.select(*[F.col(c).alias(n) for c, n in names]), {n for _, n in names}

    def join(self, left: DataFrame, sure_left: set[str], right: DataFrame, sure_right: set[str], left_join: bool = False, conditions=()) -> DataFrame:
        shared = [n for n in left.columns if n in right.columns]
        if left_join and conditions:
            return self.left_join(left, right, shared, conditions)
        other = right.select(*[self.column(n).alias(f"{n} r" if n in shared else n) for n in right.columns])
        tests = []
        for n in shared:
            a, b = self.column(n), self.column(f"{n} r")
            tests.append(a == b if n in sure_left and n in sure_right else a.isNull() | b.isNull() | (a == b))
        cond = functools.reduce(operator.and_, tests) if tests else F.lit(True)
        out = left.join(other, cond, "left" if left_join else "inner")
        return self.merged(out, left.columns, right.columns, shared)

    def merged(self, df: DataFrame, left: list, right: list, shared: list) -> DataFrame:
        columns = [F.coalesce(self.column(n), self.column(f"{n} r")).alias(n) if n in shared else self.column(n) for n in left]
        return df.select(*columns, *[self.column(n) for n in right if n not in shared])

    def left_join(self, left: DataFrame, right: DataFrame, shared: list, conditions) -> DataFrame:
        """OPTIONAL with filters: the filters see both sides."""
        key = f" row{next(self.numbers)}"
        numbered = left.withColumn(key, F.monotonically_increasing_id())
        both = self.join(numbered, set(), right, set())
        for c in conditions:
            both = self.filtered(both, set(), c)
        rest = numbered.join(both.select(self.column(key)).distinct(), key, "left_anti")
        return both.unionByName(rest, allowMissingColumns=True).drop(key)

    def minus(self, left: DataFrame, sure: set[str], right: DataFrame, sure_right: set[str]) -> DataFrame:
        shared = [n for n in left.columns if n in right.columns]
        if not shared:
            return left
        other = right.select(*[self.column(n).alias(f"{n} r") for n in shared])
        fits = functools.reduce(operator.and_, [self.column(n).isNull() | self.column(f"{n} r").isNull() | (self.column(n) == self.column(f"{n} r")) for n in shared])
        meets = functools.reduce(operator.or_, [F.coalesce(self.column(n) == self.column(f"{n} r"), F.lit(False)) for n in shared])
        return left.join(other, fits & meets, "left_anti")

    def filtered(self, df: DataFrame, certain: set[str], e) -> DataFrame:
        negated = e[0] == "call" and e[1] == "!" and e[2][0][0] == "exists"
        if e[0] == "exists" or negated:
            inner, sure = self.group(e[2][0][1] if negated else e[1])
            shared = [n for n in df.columns if n in inner.columns]
            other = inner.select(*[self.column(n).alias(f"{n} r") for n in shared]) if shared else inner
            tests = [self.column(n).isNull() | self.column(f"{n} r").isNull() | (self.column(n) == self.column(f"{n} r")) for n in shared]
            cond = functools.reduce(operator.and_, tests) if tests else F.lit(True)
            return df.join(other, cond, "left_anti" if negated else "left_semi")
        if e[0] == "call" and e[1] == "&&":
            return self.filtered(self.filtered(df, certain, e[2][0]), certain, e[2][1])
        return df.filter(ebv(self.context(df).compile(e)))

    # ---- SELECT

    def select(self, s: Select) -> tuple[DataFrame, set[str]]:
        df, certain = self.group(s.where)
        if s.values:
            right, sure = self.element(("values", *s.values))
            df = self.join(df, certain, right, sure)
        aggregates: list = []

        def lifted(e):
            if e[0] == "aggregate":
                aggregates.append(e)
                return ("var", f" agg{len(aggregates) - 1}")
            return ("call", e[1], [lifted(x) for x in e[2]]) if e[0] == "call" else e

        items = [(lifted(e) if e is not None else None, n) for e, n in s.items]
        having = [lifted(h) for h in s.having]
        ordering = [(up, lifted(e)) for up, e in s.order]
        if s.group or aggregates:
            keys = []
            for i, (e, name) in enumerate(s.group):
                name = name or (e[1] if e[0] == "var" else f" key{i}")
                if e[0] != "var" or e[1] != name:
                    df = df.withColumn(name, render(self.context(df).compile(e)))
                elif name not in df.columns:
                    df = df.withColumn(name, F.lit(None).cast("string"))
                keys.append(name)
            made = [self.aggregate(df, a).alias(f" agg{i}") for i, a in enumerate(aggregates)]
            df = df.groupBy(*[self.column(k) for k in keys]).agg(*made) if made else df.select(*[self.column(k) for k in keys]).distinct()
            for h in having:
                df = df.filter(ebv(self.context(df).compile(h)))
            certain = certain & set(keys)
        for e, n in items:
            if e is not None:
                df = df.withColumn(n, render(self.context(df).compile(e)))
        if ordering:
            columns = []
            for up, e in ordering:
                columns += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in sort_keys(dyn(self.context(df).compile(e)))]
            df = df.orderBy(*columns)
        names = [n for _, n in items] or [n for n in df.columns if not n.startswith(" ")]
        df = df.select(*[self.column(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])
        if s.distinct:
            df = df.distinct()
        if s.offset:
            df = df.offset(s.offset)
        if s.limit is not None:
            df = df.limit(s.limit)
        return df, certain & set(names)

    def aggregate(self, df: DataFrame, a) -> Column:
        _, name, distinct, e, separator = a
        if e is None:
            n = F.count_distinct(*[F.coalesce(self.column(c), F.lit("")) for c in df.columns]) if distinct and df.columns else F.count(F.lit(1))
            return render(Val("lit", n.cast("string"), INTEGER, safe=True))
        v = self.context(df).compile(e)
        text = render(v)
        if name == "count":
            n = F.count_distinct(text) if distinct else F.count(text)
            return render(Val("lit", n.cast("string"), INTEGER, safe=True))
        if name == "sample":
            return F.first(text, ignorenulls=True)
        if name == "group_concat":
            plain = dyn(v).text["v"]
            rows = F.array_distinct(F.collect_list(plain)) if distinct else F.collect_list(plain)
            return render(Val("lit", F.array_join(rows, separator)))
        if name in ("min", "max"):
            d = dyn(v)
            best = (F.min if name == "min" else F.max)(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_keys(d))], text.alias("t")))
            return best["t"]
        d, x = dyn(v), number(dyn(v))[0]
        if distinct:
            raise QueryError("SUM and AVG of distinct values are not supported")
        total, n = F.sum(F.when(d.text["dt"].isin(INTEGER, DECIMAL), d.text["v"].try_cast("decimal(38,9)"))), F.count(text)
        wide, whole = F.sum(x), F.min((d.text["dt"] == INTEGER).cast("int")) == 1
        exact = F.min(d.text["dt"].isin(INTEGER, DECIMAL).cast("int")) == 1
        all_numbers = F.min(F.coalesce(d.text["dt"].isin(*sorted(NUMERIC)), F.lit(False)).cast("int")) == 1
        from graphloom.functions.literals import double_text, strip_zeros

        if name == "sum":
            fixed = strip_zeros(total.cast("string"))
            return (
                F.when(F.count(F.lit(1)) == 0, F.lit(f'"0"^^<{INTEGER}>'))
                .when(~all_numbers, F.lit(None).cast("string"))
                .when(whole, F.concat(F.lit('"'), fixed, F.lit(f'"^^<{INTEGER}>')))
                .when(exact, F.concat(F.lit('"'), fixed, F.lit(f'"^^<{DECIMAL}>')))
                .otherwise(F.concat(F.lit('"'), double_text(wide), F.lit(f'"^^<{DOUBLE}>')))
            )
        mean = (total / n).try_cast("decimal(38,18)")
        return (
            F.when(n == 0, F.lit(f'"0"^^<{INTEGER}>'))
            .when(~all_numbers, F.lit(None).cast("string"))
            .when(exact, F.concat(F.lit('"'), strip_zeros(mean.cast("string")), F.lit(f'"^^<{DECIMAL}>')))
            .otherwise(F.concat(F.lit('"'), double_text(wide / n), F.lit(f'"^^<{DOUBLE}>')))
        )


def sort_keys(d: Val) -> list[Column]:
    """Columns in SPARQL's order: unbound, blank nodes, IRIs, literals; numbers by value."""
    s = d.text
    rank = F.when(s["k"] == "bnode", 1).when(s["k"] == "iri", 2).when(s["k"] == "lit", 3)
    value = F.when(s["dt"].isin(*sorted(NUMERIC)), s["v"].try_cast("double"))
    return [rank, value, s["v"], s["dt"], s["lang"]]


def select_query(spark: SparkSession, query: Query, triples: DataFrame | None) -> DataFrame:
    """A SELECT's solutions as N-Triples text columns."""
    df, _ = Dataset(spark, triples, query.prefixes, query.base).select(query.select)
    return df


