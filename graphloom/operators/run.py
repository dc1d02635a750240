"""Running a plan over a DataFrame: scan, lift, shape and explode in one narrow stage."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.model import Block, ConstPat, Plan, Repeat
from graphloom.plans.rdf import TYPE

from .lift import lift_columns, wants_row_number
from .shape import Shaper, surely_distinct


def prune(block: Block, predicates: set[str] | None, classes: set[str] | None) -> Block:
    """Only patterns that can make a triple with one of the predicates (and, for rdf:type, classes)."""

    def wanted(p) -> bool:
        if not isinstance(p.predicate, ConstPat):
            return True
        iri = p.predicate.term.value
        if classes is not None and iri == TYPE:
            return not isinstance(p.object, ConstPat) or getattr(p.object.term, "value", None) in classes
        return predicates is None or iri in predicates

    repeats = [Repeat(r.mode, r.lists, prune(r.body, predicates, classes), r.id, r.requires) for r in block.repeats]
    return Block([p for p in block.patterns if wanted(p)], [r for r in repeats if r.body.patterns or r.body.repeats])


def emit(rows: DataFrame, made, distinct_in_row: bool = True) -> DataFrame:
    """subject, predicate, object from a column of triple arrays."""
    if made is None:
        return rows.select(*[F.lit("").alias(c) for c in ("subject", "predicate", "object")]).limit(0)
    if distinct_in_row:
        made = F.array_distinct(made)
    return rows.select(F.inline(made)).filter("subject is not null")


def jit_friendly(spark: SparkSession) -> None:
    """Unless the session chose its own: no whole-stage methods beyond the size that HotSpot still compiles."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, "8000")


def triples(
    df: DataFrame,
    plan: Plan,
    *,
    bind_empty: bool = False,
    row_id: str | None = None,
    row_number: str | None = None,
    predicates: Iterable[str] | None = None,
    classes: Iterable[str] | None = None,
    distinct_in_row: bool = True,
) -> DataFrame:
    """The triples of every row that is not left out, as N-Triples text columns; equal triples of one row once.

    ``row_id`` names a column whose value labels blank nodes (else an arbitrary unique number).
    ``predicates`` and ``classes`` drop other patterns from the plan, so their columns are not read.
    """
    jit_friendly(df.sparkSession)
    root = plan.root
    if predicates is not None or classes is not None:
        root = prune(root, set(predicates) if predicates is not None else None, set(classes) if classes is not None else None)
    if plan.query is not None:
        from graphloom.sparql.compile import lift_query

        rows, values = lift_query(df, plan, bind_empty, row_id, row_number)
        wanted = None
    else:
        if row_number is None and not wants_row_number(plan, df.columns):  # for the scan; what a null cell gives is unbound
            for column in sorted({b.column for b in plan.bindings if b.var in plan.mandatory and b.column in df.columns}):
                df = df.filter(F.col(f"`{column}`").isNotNull())
        rows, values, bad = lift_columns(df, plan, bind_empty, row_id, row_number)
        # tested where the triples are made: a filter below would compute the values a second time
        tests = [values[name].bound for name in sorted(plan.mandatory) if name in values] + ([~bad] if bad is not None else [])
        wanted = functools.reduce(operator.and_, tests) if tests else None
    made = Shaper(F.col("_record"), values).triples(root)
    if made is not None and distinct_in_row and not surely_distinct(root, values):
        made = F.array_distinct(made)
    if made is not None and wanted is not None:
        made = F.when(wanted, made)
    return emit(rows, made, False)


def triples_with(plan: Plan, df: DataFrame, row_id: str, column: str) -> DataFrame:
    """Triples with a column of the input beside them (an event time, for a watermark)."""
    rows, values, bad = lift_columns(df.withColumn("_gl_kept", F.col(f"`{column}`")), plan, False, row_id, None, keep=("_gl_kept",))
    if bad is not None:
        rows = rows.filter(~bad)
    made = Shaper(F.col("_record"), values).triples(plan.root)
    return rows.select(F.col("_gl_kept").alias(column), F.inline(F.array_distinct(made))).filter("subject is not null")
