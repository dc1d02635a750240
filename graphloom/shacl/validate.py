"""SHACL validation as DataFrame queries: a join or filter per constraint, over any number of triples."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.literals import CANONICAL, canonical
from graphloom.plans.rdf import LANG_STRING, TYPE, nt
from graphloom.plans.typed import plain_text
from graphloom.sparql.dataset import parsed

from .shapes import NodeShape, PropertyShape

FINDING = "focus string, path string, value string, constraint string, shape string"


def targets(triples: DataFrame, shape: NodeShape) -> DataFrame:
    """The shape's focus nodes, each once."""
    if shape.target_class:
        return triples.filter((F.col("predicate") == f"<{TYPE}>") & (F.col("object") == f"<{shape.target_class}>")).select(F.col("subject").alias("focus")).distinct()
    return triples.sparkSession.createDataFrame([(f"<{shape.target_node}>",)], "focus string")


def ok_literal(dt: str):
    """Is the object a literal of the datatype, with a valid lexical form?"""
    term = parsed(F.col("value")).text
    if dt == LANG_STRING:
        return term["lang"].isNotNull()
    ok = (term["k"] == "lit") & (term["dt"] == dt)
    return ok & canonical(term["v"], dt).isNotNull() if dt in CANONICAL else ok


def property_findings(triples: DataFrame, focus: DataFrame, p: PropertyShape) -> list[DataFrame]:
    say = lambda df, constraint: df.select("focus", F.lit(p.path).alias("path"), "value", F.lit(constraint).alias("constraint"))
    own = triples.filter(F.col("predicate") == f"<{p.path}>").select(F.col("subject").alias("focus"), F.col("object").alias("value")).distinct()
    out = []
    if p.min_count:
        if p.min_count == 1:
            few = focus.join(own.select("focus"), "focus", "left_anti")
        else:
            counts = own.groupBy("focus").count().filter(F.col("count") >= p.min_count)
            few = focus.join(counts.select("focus"), "focus", "left_anti")
        out.append(say(few.withColumn("value", F.lit(None).cast("string")), "minCount"))
    values = own.join(focus, "focus", "left_semi")
    if p.max_count is not None:
        many = values.groupBy("focus").count().filter(F.col("count") > p.max_count)
        out.append(say(many.select("focus", F.lit(None).cast("string").alias("value")), "maxCount"))
    for term in p.has_values:
        missing = focus.join(own.filter(F.col("value") == nt(term)).select("focus"), "focus", "left_anti")
        out.append(say(missing.select("focus", F.lit(None).cast("string").alias("value")), "hasValue"))
    if p.among is not None:
        out.append(say(values.filter(~F.col("value").isin(*[nt(t) for t in p.among])), "in"))
    if p.pattern is not None:
        expression, flags = p.pattern
        if set(flags) - set("imsx"):
            raise ValueError(f"flags of a pattern: {flags!r}")
        fits = F.regexp_like(plain_text(parsed(F.col("value"))), F.lit(f"(?{flags}){expression}" if flags else expression))
        out.append(say(values.filter(~F.coalesce(fits, F.lit(False))), "pattern"))
    if p.node_kinds == {"lit"} and len(p.datatypes) == 1:
        out.append(say(values.filter(~F.coalesce(ok_literal(next(iter(p.datatypes))), F.lit(False))), "datatype"))
    elif p.node_kinds and len(p.node_kinds) < 3:
        starts = {"iri": "<", "bnode": "_:", "lit": '"'}
        kind = functools.reduce(lambda a, b: a | b, [F.col("value").startswith(starts[k]) for k in sorted(p.node_kinds)])
        out.append(say(values.filter(~kind), "nodeKind"))
    for c in sorted(p.classes or ()):
        members = triples.filter((F.col("predicate") == f"<{TYPE}>") & (F.col("object") == f"<{c}>")).select(F.col("subject").alias("value")).distinct()
        out.append(say(values.join(members, "value", "left_anti"), "class"))
    return out


def validate(triples: DataFrame, shapes: list[NodeShape]) -> DataFrame:
    """focus, path, value, constraint, shape: one row for every violation; an empty result conforms.

    ``triples`` is used by several branches: persist it if it is expensive to make.
    """
    parts = []
    for s in shapes:
        focus = targets(triples, s)
        for path in sorted(s.properties):
            for found in property_findings(triples, focus, s.properties[path]):
                parts.append(found.withColumn("shape", F.lit(s.target_class or s.target_node)))
    if not parts:
        return triples.sparkSession.createDataFrame([], FINDING)
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def conforms(triples: DataFrame, shapes: list[NodeShape]) -> bool:
    return validate(triples, shapes).isEmpty()


