"""Parquet, Arrow IPC and RDF files as DataFrames."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.rdf import BNode, nt
from graphloom.sparql.syntax import parse_turtle

from .csv import read_csv

#: One N-Triples line.
LINE = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+(?:\.[^\s.]+)*|\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(?:<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file (or stream)."""
    import pyarrow as pa

    with pa.memory_map(path) as source:
        try:
            table = pa.ipc.open_file(source).read_all()
        except pa.ArrowInvalid:
            source.seek(0)
            table = pa.ipc.open_stream(source).read_all()
    return spark.createDataFrame(table)


def read_table(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """A table by its file's ending."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending == ".parquet":
        return spark.read.parquet(path)
    if ending in (".arrow", ".ipc", ".feather"):
        return read_arrow(spark, path)
    return read_csv(spark, path, **csv_options)


def read_ntriples(spark: SparkSession, *paths: str) -> DataFrame:
    """N-Triples or N-Quads files as subject, predicate, object; split by Spark, no driver work."""
    lines = spark.read.text(list(paths)).filter(~F.regexp_like("value", F.lit(r"^\s*(#.*)?\z")))
    bad = F.raise_error(F.concat(F.lit("not a line of N-Triples or N-Quads: "), F.substring("value", 1, 300))).cast("string")
    parts = lines.select(F.when(F.regexp_like("value", F.lit(LINE)), F.col("value")).otherwise(bad).alias("value"))
    return parts.select(*[F.regexp_extract("value", LINE, i).alias(c) for i, c in enumerate(("subject", "predicate", "object"), 1)])


def read_turtle(spark: SparkSession, *paths: str) -> DataFrame:
    """Turtle files, parsed on the driver; blank-node labels are made distinct between files."""
    rows = []
    for k, path in enumerate(paths):
        with open(path, encoding="utf-8") as f:
            triples, _ = parse_turtle(f.read(), "file://" + os.path.abspath(path))
        labels: dict[str, str] = {}
        for triple in triples:
            rows.append(tuple(nt(BNode(labels.setdefault(t.label, f"d{k}n{len(labels)}")) if isinstance(t, BNode) else t) for t in triple))
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


def read_rdf(spark: SparkSession, *paths: str) -> DataFrame:
    """RDF files in one DataFrame of triples."""
    files = [x for p in paths for x in (sorted(glob.glob(p)) or [p])]
    plain = [p for p in files if p.endswith((".nt", ".nq"))]
    parts = ([read_ntriples(spark, *plain)] if plain else []) + ([read_turtle(spark, *other)] if (other := [p for p in files if p not in plain]) else [])
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
