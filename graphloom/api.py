"""Mappings as objects: compile once, run over any DataFrame."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import write as sinks
from .operators.lift import LeftOut
from .operators.lift import left_out as left_out_rows
from .operators.run import triples as run_plan
from .ottr.expand import compile_templates, query_annotations
from .ottr.syntax import Library
from .plans.model import Plan
from .plans.rdf import Prefixes
from .session import ship
from .sources.csv import read_csv
from .sources.rows import number_rows, split_column
from .sparql.compile import annotated_query, parse_row_query


#: The column of row numbers that a run adds; mappings see it as ROWNUM.
ROW = "_gl_rownum"


@dataclass
class Mapping:
    """A compiled mapping: rows of a table to triples."""

    plan: Plan
    library: Library | None = field(default=None, repr=False)

    @staticmethod
    def sparql(query: str, name: str = "query") -> "Mapping":
        """A SPARQL CONSTRUCT that is evaluated once for each row."""
        return Mapping(parse_row_query(query, name))

    @staticmethod
    def sparql_file(path: str) -> "Mapping":
        with open(path, encoding="utf-8") as f:
            return Mapping.sparql(f.read(), os.path.basename(path))

    @staticmethod
    def ottr(library: str | Iterable[str] | Library, templates: str | Iterable[str], lists: dict[str, str] | None = None, languages: dict[str, str] | None = None) -> "Mapping":
        """Root templates whose parameters are columns of the same names; ``lists`` names separators of list columns.

        A single root with query annotations is lifted by the query they spell.
        """
        lib = library if isinstance(library, Library) else Library.load(*([library] if isinstance(library, str) else library))
        roots = [templates] if isinstance(templates, str) else list(templates)
        if len(roots) == 1:
            template = lib.get(lib.resolve(roots[0]))
            if (parts := query_annotations(template)) is not None:
                plan = compile_templates(lib, roots, None, None)
                plan.query = annotated_query(lib.prefixes, parts, roots[0])
                plan.prefixes = plan.query.prefixes
                plan.bindings = []
                return Mapping(plan, lib)
        return Mapping(compile_templates(lib, roots, lists, languages), lib)

    @property
    def name(self) -> str:
        return self.plan.name

    @property
    def prefixes(self) -> Prefixes:
        return self.plan.prefixes

    def triples(self, df: DataFrame, *, bind_empty_strings: bool = False, row_id: str | None = None, row_number: str | None = None, predicates=None, classes=None) -> DataFrame:
        """subject, predicate, object as N-Triples text; equal triples of one row once.  No shuffle.

        ``row_id`` names a key column that labels blank nodes; ``predicates`` and ``classes`` keep only such triples
        and read only their columns.
        """
        ship(df.sparkSession)
        return run_plan(df, self.plan, bind_empty=bind_empty_strings, row_id=row_id, row_number=row_number, predicates=predicates, classes=classes)

    def left_out(self, df: DataFrame, *, bind_empty_strings: bool = False) -> DataFrame:
        """row, message: cells that are no IRIs where IRIs are wanted; their rows make no triples."""
        if self.plan.query is not None:
            return df.select(F.lit(0).cast("long").alias("row"), F.lit("").alias("message")).limit(0)
        numbered = number_rows(df, ROW)
        return left_out_rows(numbered, self.plan, bind_empty_strings, F.col(ROW))

    def triplify(self, df: DataFrame, *, bind_empty_strings: bool = False, strict: bool = False, row_id: str | None = None) -> DataFrame:
        """Distinct triples.  ``strict`` raises where rows are left out."""
        if strict and (bad := self.left_out(df, bind_empty_strings=bind_empty_strings).limit(10).collect()):
            raise LeftOut("; ".join(r.message for r in bad))
        return self.triples(df, bind_empty_strings=bind_empty_strings, row_id=row_id).distinct()

    def write(self, df: DataFrame, path: str | None = None, *, format: str = "ntriples", graph: str | None = None, dedup: int | None = None, gzip: bool = False, bind_empty_strings: bool = False, row_id: str | None = None, folder: bool = False) -> str | None:
        """Write the triples of ``df``: to one file, to a folder of part files, or (no path) as text.

        ``dedup``: None, each row's triples once; 0, each triple once overall; N, once in windows of N.
        """
        if format not in sinks.FORMATS:
            raise ValueError(f"unknown format {format!r}")
        triples = self.triples(df, bind_empty_strings=bind_empty_strings, row_id=row_id)
        if dedup is not None:
            triples = triples.distinct() if dedup == 0 else sinks.dedup_window(triples, dedup)
        if path is None:
            return sinks.text_result(triples, format, graph, self.prefixes)
        (sinks.write_folder if folder else sinks.write_file)(triples, path, format, graph, self.prefixes, gzip)
        return None

    def run_csv(self, spark: SparkSession, *paths: str, splits: Iterable[tuple[str, str, str]] = (), limit: int | None = None, bind_empty_strings: bool = False, **options) -> DataFrame:
        """Triples of CSV files; ``splits`` are (column, new column, separator)."""
        df = read_csv(spark, *paths, bind_empty=bind_empty_strings, limit=limit, **options)
        df = number_rows(df, ROW)
        for column, new, separator in splits:
            df = split_column(df, column, new, separator)
        return self.triples(df, bind_empty_strings=bind_empty_strings, row_number=ROW)

    def shapes(self, base: str = "urn:shapes:"):
        """The SHACL shapes that the mapping's output conforms to."""
        from .shacl.shapes import derive

        return derive(self.plan, base)
