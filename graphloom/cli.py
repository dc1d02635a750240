"""Command line: python -m graphloom run | expand | shapes | lint | bottr.

Exit status: 0 ok; 1 an error, rows left out, or lint errors; 2 wrong usage; 3 output that does not conform.
"""

from __future__ import annotations

import argparse
import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import SparkSession

from .api import Mapping
from .bottr.maps import run_maps
from .operators import write as sinks
from .ottr.instances import expand_instances
from .ottr.lint import lint
from .ottr.syntax import Library
from .plans.rdf import Prefixes
from .shacl.shapes import shapes_from, turtle
from .shacl.validate import validate
from .sources.files import read_table
from .sources.rows import number_rows, split_column
from .sparql.syntax import parse_turtle


def session() -> SparkSession:
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def output_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--output", help="a file (else standard output)")
    p.add_argument("--format", choices=sinks.FORMATS, default="ntriples")
    p.add_argument("--graph", help="the graph of N-Quads, or of an upload")
    p.add_argument("--gzip", action="store_true")
    p.add_argument("--dedup", nargs="?", const=0, type=int, default=None, metavar="N", help="each triple once: overall, or in windows of N")
    p.add_argument("--upload", metavar="URL", help="send the triples by the Graph Store protocol")
    p.add_argument("--replace", action="store_true", help="the upload replaces the graph")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphloom", description="Tables to RDF on Spark.")
    verbs = out.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("run", help="map a table")
    run.add_argument("-q", "--query", help="a SPARQL CONSTRUCT file")
    run.add_argument("-l", "--library", action="append", default=[], help="template files or folders")
    run.add_argument("-t", "--template", action="append", default=[], help="root templates")
    run.add_argument("-i", "--input", help="CSV, Parquet or Arrow")
    run.add_argument("--delimiter", default=",")
    run.add_argument("--quote", default='"')
    run.add_argument("--escape", default="\\")
    run.add_argument("-H", "--no-header", action="store_true")
    run.add_argument("-n", "--upper", action="store_true", help="column names in upper case")
    run.add_argument("--bind-empty-strings", action="store_true")
    run.add_argument("--split", nargs=3, action="append", default=[], metavar=("COLUMN", "NEW", "SEP"))
    run.add_argument("--list", nargs=2, action="append", default=[], metavar=("PARAMETER", "SEP"))
    run.add_argument("--lang", nargs=2, action="append", default=[], metavar=("PARAMETER", "TAG"))
    run.add_argument("--test", nargs="?", const=5, type=int, metavar="N", help="the first N rows only")
    run.add_argument("--strict", action="store_true", help="rows left out are an error before output")
    run.add_argument("--validate", nargs="?", const="", metavar="SHAPES", help="check against shapes (else those of the mapping)")
    output_options(run)
    expand = verbs.add_parser("expand", help="expand template instances")
    expand.add_argument("-l", "--library", action="append", required=True)
    expand.add_argument("instances", nargs="+")
    output_options(expand)
    shapes = verbs.add_parser("shapes", help="SHACL shapes of a mapping")
    shapes.add_argument("-q", "--query")
    shapes.add_argument("-l", "--library", action="append", default=[])
    shapes.add_argument("-t", "--template", action="append", default=[])
    shapes.add_argument("--base", default="urn:shapes:")
    check = verbs.add_parser("lint", help="check a template library")
    check.add_argument("-l", "--library", action="append", required=True)
    check.add_argument("--errors-only", action="store_true")
    check.add_argument("--deny-warnings", action="store_true")
    maps = verbs.add_parser("bottr", help="run instance maps")
    maps.add_argument("-l", "--library", action="append", required=True)
    maps.add_argument("maps", nargs="+")
    output_options(maps)
    return out


def ordered(args: list[str]) -> list[str]:
    """Options whose value may be missing go last, so that they never swallow a file name."""
    bare = [a for i, a in enumerate(args) if a in ("--dedup", "--test", "--validate") and not (i + 1 < len(args) and (args[i + 1].isdigit() or a == "--validate" and args[i + 1].endswith((".ttl", ".nt"))))]
    return [a for i, a in enumerate(args) if a not in bare or (i + 1 < len(args) and args[i + 1].isdigit())] + bare


def deliver(triples, args, prefixes: Prefixes) -> None:
    if args.dedup is not None:
        triples = triples.distinct() if args.dedup == 0 else sinks.dedup_window(triples, args.dedup)
    if args.upload:
        sinks.upload(triples, args.upload, args.graph, args.replace)
    elif args.output:
        sinks.write_file(triples, args.output, args.format, args.graph, prefixes, args.gzip)
    else:
        sys.stdout.write(sinks.text_result(triples, args.format, args.graph, prefixes))


def mapping_of(args) -> Mapping:
    if bool(args.query) == bool(args.template):
        raise SystemExit(2)
    if args.query:
        return Mapping.sparql_file(args.query)
    return Mapping.ottr(args.library, args.template, dict(getattr(args, "list", [])), dict(getattr(args, "lang", [])))


def spooled(spark: SparkSession, stream) -> str:
    """Standard input as a file that the executors can read: in spark.checkpoint.dir, or a temporary one with a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("standard input needs spark.checkpoint.dir, a folder that the executors share")
    folder = tempfile.mkdtemp(prefix="graphloom-in-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    local = os.path.join(folder, "stdin.csv")
    with open(local, "wb") as out:
        shutil.copyfileobj(stream, out)
    if shared is None:
        return local
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/stdin-{uuid.uuid4().hex}.csv")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path("file://" + local), path)
    system.deleteOnExit(path)
    return path.toString()


def run(args) -> int:
    mapping, spark = mapping_of(args), session()
    source = args.input or (mapping.plan.query.source if mapping.plan.query is not None else None)
    if not source and sys.stdin.isatty():
        print("no input: name one with -i, or send CSV to standard input", file=sys.stderr)
        return 2
    source = source.removeprefix("file://") if source and source != "-" else spooled(spark, sys.stdin.buffer)
    options = {} if source.endswith((".parquet", ".arrow", ".ipc", ".feather")) else {"delimiter": args.delimiter, "quote": args.quote, "escape": args.escape, "header": not args.no_header, "upper": args.upper, "bind_empty": args.bind_empty_strings}
    df = read_table(spark, source, **options)
    if args.test is not None:
        df = df.limit(args.test)
    df = number_rows(df, "_gl_rownum")
    for column, new, separator in args.split:
        df = split_column(df, column, new, separator)
    bad = 0
    if mapping.plan.query is None:
        cells = mapping.left_out(df, bind_empty_strings=args.bind_empty_strings)
        for r in (shown := cells.limit(10).collect()):
            print(r.message, file=sys.stderr)
        bad = cells.select("row").distinct().count() if shown else 0
    if bad:
        print(f"{bad} rows left out", file=sys.stderr)
        if args.strict:
            return 1
    triples = mapping.triples(df, bind_empty_strings=args.bind_empty_strings, row_number="_gl_rownum")
    found = []
    if args.validate is not None:
        triples = triples.persist()
        shapes = mapping.shapes()
        if args.validate:
            with open(args.validate, encoding="utf-8") as f:
                shapes = shapes_from(parse_turtle(f.read())[0])
        found = validate(triples, shapes).limit(10).collect()
    deliver(triples, args, mapping.prefixes)
    for r in found:
        print(f"{r.focus} {r.path}: {r.constraint} {r.value or ''}", file=sys.stderr)
    return 3 if found else 1 if bad else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(ordered(list(sys.argv[1:] if argv is None else argv)))
    try:
        if args.verb == "run":
            return run(args)
        if args.verb == "shapes":
            sys.stdout.write(turtle(mapping_of(args).shapes(args.base), args.base))
            return 0
        if args.verb == "lint":
            found = lint(Library.load(*args.library))
            errors = sum(f.severity == "error" for f in found)
            for f in found:
                if f.severity == "error" or not args.errors_only:
                    print(f"{f.severity}: {f.template}: {f.message} [{f.check}]")
            print(f"{errors} errors, {len(found) - errors} warnings", file=sys.stderr)
            return 1 if errors or (args.deny_warnings and found) else 0
        library = Library.load(*args.library)
        if args.verb == "expand":
            deliver(expand_instances(session(), library, *args.instances), args, library.prefixes)
            return 0
        result = run_maps(session(), library, *args.maps)
        bad = result.left_out.limit(10).collect()
        deliver(result.triples, args, library.prefixes)
        for r in bad:
            print(f"map {r.map + 1}: {r.message}", file=sys.stderr)
        return 1 if bad else 0
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
