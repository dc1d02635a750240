"""Sinks: N-Triples, N-Quads and Turtle, as folders of part files or one file, with gzip and dedup."""

from __future__ import annotations

import glob
import gzip
import os
import re
import shutil
import tempfile
import urllib.request

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.rdf import Prefixes

FORMATS = ("ntriples", "nquads", "turtle")


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Each triple once over the whole result."""
    return triples.distinct()


def dedup_window(triples: DataFrame, size: int) -> DataFrame:
    """Each triple once within windows of at least ``size`` distinct triples, per partition and in order.

    Exact only for one partition: a window does not reach over a partition's end.  Memory is bounded by the window.
    """
    names = triples.columns

    def run(batches):
        seen: set = set()
        for batch in batches:
            keep = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                new = row not in seen
                keep.append(new)
                if new:
                    seen.add(row)
                    if len(seen) >= size:
                        seen.clear()
            yield batch.filter(pa.array(keep))

    return triples.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def lines(triples: DataFrame, form: str = "ntriples", graph: str | None = None) -> DataFrame:
    """One text line per triple."""
    if form == "nquads":
        if not graph:
            raise ValueError("N-Quads need the IRI of a graph")
        return triples.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit(f"<{graph}> .")).alias("value"))
    return triples.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")).alias("value"))


def shortened(term: Column, prefixes: Prefixes) -> Column:
    """An IRI as a prefixed name where a declared prefix fits and the rest is a plain name."""
    out = term
    for prefix, namespace in sorted(prefixes.items(), key=lambda x: len(x[1])):
        form = "^<" + re.escape(namespace) + r"([A-Za-z_][A-Za-z0-9_-]*|)>$"
        out = F.regexp_replace(out, form.replace("\\/", "/"), f"{prefix}:$1".replace("\\", ""))
    return out


def turtle_subjects(triples: DataFrame, prefixes: Prefixes) -> DataFrame:
    """One block of Turtle per subject, sorted; equal triples once.

    Subjects are range-partitioned and sorted; a subject's predicates are grouped with its objects.
    """
    rdf_type = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    verb = F.when(F.col("predicate") == rdf_type, F.lit("a")).otherwise(shortened(F.col("predicate"), prefixes))
    short = triples.distinct().select(F.col("subject").alias("_key"), shortened(F.col("subject"), prefixes).alias("s"), F.col("predicate").alias("_p"), verb.alias("p"), shortened(F.col("object"), prefixes).alias("o"))
    by_verb = short.groupBy("_key", "s", "_p", "p").agg(F.concat_ws(" , ", F.array_sort(F.collect_list("o"))).alias("objects"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_p", "p", "objects"))), lambda x: F.concat_ws(" ", x["p"], x["objects"]))
    blocks = by_verb.groupBy("_key", "s").agg(F.concat_ws(" ;\n    ", items).alias("body"))
    return blocks.select("_key", F.concat_ws(" ", "s", "body", F.lit(".")).alias("value")).repartitionByRange("_key").sortWithinPartitions("_key").select("value")


def turtle_header(prefixes: Prefixes) -> str:
    return "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in prefixes.items())


def write_folder(triples: DataFrame, path: str, form: str = "ntriples", graph: str | None = None, prefixes: Prefixes | None = None, compress: bool = False) -> None:
    """Part files in a folder, each valid by itself; the committer makes the folder appear whole."""
    if form == "turtle":
        header, blocks = turtle_header(prefixes or Prefixes()), turtle_subjects(triples, prefixes or Prefixes())

        def with_header(batches):
            first = True
            for batch in batches:
                rows = batch.column(0).to_pylist()
                if first and rows:
                    rows.insert(0, header)
                    first = False
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

        text = blocks.mapInArrow(with_header, "value string")
    else:
        text = lines(triples, form, graph)
    writer = text.write.mode("errorifexists")
    (writer.option("compression", "gzip") if compress else writer).text(path)


def write_file(triples: DataFrame, path: str, form: str = "ntriples", graph: str | None = None, prefixes: Prefixes | None = None, compress: bool = False) -> None:
    """One file on the driver, put in its place at the end.

    With a local master the parts are written beside the target and joined; executors of a cluster have other
    disks, so there the driver streams the rows, one partition after another.
    """
    folder = tempfile.mkdtemp(prefix=".parts-", dir=os.path.dirname(os.path.abspath(path)) or ".")
    master = triples.sparkSession.sparkContext.master
    try:
        target, whole = os.path.join(folder, "parts"), os.path.join(folder, "whole")
        text = turtle_subjects(triples, prefixes or Prefixes()) if form == "turtle" else lines(triples, form, graph)
        here = re.fullmatch(r"local(\[.*\])?", master) is not None
        if here:
            text.write.text("file://" + target)
            if not os.path.exists(os.path.join(target, "_SUCCESS")):
                raise OSError(f"the parts of {path} are not complete")
        with gzip.open(whole, "wb") if compress else open(whole, "wb") as out:
            if form == "turtle":
                out.write(turtle_header(prefixes or Prefixes()).encode())
            if not here:
                out.writelines((r.value + "\n").encode() for r in text.toLocalIterator(prefetchPartitions=True))
            for part in sorted(glob.glob(os.path.join(target, "part-*"))):
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out)
        os.replace(whole, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def text_result(triples: DataFrame, form: str = "ntriples", graph: str | None = None, prefixes: Prefixes | None = None) -> str:
    """The whole result as text, streamed to the driver partition by partition."""
    if form == "turtle":
        return turtle_header(prefixes or Prefixes()) + "".join(r.value + "\n" for r in turtle_subjects(triples, prefixes or Prefixes()).toLocalIterator())
    return "".join(r.value + "\n" for r in lines(triples, form, graph).toLocalIterator())


def upload(triples: DataFrame, url: str, graph: str | None = None, replace: bool = False, headers: dict[str, str] | None = None, timeout: float = 600) -> int:
    """Send N-Triples in one request by the SPARQL Graph Store protocol; the HTTP status.

    One request is one transaction, so the driver streams the partitions one after another.
    """
    from urllib.parse import quote

    target = url + ("&" if "?" in url else "?") + (f"graph={quote(graph, safe='')}" if graph else "default")
    body = ((r.value + "\n").encode() for r in lines(triples).toLocalIterator(prefetchPartitions=True))
    request = urllib.request.Request(target, data=body, method="PUT" if replace else "POST", headers={"Content-Type": "application/n-triples", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.status
