import gzip
import http.server
import json
import threading

import pytest
from isomorphism import same

from graphloom.api import Mapping
from graphloom.bottr.h2 import QueryRefused, parse_select, read_select, records
from graphloom.bottr.maps import MapError, bad_brackets, endpoint_rows, parse_maps, run_maps, split_brackets
from graphloom.cli import main, ordered
from graphloom.operators import write as sinks
from graphloom.plans.rdf import XSD, nt, parse_ntriples
from graphloom.shacl.shapes import shapes_from, turtle
from graphloom.shacl.validate import conforms, validate
from graphloom.sources.csv import read_csv
from graphloom.sources.files import read_arrow, read_ntriples, read_rdf
from graphloom.sources.rows import number_rows, split_column
from graphloom.sparql.syntax import parse_turtle
from graphloom.streaming import stream_triples

E = "http://ex.org/"
LIB = """
@prefix ex: <http://ex.org/> . @prefix ottr: <http://ns.ottr.xyz/0.4/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
ex:T [ ottr:IRI ?id, xsd:string ?n, ? xsd:integer ?v ] :: { ottr:Triple(?id, rdf:type, ex:C), ottr:Triple(?id, ex:n, ?n), ottr:Triple(?id, ex:v, ?v) } .
"""


def test_csv_dialect(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes('﻿"id" ,n, v\r\na,"x \\"q\\" ""d"", y\nz",\r\n\r\nb,  s , \n'.encode())
    rows = [tuple(r) for r in read_csv(spark, str(f)).collect()]
    assert rows == [("a", 'x "q" "d", y\nz', None), ("b", "  s ", None)]
    assert read_csv(spark, str(f), upper=True).columns == ["ID", "N", "V"]
    assert read_csv(spark, str(f), bind_empty=True).collect()[0].v == ""
    assert read_csv(spark, str(f), header=False).columns == ["a", "b", "c"]
    ragged = tmp_path / "r.csv"
    ragged.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="row 2 has 1 fields"):
        read_csv(spark, str(ragged)).collect()


def test_rows(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("cast(id as string) k")
    numbered = number_rows(df, "n").collect()
    assert sorted(r.n for r in numbered) == list(range(1000)) and all(int(r.k) == r.n for r in numbered)
    parts = split_column(spark.createDataFrame([("a", "x|| y"), ("b", None)], "k string, s string"), "s", "p", "|")
    assert sorted((r.k, r.p or "") for r in parts.collect()) == [("a", ""), ("a", " y"), ("a", "x"), ("b", "")]
    assert split_column(df, "missing", "p", ",").filter("p is null").count() == 1000


def test_row_numbers_of_moving_partitions(spark, tmp_path):
    """Sorted and shuffled rows: both passes see the same partitions, whatever is sampled, joined or pruned."""
    n = 400_009
    rows = spark.range(0, n, 1, 3).selectExpr(f"id * 7919 % {n} as k", "md5(string(id)) as wide")
    numbered = number_rows(rows.orderBy("k"), "n")
    assert numbered.filter("n = k and length(wide) = 32").count() == n
    assert numbered.filter("n = k").count() == n  # reads no wide column
    descending = number_rows(rows.orderBy(rows.k.desc()).limit(n - 9), "n")
    assert descending.filter(f"n = {n - 1} - k").count() == n - 9
    spread = number_rows(rows.repartition(5, "k"), "n").agg({"n": "max", "*": "count"}).first()
    assert sorted(spread) == [n - 1, n]
    rows.limit(5000).write.bucketBy(4, "k").saveAsTable("gl_buckets", path=str(tmp_path / "b"))
    try:
        per_key = number_rows(spark.table("gl_buckets"), "n").groupBy("k").agg({"n": "max"}).toDF("k", "n")
        assert sorted(r.n for r in per_key.collect()) == list(range(5000))
    finally:
        spark.sql("drop table gl_buckets")


def test_arrow_and_rdf(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    assert [tuple(r) for r in read_arrow(spark, str(tmp_path / "t.arrow")).collect()] == [(1, "x"), (2, None)]
    (tmp_path / "a.nt").write_text(f'# c\n<{E}a> <{E}p> "x. y\\n" .\n<{E}a> <{E}p> _:b <{E}g> .\n')
    (tmp_path / "b.ttl").write_text(f"@prefix ex: <{E}> . ex:a ex:q [ ex:r 1 ] .")
    got = read_rdf(spark, str(tmp_path / "a.nt"), str(tmp_path / "b.ttl"))
    same(got, f'<{E}a> <{E}p> "x. y\\n" .\n<{E}a> <{E}p> _:b .\n<{E}a> <{E}q> _:c .\n_:c <{E}r> "1"^^<{XSD}integer> .')


def data(spark):
    return spark.createDataFrame([("ex:a", "A", "1"), ("ex:a", "A", "1"), ("ex:b", "B\n", None)], "id string, n string, v string").coalesce(1)


def test_sinks(spark, tmp_path):
    m = Mapping.ottr(LIB, "ex:T")
    assert m.write(data(spark)).count("\n") == 8 and m.write(data(spark), dedup=0).count("\n") == 5 and m.write(data(spark), dedup=3).count("\n") == 8 and m.write(data(spark), dedup=4).count("\n") == 5
    path = tmp_path / "o.nt.gz"
    m.write(data(spark), str(path), gzip=True, dedup=0)
    assert len(parse_ntriples(gzip.open(path, "rt").read())) == 5
    text = m.write(data(spark), format="turtle")
    assert len(parse_turtle(text)[0]) == 5 and "a ex:C" in text
    assert m.write(data(spark), format="nquads", graph="http://g").splitlines()[0].endswith("<http://g> .")
    with pytest.raises(ValueError, match="graph"):
        m.write(data(spark), format="nquads")
    old = tmp_path / "keep.nt"
    old.write_text("old")
    broken = Mapping.ottr(LIB, "ex:T").triples(data(spark)).selectExpr("raise_error('no') as subject", "predicate", "object")
    with pytest.raises(Exception, match="no"):
        sinks.write_file(broken, str(old))
    assert old.read_text() == "old" and [x.name for x in tmp_path.iterdir() if x.name.startswith(".parts")] == []
    sinks.write_folder(m.triples(data(spark)), str(tmp_path / "ttl"), "turtle", prefixes=m.prefixes)
    assert all(len(parse_turtle(p.read_text())[0]) for p in (tmp_path / "ttl").glob("part-*") if p.stat().st_size)


def test_upload_and_endpoint(spark):
    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            if self.headers.get("Transfer-Encoding") == "chunked":
                body = b""
                while (size := int(self.rfile.readline(), 16)) > 0:
                    body += self.rfile.read(size)
                    self.rfile.readline()
                self.rfile.readline()
            else:
                body = self.rfile.read(int(self.headers["Content-Length"]))
            seen[self.path] = body
            answer = json.dumps({"head": {"vars": ["x", "y"]}, "results": {"bindings": [{"x": {"type": "uri", "value": "http://a"}, "y": {"type": "literal", "value": "v", "xml:lang": "en"}}, {"x": {"type": "bnode", "value": "b"}}]}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/data"
    assert sinks.upload(Mapping.ottr(LIB, "ex:T").triplify(data(spark)), url, "http://g") == 200
    assert len(parse_ntriples(seen["/data?graph=http%3A%2F%2Fg"].decode())) == 5
    assert [tuple(r) for r in endpoint_rows(spark, url, "SELECT ...").collect()] == [("<http://a>", '"v"@en'), ("_:db", None)]
    server.shutdown()


def test_instance_csv(spark, tmp_path):
    assert list(records(iter(['a, b ,"",\n"q ""x"" q"z,,NULL,#\n# c\n']), comment="#", null="NULL")) == [["a", "b", "", None], ['q "x" q', None, None, "#"]]
    (tmp_path / "s.csv").write_text("x;1\nx;1\ny;\n")
    rows = read_select(spark, f"SELECT DISTINCT B, 'k''s' AS c, NULL, a FROM CSVREAD('{tmp_path}/s.csv', 'A;B', 'fieldSeparator=;')").collect()
    assert sorted(tuple(x or "" for x in r) for r in rows) == [("", "k's", "", "y"), ("1", "k's", "", "x")]
    for bad in ("SELECT a FROM people", "SELECT a FROM CSVREAD('f') WHERE a = 1", "DELETE"):
        with pytest.raises(QueryRefused):
            parse_select(bad)


def test_instance_maps(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,n,v\nex:a,A,007\nex:b,,8\nbad id,C,9\nex:d,D,x\n')
    lib = LIB + "ex:L [ ottr:IRI ?id, List<xsd:string> ?l, ? ?x ] :: { ottr:Triple(?id, ex:l, ?l), ottr:Triple(?id, ex:x, ?x) } ."
    head = "@prefix ottr: <http://ns.ottr.xyz/0.4/> . @prefix ex: <http://ex.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
    doc = tmp_path / "m.ttl"
    doc.write_text(head + '[] a ottr:InstanceMap ; ottr:template ex:T ; ottr:source [ a ottr:H2Source ] ; ottr:query "SELECT id, n, v FROM CSVREAD(\'@@THIS_DIR@@/d.csv\')" ; ottr:argumentMaps ( [ ottr:type ottr:IRI ] [ ottr:nullValue "?" ] [ ottr:type xsd:integer ] ) .')
    out = run_maps(spark, lib, str(doc))
    same(out.triples.filter("predicate like '%/v>'"), f'<{E}a> <{E}v> "007"^^<{XSD}integer> .\n<{E}b> <{E}v> "8"^^<{XSD}integer> .')
    assert sorted({r.row for r in out.left_out.collect()}) == [3, 4]
    (tmp_path / "l.csv").write_text('id,l,x\nex:a,"(p,(q,r))",_:k\nex:b,"s, t",new\n')
    doc.write_text(head + '[] a ottr:InstanceMap ; ottr:template ex:L ; ottr:source [ a ottr:H2Source ] ; ottr:query "SELECT * FROM CSVREAD(\'@@THIS_DIR@@/l.csv\')" ; ottr:argumentMaps ( [ ottr:type ottr:IRI ] [ ottr:type ( rdf:List xsd:string ) ] [ ottr:blankNodeFresh ( "new" ) ] ) .')
    R = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    same(run_maps(spark, lib, str(doc)).triples, f"""<{E}a> <{E}l> _:1 .
_:1 <{R}first> "p" .
_:1 <{R}rest> _:2 .
_:2 <{R}first> _:3 .
_:2 <{R}rest> <{R}nil> .
_:3 <{R}first> "q" .
_:3 <{R}rest> _:4 .
_:4 <{R}first> "r" .
_:4 <{R}rest> <{R}nil> .
<{E}a> <{E}x> _:k .
<{E}b> <{E}l> _:5 .
_:5 <{R}first> "s" .
_:5 <{R}rest> _:6 .
_:6 <{R}first> "t" .
_:6 <{R}rest> <{R}nil> .
<{E}b> <{E}x> _:n .""")  # fmt: skip
    for text, message in (("[] a ottr:InstanceMap ; ottr:template ex:T ; ottr:source [ a ottr:JDBCSource ] .", "is not one"), ('[] a ottr:InstanceMap ; ottr:template ex:T ; ottr:source [ a ottr:H2Source ] ; ottr:argumentMaps ( [ ottr:type ottr:IRI ; ottr:languageTag "en" ] ) .', "cannot have both")):
        with pytest.raises(MapError, match=message):
            parse_maps(head + text)


def test_shapes(spark):
    m = Mapping.ottr(LIB + "ex:U [ ottr:IRI ?id, xsd:string ?n, ? ottr:IRI ?o ] :: { ex:T(?id, ?n, none), ottr:Triple(?id, ex:o, _:b), ottr:Triple(_:b, rdf:type, ex:D), ottr:Triple(_:b, ex:to, ?o) } .", "ex:U")
    good = m.triples(spark.createDataFrame([("ex:a", "A", "ex:z"), ("ex:b", "B", None)], "id string, n string, o string"))
    shapes = shapes_from(parse_turtle(turtle(m.shapes()))[0])
    assert {s.target_class for s in shapes} == {E + "C", E + "D"} and conforms(good, shapes)
    bad = spark.createDataFrame([(f"<{E}q>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", f"<{E}C>"), (f"<{E}q>", f"<{E}n>", f"<{E}iri>"), (f"<{E}q>", f"<{E}o>", "_:x")], "subject string, predicate string, object string")
    assert {(r.path.removeprefix(E), r.constraint) for r in validate(bad, shapes).collect()} >= {("n", "datatype"), ("o", "class")}
    with pytest.raises(ValueError, match="no shapes"):
        shapes_from(parse_turtle("<http://a> <http://b> <http://c> .")[0])


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([("ex:a", "A", 1, 5), ("ex:b", "B", None, 6)], "id string, n string, v int, k int").write.parquet(str(source / "x"))
    stream = spark.readStream.schema("id string, n string, v int, k int").parquet(str(source / "*"))
    out = stream_triples(Mapping.ottr(LIB, "ex:T"), stream, "k")
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("streamed").count() == 5
    with pytest.raises(ValueError, match="streaming"):
        stream_triples(Mapping.ottr(LIB, "ex:T"), data(spark), "id")
    with pytest.raises(ValueError, match="numbered"):
        number_rows(stream)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "t.stottr").write_text(LIB)
    (tmp_path / "d.csv").write_text("id,n,v\nex:a,A,1\nex:b,B,\nnot an iri,C,2\n")
    lib, csv, out = str(tmp_path / "t.stottr"), str(tmp_path / "d.csv"), str(tmp_path / "o.nt")
    assert main(["run", "-l", lib, "-t", "ex:T", "-i", csv, "-o", out]) == 1 and len(parse_ntriples(open(out).read())) == 5
    assert "row 3: column id" in capsys.readouterr().err
    assert main(["run", "-l", lib, "-t", "ex:T", "-i", csv, "--test", "2", "--validate"]) == 0
    assert main(["lint", "-l", lib]) == 0 and main(["shapes", "-l", lib, "-t", "ex:T"]) == 0 and "targetClass" in capsys.readouterr().out
    (tmp_path / "i.stottr").write_text('@prefix ex: <http://ex.org/> .\nex:T(ex:q, "Q", 5) .\n')
    assert main(["expand", "-l", lib, str(tmp_path / "i.stottr"), "--format", "turtle"]) == 0 and "a ex:C" in capsys.readouterr().out
    assert main(["run", "-q", str(tmp_path / "missing.rq"), "-i", csv]) == 1
    assert ordered(["run", "--dedup", "-i", "x"]) == ["run", "-i", "x", "--dedup"] and ordered(["--test", "3", "-i", "x"]) == ["--test", "3", "-i", "x"]


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://example.com/ns#> .
ex:S a sh:NodeShape ; sh:targetClass ex:T ; sh:property [ sh:path ex:v ; %s ] ."""


@pytest.mark.parametrize(
    ("constraint", "broken"),
    [("sh:maxCount 1", {("maxCount", None)}), ("sh:in ( 'a' 'b' )", {("in", '"c d"')}), ("sh:pattern '^[a-c]$'", {("pattern", '"c d"')}), ("sh:pattern '^[A-C]( D)?$' ; sh:flags 'i'", set()), ("sh:hasValue 'a'", set()), ("sh:hasValue 'z'", {("hasValue", None)})],
)
def test_shapes_that_users_write(spark, constraint, broken):
    graph = read_turtle_text(spark, "ex:x a ex:T ; ex:v 'a' , 'c d' . ex:y ex:v 'q' .")
    found = validate(graph, shapes_from(parse_turtle(SHAPES % constraint)[0])).collect()
    assert {(r.constraint, r.value) for r in found} == broken and all(r.focus == "<http://example.com/ns#x>" for r in found)


@pytest.mark.parametrize("constraint", ["sh:minLength 3", "sh:or ( [ sh:datatype ex:a ] )", "sh:node ex:Other", "sh:minCount 1 ; sh:lessThan ex:w"])
def test_constraints_that_are_not_checked_are_refused(constraint):
    with pytest.raises(ValueError, match="not supported"):
        shapes_from(parse_turtle(SHAPES % constraint)[0])


def read_turtle_text(spark, text):
    triples, _ = parse_turtle("@prefix ex: <http://example.com/ns#> . " + text)
    return spark.createDataFrame([tuple(nt(t) for t in x) for x in triples], "subject string, predicate string, object string")


@pytest.mark.parametrize(
    ("cell", "items"),
    [
        ("a; b", ["a", "b"]), ("", [""]), ("(a; b)", ["a", "b"]), ("()", []), ("(a; (b; c); d)", ["a", ["b", "c"], "d"]), ("((a);(b))", [["a"], ["b"]]), ("( () )", [[]]), ("(a, b)", ["a, b"]),
        ("(a", None), ("a)", None), ("(a)(b)", None), ("(a) b", None), ("x (a)", None), (")(", None),
    ],
)
def test_brackets_of_list_cells(spark, cell, items):
    from pyspark.sql import functions as F

    bad = spark.range(1).select(bad_brackets(F.lit(cell)).alias("bad")).first().bad
    assert bad is (items is None)
    if items is not None:
        assert split_brackets(cell, ";") == items
        assert split_brackets(cell.replace(";", " || "), "||") == items


def test_malformed_ntriples_lines_are_errors(spark, tmp_path):
    (tmp_path / "a.nt").write_text("# a comment\n\n<http://a> <http://b> \"c\" .\n")
    assert read_ntriples(spark, str(tmp_path / "a.nt")).count() == 1
    (tmp_path / "b.nt").write_text("<http://a> <http://b> c .\n")
    with pytest.raises(Exception, match="not a line"):
        read_ntriples(spark, str(tmp_path / "b.nt")).collect()


def test_run_reads_standard_input(spark, tmp_path, monkeypatch):
    import io

    (tmp_path / "q.rq").write_text("PREFIX ex: <http://example.com/ns#> CONSTRUCT { ?s ex:v ?b } WHERE { BIND(IRI(CONCAT('http://example.com/', ?a)) AS ?s) }")
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"a,b\n1,x\n2,y\n")))
    assert main(["run", "-q", str(tmp_path / "q.rq"), "-o", str(tmp_path / "o.nt")]) == 0
    assert sorted((tmp_path / "o.nt").read_text().splitlines()) == ['<http://example.com/1> <http://example.com/ns#v> "x" .', '<http://example.com/2> <http://example.com/ns#v> "y" .']
