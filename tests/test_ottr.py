import pytest
from isomorphism import same

from graphloom.api import Mapping
from graphloom.operators.lift import LeftOut
from graphloom.ottr.instances import expand_instances
from graphloom.ottr.lint import lint
from graphloom.ottr.syntax import Library, OttrError, Type, parse
from graphloom.ottr.types import compatible, consistent, join, subtype
from graphloom.plans.rdf import OTTR, OWL, XSD

HEAD = """
@prefix ex: <http://ex.org/> . @prefix ottr: <http://ns.ottr.xyz/0.4/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
"""
E = "http://ex.org/"


def mapped(spark, body, rows, schema, templates="ex:T", **options):
    return Mapping.ottr(HEAD + body, templates, **options).triples(spark.createDataFrame(rows, schema))


def test_optional_mandatory_and_default(spark):
    body = """ex:T [ ottr:IRI ?id, ? xsd:string ?n, xsd:string ?d = "none", ? ottr:IRI ?m ] :: { ottr:Triple(?id, ex:n, ?n), ottr:Triple(?id, ex:d, ?d), ex:M(?id, ?m) } .
    ex:M [ ottr:IRI ?x, ottr:IRI ?m ] :: { ottr:Triple(?x, ex:m, ?m), ottr:Triple(?x, ex:has, _:b), ottr:Triple(_:b, ex:k, "v") } ."""
    out = mapped(spark, body, [("ex:a", "A", None, "ex:z"), ("ex:b", " ", "x", None), (None, "C", "y", "ex:q")], "id string, n string, d string, m string")
    same(out, f'<{E}a> <{E}n> "A" .\n<{E}a> <{E}d> "none" .\n<{E}a> <{E}m> <{E}z> .\n<{E}a> <{E}has> _:b .\n_:b <{E}k> "v" .\n<{E}b> <{E}d> "x" .')


def test_lists_expanders_and_collections(spark):
    body = """ex:T [ ottr:IRI ?id, ? List<xsd:string> ?a, ? List<xsd:integer> ?b ] :: { cross | ex:V(?id, ex:a, ++?a), zipMax | ex:P(?id, ++?a, ++?b), ottr:Triple(?id, ex:l, ?b), ottr:Triple(?id, ex:c, ("x", ("y"), ())) } .
    ex:V [ ottr:IRI ?x, ottr:IRI ?p, ?v ] :: { ottr:Triple(?x, ?p, ?v) } .
    ex:P [ ottr:IRI ?x, ? ?v, ? ?w ] :: { ottr:Triple(?x, ex:pair, _:p), ottr:Triple(_:p, ex:v, ?v), ottr:Triple(_:p, ex:w, ?w) } ."""
    out = mapped(spark, body, [("ex:a", "p; ;q", [7])], "id string, a string, b array<int>", lists={"a": ";"})
    I = f'"7"^^<{XSD}integer>'  # noqa: E741
    R = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    same(out, f"""<{E}a> <{E}a> "p" .
<{E}a> <{E}a> "q" .
<{E}a> <{E}pair> _:p0 .
_:p0 <{E}v> "p" .
_:p0 <{E}w> {I} .
<{E}a> <{E}pair> _:p1 .
_:p1 <{E}v> "q" .
<{E}a> <{E}l> _:l .
_:l <{R}first> {I} .
_:l <{R}rest> <{R}nil> .
<{E}a> <{E}c> _:c .
_:c <{R}first> "x" .
_:c <{R}rest> _:c1 .
_:c1 <{R}first> _:y .
_:y <{R}first> "y" .
_:y <{R}rest> <{R}nil> .
_:c1 <{R}rest> _:c2 .
_:c2 <{R}first> <{R}nil> .
_:c2 <{R}rest> <{R}nil> .""")  # fmt: skip


def test_typed_columns_and_bad_values(spark):
    body = "ex:T [ ottr:IRI ?id, ? xsd:int ?i, ? xsd:decimal ?d, ? xsd:dateTime ?t, ? xsd:boolean ?b ] :: { ottr:Triple(?id, ex:i, ?i), ottr:Triple(?id, ex:d, ?d), ottr:Triple(?id, ex:t, ?t), ottr:Triple(?id, ex:b, ?b) } ."
    df = spark.sql("select 'ex:a' id, 7 i, 2.50D d, timestamp_ntz'2024-01-02 03:04:05.500' t, true b union all select 'ex:b', null, 1e-7D, null, false")
    same(
        Mapping.ottr(HEAD + body, "ex:T").triples(df),
        f'<{E}a> <{E}i> "7"^^<{XSD}int> .\n<{E}a> <{E}d> "2.5"^^<{XSD}decimal> .\n<{E}a> <{E}t> "2024-01-02T03:04:05.5"^^<{XSD}dateTime> .\n<{E}a> <{E}b> "true"^^<{XSD}boolean> .\n<{E}b> <{E}d> "1e-7"^^<{XSD}decimal> .\n<{E}b> <{E}b> "false"^^<{XSD}boolean> .',
    )
    text = spark.createDataFrame([("ex:a", "abc")], "id string, i string")
    with pytest.warns(UserWarning, match="no column 'd'"):
        same(Mapping.ottr(HEAD + body, "ex:T").triples(text), f'<{E}a> <{E}i> "abc"^^<{XSD}int> .')


def test_rows_left_out(spark):
    m = Mapping.ottr(HEAD + "ex:T [ ottr:IRI ?id, ? ottr:IRI ?o ] :: { ottr:Triple(?id, ex:p, ?o) } .", "ex:T")
    df = spark.createDataFrame([("ex:a", "ex:b"), ("no iri", "also not"), ("ex:c", "x y")], "id string, o string").coalesce(1)
    same(m.triples(df), f"<{E}a> <{E}p> <{E}b> .")
    assert sorted(r.message for r in m.left_out(df).collect()) == ["row 2: column id: 'no iri' is not an IRI", "row 2: column o: 'also not' is not an IRI", "row 3: column o: 'x y' is not an IRI"]
    with pytest.raises(LeftOut):
        m.triplify(df, strict=True)
    with pytest.raises(ValueError, match="did you mean 'Id'"):
        m.triples(spark.createDataFrame([("a",)], "Id string"))


def test_query_annotations_and_languages(spark):
    body = """@prefix tq: <http://tools.example/tq#> .
    ex:T [ ottr:IRI ?s, ? xsd:integer ?n ] @@ tq:Prefix("ex", "http://ex.org/"), @@ tq:Prefix("xsd", "http://www.w3.org/2001/XMLSchema#"), @@ tq:Bind("s", "IRI(CONCAT(STR(ex:), ?k))"), @@ tq:Bind("n", "xsd:integer(?v)") :: { ottr:Triple(?s, ex:n, ?n) } ."""
    same(mapped(spark, body, [("a", "07"), ("b", "x")], "k string, v string"), f'<{E}a> <{E}n> "7"^^<{XSD}integer> .')
    label = "ex:T [ ottr:IRI ?id, rdf:langString ?l ] :: { ottr:Triple(?id, ex:l, ?l) } ."
    same(mapped(spark, label, [("ex:a", 'x "y"')], "id string, l string", languages={"l": "EN"}), f'<{E}a> <{E}l> "x \\"y\\""@en .')
    with pytest.raises(OttrError, match="name its language"):
        Mapping.ottr(HEAD + label, "ex:T")


def test_instances(spark):
    lib = Library.load(HEAD + "ex:T [ ottr:IRI ?a, ? xsd:string ?b, ? List<ottr:IRI> ?c ] :: { ottr:Triple(?a, ex:b, ?b), cross | ex:U(?a, ++?c), ottr:Triple(?a, ex:n, _:x) } . ex:U [ ottr:IRI ?a, ottr:IRI ?c ] :: { ottr:Triple(?a, ex:c, ?c) } .")
    out = expand_instances(spark, lib, HEAD + '\nex:T(ex:a, "q", (ex:p, ex:r)) . ex:T(ex:b, none, none) . ex:T(none, "z", none) . cross | ex:U(_:k, ++(ex:m, ex:n)) .')
    same(out, f'<{E}a> <{E}b> "q" .\n<{E}a> <{E}c> <{E}p> .\n<{E}a> <{E}c> <{E}r> .\n<{E}a> <{E}n> _:x .\n<{E}b> <{E}n> _:y .\n_:k <{E}c> <{E}m> .\n_:k <{E}c> <{E}n> .')


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("ex:T [ ?a ] :: { ex:Nowhere(?a) } .", "not defined"), ("ex:T [ ?a ] :: { ottr:Triple(?a, ex:p) } .", "takes 3 arguments"), ("ex:T [ ?a ] :: { ottr:Triple(?b, ex:p, ?a) } .", "not a parameter"),
        ("ex:T [ ?a ] :: { ex:T(?a) } .", "deeper than"), ("ex:T [ ?a ] :: { ottr:Triple(?a, zz:p, ?a) } .", "not declared"), ("ex:T [ ?a ] :: { ottr:Triple(++?a, ex:p, ?a) } .", "without an expander"),
    ],
)
def test_refusals(text, message):
    with pytest.raises(OttrError, match=message):
        Mapping.ottr(HEAD + text, "ex:T")


def test_parser_details():
    doc = parse(HEAD + '/*** a\ncomment ***/ ex:S [ !? List<NEList<xsd:int>> ?a = (1, 2.5, -3e0, true, "x"@en, "y"^^xsd:int, """z\n""") , ?b ] . # end\nex:B[ ] :: BASE .')
    s, b = doc.templates
    assert (s.kind, b.kind) == ("signature", "base") and s.parameters[0].optional and s.parameters[0].nonblank and str(s.parameters[0].type) == f"List<NEList<{XSD}int>>"
    assert len(s.parameters[0].default.items) == 7


def test_types():
    t = Type
    assert subtype(t(XSD + "byte"), t(XSD + "decimal")) and not subtype(t(XSD + "decimal"), t(XSD + "integer"))
    assert subtype(t("NEList", t(XSD + "int")), t("List", t(XSD + "integer"))) and not subtype(t("List", t(XSD + "int")), t("NEList", t(XSD + "int")))
    assert compatible(t("LUB", t(OTTR + "IRI")), t(OWL + "Class")) and not compatible(t(OTTR + "IRI"), t(OWL + "Class"))
    assert consistent(t(XSD + "int"), t(XSD + "decimal")) and not consistent(t(XSD + "int"), t(OTTR + "IRI"))
    assert join(t(XSD + "int"), t(XSD + "positiveInteger")) == t(XSD + "integer")


def test_lint():
    text = """ex:A [ ottr:IRI ?x, ?u ] :: { ex:Missing(?x), ex:B(?x), ex:B(1, 2), ottr:Triple("s", ex:p, ?x) } . ex:B [ xsd:integer ?n ] :: { ex:B(?n) } . ex:C [ ! ottr:IRI ?n = "x" ] :: { ottr:Triple(?n, ex:p, "v") } .
    ex:D [ ex:Odd ?z ] :: { ex:C(_:b), cross | ex:B(?z) } . ex:D [ ex:Odd ?z ] :: { ex:C(?z) } ."""
    found = {(f.check, f.template.rsplit("/", 1)[-1]) for f in lint(Library.load(HEAD + text))}
    assert {("undefined-template", "A"), ("type", "A"), ("arity", "A"), ("triple", "A"), ("unused-parameter", "A"), ("cycle", "B"), ("default", "C"), ("non-blank", "D"), ("expander", "D"), ("unknown-type", "D"), ("duplicate", "D")} <= found
    clean = "ex:F [ ottr:IRI ?a, xsd:integer ?i ] :: { ottr:Triple(?a, ex:p, ?i), ex:G(?i) } . ex:G [ xsd:decimal ?d ] :: { ottr:Triple(ex:s, ex:p, ?d) } ."
    assert lint(Library.load(HEAD + clean)) == []
