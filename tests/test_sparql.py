import pytest
from isomorphism import same

from graphloom.api import Mapping
from graphloom.functions.sparql import QueryError
from graphloom.plans.rdf import XSD
from graphloom.sparql.dataset import select_query
from graphloom.sparql.syntax import SyntaxProblem, parse_query, parse_turtle

HEAD = "PREFIX ex: <http://ex.org/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX apf: <http://jena.apache.org/ARQ/property#> PREFIX afn: <http://jena.apache.org/ARQ/function#> "
E = "http://ex.org/"


def evaluated(spark, expression, schema="a string, b string", rows=(("x", None),)):
    """The N-Triples text of an expression for one row (None: unbound)."""
    df = spark.createDataFrame(list(rows), schema)
    out = Mapping.sparql(HEAD + f"CONSTRUCT {{ ex:s ex:p ?out }} WHERE {{ BIND({expression} AS ?out) }}").triples(df).collect()
    return out[0].object if out else None


D, I, B, DBL = (f"^^<{XSD}{x}>" for x in ("decimal", "integer", "boolean", "double"))


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ('1 + "2"^^xsd:int', f'"3"{I}'), ("7 / 2", f'"3.5"{D}'), ("1 / 0", None), ("80 / 3", f'"26.666666666666666667"{D}'), ("1.50 * 2", f'"3"{D}'), ("1e0 + 1", f'"2"{DBL}'), ("-(3)", f'"-3"{I}'), ('"a" + 1', None),
        ("1 = 1.0", f'"true"{B}'), ('"a" < "b"', f'"true"{B}'), ('"a" = 1', None), ("1 < 2 && ?b", None), ("false && ?b", f'"false"{B}'), ("true || ?b", f'"true"{B}'), ("!(1 = 2)", f'"true"{B}'), ('2 IN (1, 2)', f'"true"{B}'), ("2 NOT IN (1, ?b)", None),
        ('IF(?b, "t", "f")', None), ('IF(true, 1, "f")', f'"1"{I}'), ('COALESCE(?b, ?a)', '"x"'), ("BOUND(?b)", f'"false"{B}'), ("BOUND(?a)", f'"true"{B}'),
        ("STR(ex:y)", f'"{E}y"'), ('LANG("x"@EN)', '"en"'), ('LANG("x")', '""'), ("DATATYPE(1.5)", f"<{XSD}decimal>"), ('LANGMATCHES("en-GB", "en")', f'"true"{B}'), ('IRI("http://q.org/z")', "<http://q.org/z>"), ('IRI("no good")', None),
        ("ABS(-2)", f'"2"{I}'), ("CEIL(1.2)", f'"2"{D}'), ("FLOOR(-1.2)", f'"-2"{D}'), ("ROUND(2.5)", f'"3"{D}'), ("ROUND(-2.5)", f'"-2"{D}'),
        ('CONCAT("a"@en, "b"@en)', '"ab"@en'), ('CONCAT("a", "b"@en)', '"ab"'), ('SUBSTR("hello", 2)', '"ello"'), ('SUBSTR("hello", 0, 3)', '"he"'), ('SUBSTR("a\U0001F600b", 2, 1)', '"\U0001F600"'), ('STRLEN("\U0001F600")', f'"1"{I}'),
        ('REPLACE("abc", "b", "$0x")', '"abxc"'), ('REGEX("ABC", "b", "i")', f'"true"{B}'), ('UCASE("é"@fr)', '"É"@fr'), ('ENCODE_FOR_URI("a b/é*~")', '"a%20b%2F%C3%A9%2A~"'), ('CONTAINS("abc", "b")', f'"true"{B}'),
        ('STRBEFORE("abc", "b")', '"a"'), ('STRBEFORE("abc", "z")', '""'), ('STRAFTER("abc"@en, "b")', '"c"@en'), ('STRAFTER("abc"@en, "z")', '""'),
        ('YEAR(xsd:dateTime("2024-03-05T10:15:30.5+02:00"))', f'"2024"{I}'), ('SECONDS(xsd:dateTime("2024-03-05T10:15:30.5+02:00"))', f'"30.5"{D}'), ('TZ(xsd:dateTime("2024-03-05T10:15:30+02:00"))', '"+02:00"'), ('TIMEZONE(xsd:dateTime("2024-03-05T10:15:30-05:30"))', f'"-PT5H30M"^^<{XSD}dayTimeDuration>'), ('xsd:dateTime("2024-03-05T10:00:00Z") < xsd:dateTime("2024-03-05T11:30:00+01:00")', f'"true"{B}'),
        ('MD5("abc")', '"900150983cd24fb0d6963f7d28e17f72"'), ('STRDT("7", xsd:int)', f'"7"{I}'), ('STRLANG("x", ?a)', '"x"@x'), ("isIRI(ex:a)", f'"true"{B}'), ("isNumeric(1.0)", f'"true"{B}'), ('isNumeric("1")', f'"false"{B}'), ("sameTerm(1, 1.0)", f'"false"{B}'),
        ('xsd:integer("007")', f'"7"{I}'), ('xsd:integer("x")', None), ("xsd:integer(2.9)", f'"2"{I}'), ("xsd:boolean(0)", f'"false"{B}'), ('xsd:date("2024-02-30")', None), ('xsd:date("2024-02-29")', f'"2024-02-29"^^<{XSD}date>'), ('xsd:duration("P1DT2H")', f'"P1DT2H"^^<{XSD}duration>'), ('xsd:time("10:00")', None), ("xsd:string(1.50)", '"1.5"'),
        ('afn:substr("abcdef", 1, 3)', '"bc"'), ('afn:substr("abc", 1, 9)', None), ("afn:min(3, 2.5)", f'"2.5"{D}'), ('afn:localname(ex:ab)', '"ab"'), ('afn:namespace(<http://ex.org/p%20q>)', '"http://ex.org/p%20"'), ("afn:sqrt(4)", f'"2"{DBL}'),
        ('EXISTS { VALUES ?a { "x" } }', f'"true"{B}'), ('tarql:expandPrefixedName("ex:q")', f"<{E}q>"), ('tarql:expandPrefixedName("zz:q")', None), ('tarql:expandPrefix("ex")', f'"{E}"'),
    ],
)
def test_expressions(spark, expression, expected):
    assert evaluated(spark, expression) == expected


def row_query(spark, construct, where, rows, schema, modifiers="", **options):
    return Mapping.sparql(f"{HEAD} CONSTRUCT {{ {construct} }} WHERE {{ {where} }} {modifiers}").triples(spark.createDataFrame(rows, schema), **options)


def test_blank_nodes_follow_records_and_solutions(spark):
    out = row_query(spark, "?x ex:k ?b ; ex:n [ ex:w ?w ]", 'BIND(IRI(CONCAT(STR(ex:), ?k)) AS ?x) BIND(BNODE() AS ?b) VALUES ?w { 1 2 }', [("a",), ("b",)], "k string")
    expected = "".join(f'<{E}{k}> <{E}k> _:{k} .\n' + "".join(f'<{E}{k}> <{E}n> _:{k}{w} .\n_:{k}{w} <{E}w> "{w}"{I} .\n' for w in (1, 2)) for k in "ab")
    same(out, expected)


def test_split_twice_is_a_cross_product_and_filter_holds_for_the_group(spark):
    out = row_query(spark, "?r ex:x ?x ; ex:y ?y", 'FILTER(?x != "skip") BIND(IRI(CONCAT(STR(ex:), ?k)) AS ?r) ?x apf:strSplit (?xs ",") . ?y apf:strSplit (?ys ";") BIND(UCASE(?x) AS ?u)', [("a", "p, skip,q,,", "1; 2")], "k string, xs string, ys string")
    same(out, "".join(f'<{E}a> <{E}{v}> "{w}" .\n' for v, w in (("x", "p"), ("x", "q"), ("y", "1"), ("y", "2"))))


@pytest.mark.parametrize(("text", "parts"), [("a;;b", ["a", "", "b"]), ("a;b;", ["a", "b"]), ("a;b; ", ["a", "b", ""]), (";a", ["", "a"]), ("  x ; y  ", ["x", "y"]), ("a", ["a"])])
def test_java_split(spark, text, parts):
    out = row_query(spark, "ex:s ex:p ?p", '?p apf:strSplit (?t ";")', [(text,)], "t string")
    assert sorted(r.object for r in out.collect()) == sorted({f'"{x}"' for x in parts})


def test_constant_relations(spark):
    where = 'BIND(IRI(CONCAT(STR(ex:), ?k)) AS ?r) OPTIONAL { VALUES (?k ?w) { ("a" 1) ("a" 2) (UNDEF 3) } FILTER(?w > 1) } MINUS { VALUES ?k { "c" } }'
    out = row_query(spark, "?r ex:w ?w ; ex:k ?k", where, [("a",), ("b",), ("c",)], "k string")
    same(out, f'<{E}a> <{E}k> "a" .\n<{E}a> <{E}w> "2"{I} .\n<{E}a> <{E}w> "3"{I} .\n<{E}b> <{E}k> "b" .\n<{E}b> <{E}w> "3"{I} .')


def test_modifiers_hold_per_row(spark):
    out = row_query(spark, "?r ex:w ?w", 'BIND(IRI(CONCAT(STR(ex:), ?k)) AS ?r) ?w apf:strSplit (?v ",")', [("a", "3,1,2"), ("b", "9")], "k string, v string", "ORDER BY DESC(?w) LIMIT 2")
    same(out, f'<{E}a> <{E}w> "3" .\n<{E}a> <{E}w> "2" .\n<{E}b> <{E}w> "9" .')


def test_shadowing_rownum_and_types(spark):
    df = spark.createDataFrame([("a", 5), ("b", None)], "k string, n int").coalesce(1)
    m = Mapping.sparql(HEAD + "CONSTRUCT { ?k ex:n ?n ; ex:r ?ROWNUM } WHERE { BIND(ex:fixed AS ?k) }")
    same(m.triples(df), f'<{E}fixed> <{E}n> "5" .\n<{E}fixed> <{E}r> "0"{I} .\n<{E}fixed> <{E}r> "1"{I} .')


@pytest.mark.parametrize(
    "query", ["CONSTRUCT { ?s ?p ?o } WHERE { BIND(foo(?a) AS ?s) }", "CONSTRUCT { ?s ?p ?o } WHERE { BIND(zz:f(?a) AS ?s) }", "SELECT * WHERE { ?s ?p }", "CONSTRUCT { ?s ?p ?o } WHERE { ?a apf:bag ?b }", "CONSTRUCT { ?s ?p ?o } WHERE { ?a apf:strSplit ?b }", "SELECT ?x WHERE { }"]
)
def test_refusals(query):
    with pytest.raises((SyntaxProblem, QueryError)):
        Mapping.sparql(HEAD + query)


def test_unknown_function_fails_before_input(spark):
    with pytest.raises(QueryError, match="unknown function"):
        row_query(spark, "ex:s ex:p ?x", "BIND(ex:f(?k) AS ?x)", [("a",)], "k string")


def test_select_over_triples(spark):
    rows = [(f"<{E}a>", f"<{E}n>", '"A"'), (f"<{E}b>", f"<{E}n>", '"B"@en'), (f"<{E}a>", f"<{E}k>", f"<{E}b>"), (f"<{E}b>", f"<{E}k>", f"<{E}c>"), (f"<{E}a>", f"<{E}v>", f'"2"{I}'), (f"<{E}b>", f"<{E}v>", f'"10"{I}')]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string")
    ask = lambda text: sorted(tuple(r) for r in select_query(spark, parse_query(HEAD + text), triples).collect())
    assert ask("SELECT ?x ?n WHERE { ?x ex:k ?y OPTIONAL { ?y ex:n ?n } }") == [(f"<{E}a>", '"B"@en'), (f"<{E}b>", None)]
    assert set(ask("SELECT ?y WHERE { ex:a ex:k+ ?y }")) == {(f"<{E}b>",), (f"<{E}c>",)}
    assert ask("SELECT (SUM(?v) AS ?s) (COUNT(*) AS ?c) (MAX(?v) AS ?m) (AVG(?v) AS ?a) WHERE { ?x ex:v ?v }") == [(f'"12"{I}', f'"2"{I}', f'"10"{I}', f'"6"{D}')]
    assert ask("SELECT ?x WHERE { ?x ex:v ?v FILTER(?v > 3) }") == [(f"<{E}b>",)]
    assert ask("SELECT ?x WHERE { { ?x ex:n \"A\" } UNION { ?x ^ex:k ex:b } }") == [(f"<{E}a>",), (f"<{E}c>",)]
    assert ask("SELECT ?x WHERE { ?x ex:v ?v FILTER NOT EXISTS { ?x ex:k ex:b } }") == [(f"<{E}b>",)]


def test_turtle():
    triples, prefixes = parse_turtle('@prefix ex: <http://ex.org/> . @base <http://b.org/d/> . ex:a a ex:T ; ex:p "x"@en , 1.5 , true ; ex:l ( 1 [ ex:q <r> ] ) . # c')
    assert len(triples) == 10 and prefixes["ex"] == E and any(getattr(o, "value", "") == "http://b.org/d/r" for _, _, o in triples)
