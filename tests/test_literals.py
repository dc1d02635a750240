import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import literals as L
from graphloom.plans.rdf import XSD, BNode, Literal, Prefixes, is_iri, nt, parse_nt_term
from graphloom.plans.rdf import IRI as Iri

CASES = [
    ("integer", "007", "7"), ("integer", "+7", "7"), ("integer", "-0", "0"), ("integer", " 7 ", None), ("integer", "7.0", None), ("integer", "7\n", None),
    ("decimal", "5000.00", "5000"), ("decimal", "0.50", "0.5"), ("decimal", "+1.50", "1.5"), ("decimal", "-0.0", "0"), ("decimal", ".5", "0.5"), ("decimal", "5.", "5"), ("decimal", "1e3", None), ("decimal", "100", "100"),
    ("double", "1e3", "1000"), ("double", "1.5E3", "1500"), ("double", "-1.25E-2", "-0.0125"), ("double", "-0.0", "-0"), ("double", "1e21", "1" + "0" * 21), ("double", "1e-7", "0.0000001"), ("double", "INF", "INF"), ("double", "NaN", "NaN"), ("double", "x", None),
    ("float", "0.1", "0.1"), ("float", "1.0e0", "1"), ("boolean", "1", "true"), ("boolean", "0", "false"), ("boolean", "TRUE", None),
    ("dateTime", "2019-03-01T09:30:00+00:00", "2019-03-01T09:30:00Z"), ("dateTime", "2019-03-01T09:30:00.250Z", "2019-03-01T09:30:00.25Z"), ("dateTime", "2019-03-01T09:30:00.0Z", "2019-03-01T09:30:00Z"),
    ("dateTime", "2019-03-01T24:00:00", "2019-03-02T00:00:00"), ("dateTime", "2019-12-31T24:00:00Z", "2020-01-01T00:00:00Z"), ("dateTime", "2019-03-01T09:30:00+01:00", "2019-03-01T09:30:00+01:00"),
    ("dateTime", "2020-02-29T00:00:00", "2020-02-29T00:00:00"), ("dateTime", "2019-02-29T00:00:00", None), ("dateTime", "2019-03-01", None), ("date", "2019-03-01+00:00", "2019-03-01+00:00"), ("gYear", "0998", "0998"), ("int", "007", "7"),
]


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_canonical_forms(spark, name):
    own = [c for c in CASES if c[0] == name]
    df = spark.createDataFrame([(c[1],) for c in own], "t string")
    got = [r[0] for r in df.select(L.canonical(F.col("t"), XSD + name)).collect()]
    assert got == [c[2] for c in own]


def test_cells_of_typed_columns(spark):
    df = spark.sql(
        "select 9.0D a, 1e16D b, 0.1D c, 1e-7D d, double('nan') e, timestamp_ntz'2024-01-02 03:04:05.120' f, timestamp'2024-01-02 03:04:05' g, interval '90.5' second h, 1.50BD i, float(0.1) j, true k, date'2024-02-03' l, '  ' m"
    )
    row = df.select(*[L.cell_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(row) == ("9.0", "1e16", "0.1", "1e-7", "NaN", "2024-01-02T03:04:05.120", "2024-01-02T03:04:05Z", "PT90.5S", "1.50", "0.10000000149011612", "true", "2024-02-03", None)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=30))
def test_literals_round_trip(text):
    for term in (Literal(text), Literal(text, XSD + "token"), Literal(text, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en-gb")):
        assert parse_nt_term(nt(term))[0] == term


def test_terms_and_prefixes():
    assert nt(BNode("x")) == "_:x" and nt(Iri("http://a/b")) == "<http://a/b>"
    assert is_iri("http://a/b%20c") and not is_iri("http://a/b c") and not is_iri("a/b") and not is_iri("http://a/%zz") and not is_iri("http://a\n")
    prefixes = Prefixes({"a": "http://a/", "http": "http://no/"})
    assert prefixes.cell("a:b") == "http://a/b" and prefixes.cell("http://x") == "http://x" and prefixes.cell("c:d") == "c:d" and prefixes.cell("plain") == "plain"
    assert prefixes.expand("http://x") == "http://no///x" and prefixes.expand("z:x") is None
