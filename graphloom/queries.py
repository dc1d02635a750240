"""Queries over the driver's tables, one or more per operator, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Mapping
from .bottr.maps import parse_maps, run_map
from .operators import write as sinks
from .ottr.instances import expand_instances
from .ottr.lint import findings_frame
from .ottr.syntax import Library
from .plans.rdf import nt
from .shacl.shapes import NodeShape, PropertyShape, shape_triples
from .shacl.validate import validate
from .sources.rows import number_rows, split_column
from .sparql.dataset import select_query
from .sparql.syntax import parse_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HEAD = """
@prefix ex: <http://example.com/ns#> .
@prefix t: <http://example.com/templates#> .
@prefix ottr: <http://ns.ottr.xyz/0.4/> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix cust: <http://example.com/customer/> .
@prefix part: <http://example.com/part/> .
@prefix ord: <http://example.com/order/> .
"""
PREFIXES = """
PREFIX ex: <http://example.com/ns#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
PREFIX cust: <http://example.com/customer/>
PREFIX part: <http://example.com/part/>
PREFIX ord: <http://example.com/order/>
PREFIX apf: <http://jena.apache.org/ARQ/property#>
PREFIX afn: <http://jena.apache.org/ARQ/function#>
PREFIX fn: <http://www.w3.org/2005/xpath-functions#>
PREFIX spif: <http://spinrdf.org/spif#>
"""
EX = "http://example.com/ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL text of N-Triples terms

def p(local: str) -> str:
    return f"'<{EX}{local}>'"


def esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"


def lit(x: str) -> str:
    return f"'\"' || {esc(x)} || '\"'"


def typed(x: str, dt: str) -> str:
    return f"'\"' || {x} || '\"^^<{XSD}{dt}>'"


def num(x: str) -> str:
    """A double with few digits as a canonical decimal."""
    return f"regexp_replace(cast({x} as varchar), '\\.0$', '')"


def iri(prefix: str, x: str) -> str:
    return f"'<http://example.com/{prefix}/' || {x} || '>'"


def arm(s: str, pr: str, o: str, source: str, where: str = "") -> str:
    return f"select {s} as subject, {pr} as predicate, {o} as object from {source}" + (f" where {where}" if where else "")


def arms(*parts: str) -> str:
    return " union all ".join(parts)


def ottr(name: str, body: str, source: Callable[[SparkSession, str], DataFrame], sql: str | None, templates: str | list[str] = "t:Row", row_id: str | None = None, distinct: bool = False, **options):
    mapping = Mapping.ottr(HEAD + body, templates, **options)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = mapping.triples(source(spark, sf_dir), row_id=row_id)
        return out.distinct() if distinct else out

    query(name, sql)(run)


def sparql(name: str, construct: str, where: str, source: Callable[[SparkSession, str], DataFrame], sql: str | None, row_id: str | None = None, modifiers: str = ""):
    mapping = Mapping.sparql(f"{PREFIXES} CONSTRUCT {{ {construct} }} WHERE {{ {where} }} {modifiers}")
    query(name, sql)(lambda spark, sf_dir: mapping.triples(source(spark, sf_dir), row_id=row_id))


def customers(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), "c_custkey", "c_nationkey")


def parts(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", F.split("p_name", " ").alias("words"), F.split("p_type", " ").alias("kinds"))


def orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("ord:"), "o_orderkey").alias("id"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("cust:"), "o_custkey")).alias("buyer"),
    )


CUSTOMER = "t:Row [ ! ottr:IRI ?id, xsd:string ?name, ? xsd:decimal ?bal, ? xsd:string ?seg ] :: { ottr:Triple(?id, rdf:type, ex:Customer), ottr:Triple(?id, ex:name, ?name), ottr:Triple(?id, ex:balance, ?bal), ottr:Triple(?id, ex:segment, ?seg) } ."
_C = iri("customer", "c_custkey")
CUSTOMER_SQL = arms(
    arm(_C, f"'{RDF_TYPE}'", p("Customer"), "customer"), arm(_C, p("name"), lit("c_name"), "customer"),
    arm(_C, p("balance"), typed(num("c_acctbal"), "decimal"), "customer"), arm(_C, p("segment"), lit("c_mktsegment"), "customer"),
)
ottr("ottr_plain_iri", CUSTOMER, customers, CUSTOMER_SQL)

_P = iri("part", "p_partkey")
ottr(
    "ottr_typed_canonical",
    "t:Row [ ottr:IRI ?id, xsd:integer ?p_size, xsd:decimal ?p_retailprice, xsd:string ?p_brand ] :: { ottr:Triple(?id, ex:size, ?p_size), ottr:Triple(?id, ex:price, ?p_retailprice), ottr:Triple(?id, ex:brand, ?p_brand) } .",
    parts,
    arms(arm(_P, p("size"), typed("p_size", "integer"), "part"), arm(_P, p("price"), typed(num("p_retailprice"), "decimal"), "part"), arm(_P, p("brand"), lit("p_brand"), "part")),
)
_O = iri("order", "o_orderkey")
ottr(
    "ottr_optional_mandatory",
    "t:Row [ ottr:IRI ?id, ? xsd:string ?priority, ? ottr:IRI ?buyer ] :: { ottr:Triple(?id, rdf:type, ex:Order), ottr:Triple(?id, ex:priority, ?priority), t:Bought(?id, ?buyer) } . t:Bought [ ottr:IRI ?o, ottr:IRI ?b ] :: { ottr:Triple(?o, ex:buyer, ?b), ottr:Triple(?o, ex:state, \"bought\") } .",
    orders,
    arms(
        arm(_O, f"'{RDF_TYPE}'", p("Order"), "orders"), arm(_O, p("priority"), lit("o_orderpriority"), "orders", "o_orderstatus = 'F'"),
        arm(_O, p("buyer"), iri("customer", "o_custkey"), "orders", "o_custkey % 3 <> 0"), arm(_O, p("state"), "'\"bought\"'", "orders", "o_custkey % 3 <> 0"),
    ),
)
ottr(
    "ottr_default",
    't:Row [ ottr:IRI ?id, xsd:string ?priority = "none given", ottr:IRI ?buyer = cust:unknown ] :: { ottr:Triple(?id, ex:priority, ?priority), ottr:Triple(?id, ex:buyer, ?buyer) } .',
    orders,
    arms(
        arm(_O, p("priority"), "case when o_orderstatus = 'F' then '\"' || o_orderpriority || '\"' else '\"none given\"' end", "orders"),
        arm(_O, p("buyer"), "case when o_custkey % 3 <> 0 then " + iri("customer", "o_custkey") + " else '<http://example.com/customer/unknown>' end", "orders"),
    ),
)
_B = "'_:b' || c_custkey || 'x1'"
ottr(
    "ottr_bnode_block",
    "t:Row [ ottr:IRI ?id, xsd:string ?name, xsd:integer ?c_nationkey ] :: { ottr:Triple(?id, ex:contact, _:c), ottr:Triple(_:c, ex:name, ?name), ottr:Triple(_:c, ex:nation, ?c_nationkey) } .",
    customers,
    arms(arm(_C, p("contact"), _B, "customer"), arm(_B, p("name"), lit("c_name"), "customer"), arm(_B, p("nation"), typed("c_nationkey", "integer"), "customer")),
    row_id="c_custkey",
)
_WORDS = "(select p_partkey, unnest(string_split(p_name, ' ')) as w from part)"
ottr(
    "ottr_cross",
    "t:Row [ ottr:IRI ?id, ? List<xsd:string> ?words ] :: { cross | t:Word(?id, ++?words) } . t:Word [ ottr:IRI ?x, xsd:string ?w ] :: { ottr:Triple(?x, ex:word, ?w) } .",
    parts,
    f"select distinct * from ({arm(_P, p('word'), lit('w'), _WORDS)})",
)
ottr(
    "ottr_cross_two_lists",
    "t:Row [ ottr:IRI ?id, ? List<xsd:string> ?words, ? List<xsd:string> ?kinds ] :: { cross | t:Pair(?id, ++?words, ++?kinds) } . t:Pair [ ottr:IRI ?x, xsd:string ?w, xsd:string ?k ] :: { ottr:Triple(?x, ex:word, ?w), ottr:Triple(?x, ex:kind, ?k) } .",
    parts,
    f"select distinct * from ({arms(arm(_P, p('word'), lit('w'), _WORDS), arm(_P, p('kind'), lit('w'), _WORDS.replace('p_name', 'p_type')))})",
)
_PAIR = "t:Pair [ ottr:IRI ?x, ? xsd:string ?w, ? xsd:string ?k ] :: { ottr:Triple(?x, ex:pair, _:p), ottr:Triple(_:p, ex:word, ?w), ottr:Triple(_:p, ex:kind, ?k) } ."
for _mode, _size in (("zipMin", "least"), ("zipMax", "greatest")):
    _ROWS = f"(select p_partkey, unnest(range({_size}(len(ws), len(ks)))) as i, ws, ks from (select p_partkey, string_split(p_name, ' ') as ws, string_split(p_type, ' ') as ks from part))"
    _N = "'_:b' || p_partkey || 'x2_r1.' || i"
    ottr(
        f"ottr_{_mode.lower()}",
        f"t:Row [ ottr:IRI ?id, ? List<xsd:string> ?words, ? List<xsd:string> ?kinds ] :: {{ {_mode} | t:Pair(?id, ++?words, ++?kinds) }} . " + _PAIR,
        parts,
        arms(arm(_P, p("pair"), _N, _ROWS), arm(_N, p("word"), lit("ws[i + 1]"), _ROWS, "i < len(ws)"), arm(_N, p("kind"), lit("ks[i + 1]"), _ROWS, "i < len(ks)")),
        row_id="p_partkey",
    )
_L = "(select p_partkey, unnest(range(len(ws))) as i, ws from (select p_partkey, string_split(p_name, ' ') as ws from part))"
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_LN = "'_:b' || p_partkey || 'xl1_' || i"
ottr(
    "ottr_collection",
    "t:Row [ ottr:IRI ?id, ? List<xsd:string> ?words ] :: { ottr:Triple(?id, ex:words, ?words) } .",
    parts,
    arms(
        arm(_P, p("words"), "'_:b' || p_partkey || 'xl1_0'", "part"), arm(_LN, f"'<{_RDF}first>'", lit("ws[i + 1]"), _L),
        arm(_LN, f"'<{_RDF}rest>'", f"case when i = len(ws) - 1 then '<{_RDF}nil>' else '_:b' || p_partkey || 'xl1_' || (i + 1) end", _L),
    ),
    row_id="p_partkey",
)
ottr(
    "ottr_const_expander",
    "t:Row [ ottr:IRI ?id ] :: { cross | t:Typed(?id, ++(ex:Part, ex:Item)), zipMin | t:Tag(?id, ++(ex:a, ex:b), ++(\"x\"@en, \"y\", \"z\")) } . t:Typed [ ottr:IRI ?x, ottr:IRI ?c ] :: { ottr:Triple(?x, rdf:type, ?c) } . t:Tag [ ottr:IRI ?x, ! ottr:IRI ?p, ?o ] :: { ottr:Triple(?x, ?p, ?o) } .",
    parts,
    arms(arm(_P, f"'{RDF_TYPE}'", p("Part"), "part"), arm(_P, f"'{RDF_TYPE}'", p("Item"), "part"), arm(_P, p("a"), "'\"x\"@en'", "part"), arm(_P, p("b"), "'\"y\"'", "part")),
)
ottr(
    "ottr_multi_root",
    "t:A [ ottr:IRI ?id, xsd:string ?p_brand ] :: { ottr:Triple(?id, ex:brand, ?p_brand) } . t:B [ ottr:IRI ?id, xsd:integer ?p_size ] :: { ottr:Triple(?id, ex:size, ?p_size) } .",
    parts,
    arms(arm(_P, p("brand"), lit("p_brand"), "part"), arm(_P, p("size"), typed("p_size", "integer"), "part")),
    templates=["t:A", "t:B"],
)
ottr(
    "ottr_nested_templates",
    "t:Row [ ottr:IRI ?id, xsd:decimal ?p_retailprice, xsd:string ?p_type ] :: { t:Item(?id, ?p_type), t:Priced(?id, ex:offer, ?p_retailprice) } . t:Item [ ottr:IRI ?x, xsd:string ?k ] :: { t:Kind(?x, ?k), ottr:Triple(?x, rdf:type, ex:Item) } . t:Kind [ ottr:IRI ?x, ?k ] :: { ottr:Triple(?x, ex:kind, ?k) } . t:Priced [ ottr:IRI ?x, ! ottr:IRI ?p, xsd:decimal ?v ] :: { ottr:Triple(?x, ?p, ?v) } .",
    parts,
    arms(arm(_P, p("kind"), lit("p_type"), "part"), arm(_P, f"'{RDF_TYPE}'", p("Item"), "part"), arm(_P, p("offer"), typed(num("p_retailprice"), "decimal"), "part")),
)


def bad_iris(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("not an iri "), "event_id")).otherwise(F.concat(F.lit("http://example.com/event/"), "event_id")).alias("id"), F.col("event_type").alias("kind")).coalesce(1).orderBy("event_id")


LEFT_OUT = Mapping.ottr(HEAD + "t:Row [ ottr:IRI ?id, xsd:string ?kind ] :: { ottr:Triple(?id, ex:kind, ?kind) } .", "t:Row")
query("ottr_left_out", "select message from (select 'row ' || (row_number() over (order by event_id)) || ': column id: ''not an iri ' || event_id || ''' is not an IRI' as message, event_id from events) where event_id % 7 = 0")(
    lambda spark, d: LEFT_OUT.left_out(bad_iris(spark, d)).select("message")
)
query("ottr_left_out_kept", arm(iri("event", "event_id"), p("kind"), lit("event_type"), "events", "event_id % 7 <> 0"))(lambda spark, d: LEFT_OUT.triples(bad_iris(spark, d)))
ottr(
    "ottr_lang",
    "t:Row [ ottr:IRI ?id, rdf:langString ?p_name ] :: { ottr:Triple(?id, rdfs:label, ?p_name) } .",
    parts,
    arm(_P, "'<http://www.w3.org/2000/01/rdf-schema#label>'", lit("p_name") + " || '@en'", "part"),
    languages={"p_name": "en"},
)
ottr(
    "ottr_rownum",
    "t:Row [ ottr:IRI ?id, ?ROWNUM ] :: { ottr:Triple(?id, ex:row, ?ROWNUM) } .",
    lambda spark, d: table(spark, d, "region").select(F.concat(F.lit("http://example.com/region/"), "r_regionkey").alias("id"), "r_regionkey").coalesce(1).orderBy("r_regionkey"),
    arm(iri("region", "r_regionkey"), p("row"), typed("(row_number() over (order by r_regionkey) - 1)", "integer"), "region"),
)
ottr(
    "ottr_dates_and_booleans",
    "t:Row [ ottr:IRI ?id, xsd:dateTime ?o_orderdate, xsd:boolean ?open ] :: { ottr:Triple(?id, ex:at, ?o_orderdate), ottr:Triple(?id, ex:open, ?open) } .",
    lambda spark, d: orders(spark, d).withColumn("open", F.col("o_orderstatus") == "O"),
    arms(arm(_O, p("at"), typed("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "dateTime"), "orders"), arm(_O, p("open"), typed("cast(o_orderstatus = 'O' as varchar)", "boolean"), "orders")),
)

# ---- row queries
_LI = "lineitem"
_LS = iri("order", "l_orderkey")


def lineitem(spark, d):
    return table(spark, d, "lineitem")


sparql(
    "sparql_bind_filter",
    "?o ex:quantity ?q ; ex:flag ?l_returnflag",
    'BIND(IRI(CONCAT(STR(ord:), STR(?l_orderkey))) AS ?o) BIND(xsd:decimal(?l_quantity) AS ?q) FILTER(?q > 30 && ?l_returnflag != "N")',
    lineitem,
    arms(arm(_LS, p("quantity"), typed(num("l_quantity"), "decimal"), _LI, "l_quantity > 30 and l_returnflag <> 'N'"), arm(_LS, p("flag"), lit("l_returnflag"), _LI, "l_quantity > 30 and l_returnflag <> 'N'")),
)
sparql(
    "sparql_if_coalesce_bound",
    "?o ex:p ?p ; ex:b ?b ; ex:i ?i",
    'BIND(IRI(CONCAT(STR(ord:), ?o_orderkey)) AS ?o) BIND(COALESCE(?priority, "unknown") AS ?p) BIND(BOUND(?priority) AS ?b) BIND(IF(BOUND(?buyer), IRI(?buyer), ?none) AS ?i)',
    orders,
    arms(
        arm(_O, p("p"), "case when o_orderstatus = 'F' then '\"' || o_orderpriority || '\"' else '\"unknown\"' end", "orders"),
        arm(_O, p("b"), typed("cast(o_orderstatus = 'F' as varchar)", "boolean"), "orders"), arm(_O, p("i"), "'<cust:' || o_custkey || '>'", "orders", "o_custkey % 3 <> 0"),
    ),
)
sparql(
    "sparql_expand_prefix",
    "?o ex:buyer ?b ; ex:space ?s",
    'BIND(tarql:expandPrefixedName(?id) AS ?o) BIND(tarql:expandPrefixedName(?buyer) AS ?b) BIND(tarql:expandPrefix("cust") AS ?s)',
    orders,
    arms(arm(_O, p("buyer"), iri("customer", "o_custkey"), "orders", "o_custkey % 3 <> 0"), arm(_O, p("space"), "'\"http://example.com/customer/\"'", "orders")),
)
_S = {"u": "upper(p_name)", "s": "substring(p_name, 2, 4)", "b": "split_part(p_name, ' ', 1)", "r": "replace(p_name, 'e', '_')", "c": "p_brand || ' ' || p_type"}
sparql(
    "sparql_string_fns",
    "?x ex:u ?u ; ex:s ?s ; ex:b ?b ; ex:r ?r ; ex:c ?c ; ex:n ?n ; ex:h ?h",
    'BIND(IRI(CONCAT(STR(part:), STR(?p_partkey))) AS ?x) BIND(UCASE(?p_name) AS ?u) BIND(SUBSTR(?p_name, 2, 4) AS ?s) BIND(IF(CONTAINS(?p_name, " "), STRBEFORE(?p_name, " "), ?p_name) AS ?b) BIND(REPLACE(?p_name, "e", "_") AS ?r) BIND(CONCAT(?p_brand, " ", ?p_type) AS ?c) BIND(STRLEN(?p_name) AS ?n) BIND(STRSTARTS(?p_type, "S") || STRENDS(?p_type, "L") AS ?h)',
    parts,
    arms(
        *[arm(_P, p(k), lit(v), "part") for k, v in _S.items()], arm(_P, p("n"), typed("length(p_name)", "integer"), "part"),
        arm(_P, p("h"), typed("cast(p_type like 'S%' or p_type like '%L' as varchar)", "boolean"), "part"),
    ),
)
sparql(
    "sparql_date_fns",
    "?o ex:y ?y ; ex:m ?m ; ex:d ?d ; ex:h ?h",
    "BIND(IRI(CONCAT(STR(ord:), ?o_orderkey)) AS ?o) BIND(xsd:dateTime(?o_orderdate) AS ?at) BIND(YEAR(?at) AS ?y) BIND(MONTH(?at) AS ?m) BIND(DAY(?at) AS ?d) BIND(HOURS(?at) AS ?h)",
    orders,
    arms(*[arm(_O, p(k), typed(f"{f}(o_orderdate)", "integer"), "orders") for k, f in (("y", "year"), ("m", "month"), ("d", "day"), ("h", "hour"))]),
)
sparql(
    "sparql_hash_fns",
    "?x ex:md5 ?a ; ex:sha1 ?b ; ex:sha256 ?c",
    "BIND(IRI(CONCAT(STR(part:), ?p_partkey)) AS ?x) BIND(MD5(?p_name) AS ?a) BIND(SHA1(?p_name) AS ?b) BIND(SHA256(?p_name) AS ?c)",
    parts,
    arms(arm(_P, p("md5"), lit("md5(p_name)"), "part"), arm(_P, p("sha1"), lit("sha1(p_name)"), "part"), arm(_P, p("sha256"), lit("sha256(p_name)"), "part")),
)
sparql(
    "sparql_math",
    "?x ex:sum ?a ; ex:product ?b ; ex:negative ?c ; ex:round ?d ; ex:larger ?e",
    "BIND(IRI(CONCAT(STR(part:), ?p_partkey)) AS ?x) BIND(xsd:integer(?p_size) AS ?n) BIND(?n + 7 AS ?a) BIND(?n * 3 AS ?b) BIND(-?n AS ?c) BIND(ROUND(xsd:decimal(?p_retailprice)) AS ?d) BIND(?n >= 25 AS ?e)",
    parts,
    arms(
        arm(_P, p("sum"), typed("(p_size + 7)", "integer"), "part"), arm(_P, p("product"), typed("(p_size * 3)", "integer"), "part"), arm(_P, p("negative"), typed("(-p_size)", "integer"), "part"),
        arm(_P, p("round"), typed("cast(floor(cast(p_retailprice as decimal(18, 4)) + 0.5) as bigint)", "decimal"), "part"), arm(_P, p("larger"), typed("cast(p_size >= 25 as varchar)", "boolean"), "part"),
    ),
)
sparql(
    "sparql_casts",
    "?x ex:i ?i ; ex:d ?d ; ex:bad ?z ; ex:s ?s",
    "BIND(IRI(CONCAT(STR(part:), ?p_partkey)) AS ?x) BIND(xsd:integer(?p_size) AS ?i) BIND(xsd:double(?p_size) AS ?d) BIND(xsd:integer(?p_name) AS ?z) BIND(xsd:string(?i) AS ?s)",
    parts,
    arms(arm(_P, p("i"), typed("p_size", "integer"), "part"), arm(_P, p("d"), typed("p_size", "double"), "part"), arm(_P, p("s"), lit("cast(p_size as varchar)"), "part")),
)
sparql(
    "sparql_regex_replace",
    "?x ex:m ?m ; ex:r ?r",
    'BIND(IRI(CONCAT(STR(part:), ?p_partkey)) AS ?x) BIND(REGEX(?p_type, "^s.*l$", "i") AS ?m) BIND(REPLACE(?p_brand, "[^0-9]+", "") AS ?r)',
    parts,
    arms(arm(_P, p("m"), typed("cast(regexp_matches(lower(p_type), '^s.*l$') as varchar)", "boolean"), "part"), arm(_P, p("r"), lit("regexp_replace(p_brand, '[^0-9]+', '', 'g')"), "part")),
)
sparql(
    "sparql_encode_uri",
    "?x ex:e ?e",
    "BIND(IRI(CONCAT(STR(part:), ENCODE_FOR_URI(?p_name))) AS ?x) BIND(ENCODE_FOR_URI(?url) AS ?e)",
    lambda spark, d: table(spark, d, "pages").select(F.concat(F.lit("page "), "page_id").alias("p_name"), "url"),
    arm("'<http://example.com/part/' || url_encode('page ' || page_id) || '>'", p("e"), lit("url_encode(url)"), "pages"),
)


def nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("r"))


_N = iri("nation", "n_nationkey")
_CONSTANT = "(values ('0', 'zero'), ('1', 'one'), ('1', 'uno')) as v(r, w)"
_JOINED = f"(select * from nation join {_CONSTANT} on cast(n_regionkey as varchar) = v.r)"
_NX = "BIND(IRI(CONCAT(\"http://example.com/nation/\", ?n_nationkey)) AS ?x) "
sparql("sparql_values_join", "?x ex:w ?w", _NX + 'VALUES (?r ?w) { ("0" "zero") ("1" "one") ("1" "uno") }', nations, arm(_N, p("w"), lit("w"), _JOINED))
sparql(
    "sparql_optional", "?x ex:r ?r ; ex:w ?w", _NX + 'OPTIONAL { VALUES (?r ?w) { ("0" "zero") ("1" "one") ("1" "uno") } }', nations,
    arms(
        arm(_N, p("r"), lit("cast(n_regionkey as varchar)"), f"(select nation.* from nation left join {_CONSTANT} on cast(n_regionkey as varchar) = v.r)"), arm(_N, p("w"), lit("w"), _JOINED),
    ),
)
sparql("sparql_minus", "?x ex:r ?r", _NX + 'MINUS { VALUES ?r { "0" "3" } }', nations, arm(_N, p("r"), lit("cast(n_regionkey as varchar)"), "nation", "n_regionkey not in (0, 3)"))
sparql(
    "sparql_union", "?x ex:w ?w", _NX + '{ BIND("first" AS ?w) } UNION { VALUES (?r ?w) { ("2" "two") } }', nations,
    arms(arm(_N, p("w"), "'\"first\"'", "nation"), arm(_N, p("w"), "'\"two\"'", "nation", "n_regionkey = 2")),
)
sparql("sparql_exists", "?x ex:r ?r", _NX + 'FILTER EXISTS { VALUES ?r { "1" "4" } }', nations, arm(_N, p("r"), lit("cast(n_regionkey as varchar)"), "nation", "n_regionkey in (1, 4)"))
sparql("sparql_limit_per_row", "?x ex:w ?w", _NX + 'VALUES ?w { "a" "b" "c" }', nations, arms(*[arm(_N, p("w"), f"'\"{w}\"'", "nation") for w in "ab"]), modifiers="LIMIT 2")
sparql("sparql_order_limit", "?x ex:w ?w", _NX + 'VALUES ?w { "a" "c" "b" }', nations, arms(*[arm(_N, p("w"), f"'\"{w}\"'", "nation") for w in "cb"]), modifiers="ORDER BY DESC(?w) LIMIT 2")
sparql("sparql_offset_per_row", "?x ex:w ?w", _NX + 'VALUES ?w { "a" "a" "b" }', nations, arms(*[arm(_N, p("w"), f"'\"{w}\"'", "nation") for w in "ab"]), modifiers="ORDER BY ?w OFFSET 1 LIMIT 2")
sparql(
    "sparql_group_in_subselect", "?x ex:n ?n", _NX + "{ SELECT (COUNT(*) AS ?n) WHERE { VALUES ?v { 1 2 3 } } }", nations, arm(_N, p("n"), typed("3", "integer"), "nation"),
)
_SPLIT = "(select distinct p_partkey, w from (select p_partkey, unnest(string_split(p_name, ' ')) as w from part))"
sparql("apf_strsplit", "?x ex:word ?w", 'BIND(IRI(CONCAT(STR(part:), ?p_partkey)) AS ?x) ?w apf:strSplit (?p_name " ")', lambda spark, d: parts(spark, d).select("p_partkey", "p_name"), arm(_P, p("word"), lit("w"), "(select p_partkey, unnest(string_split(p_name, ' ')) as w from part)"))
sparql(
    "apf_spliturl", "?u ex:ns ?ns ; ex:ln ?ln", "BIND(IRI(?url) AS ?u) ?u apf:splitIRI (?ns ?ln)", lambda spark, d: table(spark, d, "pages").select("url"),
    arms(arm("'<' || url || '>'", p("ns"), "'<' || regexp_replace(url, '[A-Za-z_][A-Za-z0-9_.\\-]*$', '') || '>'", "pages"), arm("'<' || url || '>'", p("ln"), "'\"' || regexp_extract(url, '[A-Za-z_][A-Za-z0-9_.\\-]*$') || '\"'", "pages")),
)
sparql("apf_concat_assign", "?x ex:c ?c ; ex:a ?a", 'BIND(IRI(CONCAT(STR(part:), ?p_partkey)) AS ?x) ?c apf:concat (?p_brand "-" ?p_type) . ?a apf:assign ?p_brand', lambda spark, d: parts(spark, d).select("p_partkey", "p_brand", "p_type"), arms(arm(_P, p("c"), lit("p_brand || '-' || p_type"), "part"), arm(_P, p("a"), lit("p_brand"), "part")))
sparql(
    "afn_functions", "?x ex:j ?j ; ex:s ?s ; ex:h ?h ; ex:m ?m ; ex:l ?l",
    'BIND(IRI(CONCAT("http://example.com/part#p", ?p_partkey)) AS ?x) BIND(afn:strjoin("/", ?p_brand, ?p_type) AS ?j) BIND(afn:substr(?p_name, 1, 3) AS ?s) BIND(afn:sha1sum(?p_name) AS ?h) BIND(afn:max(xsd:integer(?p_size), 10) AS ?m) BIND(afn:localname(?x) AS ?l)',
    parts,
    (lambda x: arms(
        arm(x, p("j"), lit("p_brand || '/' || p_type"), "part"), arm(x, p("s"), lit("substring(p_name, 2, 2)"), "part"), arm(x, p("h"), lit("sha1(p_name)"), "part"),
        arm(x, p("m"), typed("greatest(p_size, 10)", "integer"), "part"), arm(x, p("l"), lit("'p' || p_partkey"), "part"),
    ))("'<http://example.com/part#p' || p_partkey || '>'"),
)
sparql(
    "fn_spif_functions", "?x ex:u ?u ; ex:t ?t ; ex:i ?i ; ex:n ?n",
    'BIND(IRI(CONCAT(STR(part:), ?p_partkey)) AS ?x) BIND(fn:upper-case(?p_name) AS ?u) BIND(spif:titleCase(LCASE(?p_type)) AS ?t) BIND(spif:indexOf(?p_name, "e") AS ?i) BIND(fn:normalize-space(CONCAT("  ", ?p_name, "  x ")) AS ?n)',
    parts,
    arms(
        arm(_P, p("u"), lit("upper(p_name)"), "part"), arm(_P, p("t"), lit("list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ')"), "part"),
        arm(_P, p("i"), typed("(strpos(p_name, 'e') - 1)", "integer"), "part", "strpos(p_name, 'e') > 0"), arm(_P, p("n"), lit("p_name || ' x'"), "part"),
    ),
)

# ---- sources and sinks
query("split_explode", "select event_id, w from (select event_id, unnest(string_split(event_type || ';' || user_id, ';')) as w from events)")(
    lambda spark, d: split_column(table(spark, d, "events").select("event_id", F.concat_ws(";", "event_type", "user_id").alias("s")), "s", "w", ";").select("event_id", "w")
)
query("row_numbers", "select event_id, event_id - (select min(event_id) from events) as n from events")(
    lambda spark, d: number_rows(table(spark, d, "events").select("event_id").orderBy("event_id"), "n").select("event_id", F.col("n"))
)
_DUP = Mapping.ottr(HEAD + "t:Row [ ottr:IRI ?kind, xsd:string ?name ] :: { ottr:Triple(?kind, ex:name, ?name), ottr:Triple(?kind, ex:name, ?name), ottr:Triple(?kind, rdf:type, ex:Kind) } .", "t:Row")


def kinds(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("http://example.com/kind/"), "event_type").alias("kind"), F.col("event_type").alias("name"))


_K = iri("kind", "event_type")
_DUP_SQL = arms(arm(_K, p("name"), lit("event_type"), "events"), arm(_K, f"'{RDF_TYPE}'", p("Kind"), "events"))
query("dedup_row", _DUP_SQL)(lambda spark, d: _DUP.triples(kinds(spark, d)))
query("dedup_global", f"select distinct * from ({_DUP_SQL})")(lambda spark, d: _DUP.triplify(kinds(spark, d)))
_NAME = Mapping.ottr(HEAD + "t:Row [ ottr:IRI ?id, xsd:string ?s_name ] :: { ottr:Triple(?id, ex:name, ?s_name), ottr:Triple(?id, rdf:type, ex:Supplier) } .", "t:Row")


def suppliers(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("http://example.com/supplier/"), "s_suppkey").alias("id"), "s_name")


_SU = iri("supplier", "s_suppkey")
_SUP_SQL = arms(arm(_SU, p("name"), lit("s_name"), "supplier"), arm(_SU, f"'{RDF_TYPE}'", p("Supplier"), "supplier"))
query("ntriples_lines", f"select subject || ' ' || predicate || ' ' || object || ' .' as value from ({_SUP_SQL})")(lambda spark, d: sinks.lines(_NAME.triples(suppliers(spark, d))))
query("nquads_lines", f"select subject || ' ' || predicate || ' ' || object || ' <http://example.com/g> .' as value from ({_SUP_SQL})")(lambda spark, d: sinks.lines(_NAME.triples(suppliers(spark, d)), "nquads", "http://example.com/g"))
query("turtle_subject_groups", f"select {_SU} || ' ex:name ' || {lit('s_name')} || ' ;' || chr(10) || '    a ex:Supplier .' as value from supplier")(lambda spark, d: sinks.turtle_subjects(_NAME.triples(suppliers(spark, d)), _NAME.prefixes))
_PRUNED = Mapping.ottr(HEAD + CUSTOMER, "t:Row")
query("pattern_pruning", arm(_C, p("name"), lit("c_name"), "customer"))(lambda spark, d: _PRUNED.triples(customers(spark, d), predicates=[EX + "name"], classes=[]))

# ---- instance maps
_MAP_HEAD = "@prefix ottr: <http://ns.ottr.xyz/0.4/> . @prefix ex: <http://example.com/ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
_PAIR_LIB = HEAD + "t:P [ ottr:IRI ?id, ? ?v ] :: { ottr:Triple(?id, ex:v, ?v) } . t:L [ ottr:IRI ?id, ? List<xsd:string> ?v ] :: { cross | t:P(?id, ++?v) } ."


def bottr(name: str, argument: str, value: Callable[[], object], o: str, where: str = "", template: str = "t:P"):
    library = Library.load(_PAIR_LIB)
    text = _MAP_HEAD + f'@prefix t: <http://example.com/templates#> . [] a ottr:InstanceMap ; ottr:template {template} ; ottr:source [ a ottr:H2Source ] ; ottr:query "given" ; ottr:argumentMaps ( [ ottr:type ottr:IRI ] [ {argument} ] ) .'
    m = parse_maps(text)[0]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey"), value().cast("string"))
        return run_map(spark, library, m, 0, rows)[0]

    query(name, arm(_C, p("v"), o, "customer", where))(run)


bottr("bottr_null_value", "ottr:nullValue ex:Unknown", lambda: F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), f"case when c_custkey % 2 = 0 then {lit('c_name')} else {p('Unknown')} end")
bottr("bottr_translation", 'ottr:translationTable [ ottr:entry [ ottr:inValue "BUILDING" ; ottr:outValue ex:Building ] , [ ottr:inValue "MACHINERY" ; ottr:outValue ottr:none ] ]', lambda: F.col("c_mktsegment"), f"case when c_mktsegment = 'BUILDING' then {p('Building')} else {lit('c_mktsegment')} end", "c_mktsegment <> 'MACHINERY'")
bottr("bottr_bool_words", 'ottr:type xsd:boolean ; ottr:booleanTrue ( "yes" ) ; ottr:booleanFalse ( "no" )', lambda: F.when(F.col("c_custkey") % 3 == 0, F.lit("yes")).when(F.col("c_custkey") % 3 == 1, F.lit("no")).otherwise(F.lit("maybe")), typed("case when c_custkey % 3 = 0 then 'true' else 'false' end", "boolean"), "c_custkey % 3 <> 2")
bottr("bottr_lang_sep", 'ottr:languageTagSep "@"', lambda: F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@en"))), lit("c_name") + " || '@en'", "c_custkey % 4 <> 0")
bottr("bottr_datatype_sep", 'ottr:datatypeSep "^^"', lambda: F.concat(F.col("c_custkey").cast("string"), F.lit("^^xsd:int")), typed("c_custkey", "int"))
bottr("bottr_typed_as_written", "ottr:type xsd:integer", lambda: F.concat(F.lit("00"), F.col("c_custkey").cast("string")), typed("'00' || c_custkey", "integer"))
bottr("bottr_list", 'ottr:type ( rdf:List xsd:string ) ; ottr:listSep ";"', lambda: F.concat("c_name", F.lit("; "), "c_mktsegment"), lit("w"), template="t:L")
ORACLE_SQL["bottr_list"] = arm(_C, p("v"), lit("w"), "(select c_custkey, unnest([c_name, c_mktsegment]) as w from customer)")

# ---- datasets
def places(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit(f"<{EX}n"), "n_nationkey", F.lit(">")).alias("s"), "n_name", F.concat(F.lit(f"<{EX}r"), "n_regionkey", F.lit(">")).alias("r"))
    r = table(spark, d, "region").select(F.concat(F.lit(f"<{EX}r"), "r_regionkey", F.lit(">")).alias("s"), "r_name")
    t = lambda df, s, pr, o: df.select(F.col(s).alias("subject"), F.lit(f"<{EX}{pr}>").alias("predicate"), o.alias("object"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return t(n, "s", "name", quoted("n_name")).union(t(n, "s", "in", F.col("r"))).union(t(r.filter("r_name <> 'ASIA'"), "s", "name", quoted("r_name")))


def dataset(name: str, text: str, sql: str):
    parsed = parse_query(PREFIXES + text)
    query(name, sql)(lambda spark, d: select_query(spark, parsed, places(spark, d)))


_NR = f"'<{EX}n' || n_nationkey || '>'"
_BOTH = "nation join region on n_regionkey = r_regionkey"
dataset("rdf_bgp_join", "SELECT ?n ?name ?region WHERE { ?n ex:in ?r ; ex:name ?name . ?r ex:name ?region }", f"select {_NR} as n, {lit('n_name')} as name, {lit('r_name')} as region from {_BOTH} where r_name <> 'ASIA'")
dataset("rdf_optional", "SELECT ?n ?region WHERE { ?n ex:in ?r OPTIONAL { ?r ex:name ?region } }", f"select {_NR} as n, case when r_name <> 'ASIA' then {lit('r_name')} end as region from {_BOTH}")
dataset("rdf_filter_path", "SELECT ?n WHERE { ?n ex:in/ex:name ?region FILTER(?region = \"EUROPE\") }", f"select {_NR} as n from {_BOTH} where r_name = 'EUROPE'")
dataset("rdf_minus", "SELECT ?n WHERE { ?n ex:in ?r MINUS { ?r ex:name ?x } }", f"select {_NR} as n from {_BOTH} where r_name = 'ASIA'")
dataset("rdf_count_by_group", "SELECT ?r (COUNT(?n) AS ?c) WHERE { ?n ex:in ?r } GROUP BY ?r", f"select '<{EX}r' || n_regionkey || '>' as r, {typed('count(*)', 'integer')} as c from nation group by n_regionkey")
dataset("rdf_order_limit", "SELECT ?name WHERE { ?n ex:in ?r ; ex:name ?name } ORDER BY ?name LIMIT 5", f"select {lit('n_name')} as name from nation order by n_name limit 5")

# ---- shapes
def order_graph(spark, d):
    o = table(spark, d, "orders")
    s = F.concat(F.lit(f"<{EX}o"), "o_orderkey", F.lit(">"))
    t = lambda df, pr, v: df.select(s.alias("subject"), F.lit(pr).alias("predicate"), v.alias("object"))
    c = F.concat(F.lit(f"<{EX}c"), "o_custkey", F.lit(">"))
    out = t(o, RDF_TYPE, F.lit(f"<{EX}Order>")).union(t(o.filter("o_orderkey % 5 <> 0"), f"<{EX}total>", F.concat(F.lit('"'), F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string")), F.lit(f'"^^<{XSD}integer>'))))
    return out.union(t(o, f"<{EX}buyer>", c)).union(o.filter("o_custkey % 2 = 0").select(c.alias("subject"), F.lit(RDF_TYPE).alias("predicate"), F.lit(f"<{EX}Customer>").alias("object")))


ORDER_SHAPE = [NodeShape(EX + "Order", None, {EX + "total": PropertyShape(EX + "total", 1, {XSD + "integer"}, {"lit"}), EX + "buyer": PropertyShape(EX + "buyer", 1, set(), {"iri"}, {EX + "Customer"})})]
_OF = f"'<{EX}o' || o_orderkey || '>'"
for _name, _constraint, _sql in (
    ("shacl_mincount", "minCount", f"select {_OF} as focus, cast(null as varchar) as value from orders where o_orderkey % 5 = 0"),
    ("shacl_datatype", "datatype", f"select {_OF} as focus, '\"x\"^^<{XSD}integer>' as value from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 = 0"),
    ("shacl_class", "class", f"select {_OF} as focus, '<{EX}c' || o_custkey || '>' as value from orders where o_custkey % 2 <> 0"),
):
    query(_name, _sql)(lambda spark, d, c=_constraint: validate(order_graph(spark, d), ORDER_SHAPE).filter(F.col("constraint") == c).select("focus", "value"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    text = HEAD + "t:A [ ottr:IRI ?x, ?unused ] :: { t:Missing(?x), t:B(?x, ?x) } . t:B [ xsd:integer ?n ] :: { t:B(?n) } ."
    return findings_frame(spark, Library.load(text))


_T = "http://example.com/templates#"
query(
    "lint_findings",
    f"select * from (values ('error', 'arity', '{_T}A', '<{_T}B> takes 1 arguments, not 2'), ('error', 'undefined-template', '{_T}A', '<{_T}Missing> is not defined'), "
    f"('warning', 'unused-parameter', '{_T}A', '?unused is not used'), ('error', 'cycle', '{_T}B', 'uses itself')) as v(severity, \"check\", template, message)",
)(findings)
_SHAPE = [
    ("<urn:shapes:shape0>", RDF_TYPE, "<http://www.w3.org/ns/shacl#NodeShape>"), ("<urn:shapes:shape0>", "targetClass", f"<{EX}Customer>"), *[("<urn:shapes:shape0>", "property", f"_:p{i}") for i in (1, 2, 3, 4)],
    *[(f"_:p{i}", "path", x) for i, x in enumerate((f"<{EX}balance>", f"<{EX}name>", f"<{EX}segment>", RDF_TYPE), 1)], *[(f"_:p{i}", "datatype", f"<{XSD}{x}>") for i, x in ((1, "decimal"), (2, "string"), (3, "string"))],
    *[(f"_:p{i}", "minCount", f'"1"^^<{XSD}integer>') for i in (2, 4)], ("_:p4", "nodeKind", "<http://www.w3.org/ns/shacl#IRI>"),
]
ORACLE_SQL["shapes_table"] = "select * from (values " + ", ".join(f"('{s}', '{x if x.startswith('<') else f'<http://www.w3.org/ns/shacl#{x}>'}', '{o}')" for s, x, o in _SHAPE) + ") as v(subject, predicate, object)"
QUERIES["shapes_table"] = lambda spark, d: spark.createDataFrame([tuple(nt(t) for t in x) for x in shape_triples(_PRUNED.shapes())], "subject string, predicate string, object string")
query("expand_instances", f"select '<{EX}a>' as subject, '<{EX}name>' as predicate, '\"Ann\"' as object union all select '<{EX}b>', '<{EX}name>', '\"Bob\"'")(
    lambda spark, d: expand_instances(spark, Library.load(HEAD + "t:N [ ottr:IRI ?x, xsd:string ?n ] :: { ottr:Triple(?x, ex:name, ?n) } ."), HEAD + '\nt:N(ex:a, "Ann") . t:N(ex:b, "Bob") . t:N(ex:c, none) .')
)

# ---- more functions, over larger tables
_E = iri("event", "event_id")
sparql(
    "sparql_time_parts",
    "?e ex:min ?m ; ex:sec ?s ; ex:tz ?z",
    'BIND(IRI(CONCAT("http://example.com/event/", STR(?event_id))) AS ?e) BIND(xsd:dateTime(?at) AS ?t) BIND(MINUTES(?t) AS ?m) BIND(xsd:integer(SECONDS(?t)) AS ?s) BIND(TZ(?t) AS ?z)',
    lambda spark, d: table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")),
    arms(arm(_E, p("min"), typed("minute(ts)", "integer"), "events"), arm(_E, p("sec"), typed("second(ts)", "integer"), "events"), arm(_E, p("tz"), "'\"Z\"'", "events")),
)
_LN2 = iri("line", "l_orderkey || '-' || l_linenumber")
sparql(
    "sparql_division_rounding",
    "?o ex:half ?h ; ex:up ?u ; ex:down ?d ; ex:size ?a",
    'BIND(IRI(CONCAT("http://example.com/line/", STR(?l_orderkey), "-", STR(?l_linenumber))) AS ?o) BIND(xsd:integer(?l_linenumber) AS ?n) BIND(?n / 4 AS ?h) BIND(CEIL(?h) AS ?u) BIND(FLOOR(?h) AS ?d) BIND(ABS(2 - ?n) AS ?a)',
    lineitem,
    arms(
        arm(_LN2, p("half"), typed(num("l_linenumber / 4.0"), "decimal"), _LI), arm(_LN2, p("up"), typed("cast(ceil(l_linenumber / 4.0) as bigint)", "decimal"), _LI),
        arm(_LN2, p("down"), typed("cast(floor(l_linenumber / 4.0) as bigint)", "decimal"), _LI), arm(_LN2, p("size"), typed("abs(2 - l_linenumber)", "integer"), _LI),
    ),
)
sparql(
    "sparql_term_fns",
    "?o ex:l ?a ; ex:t ?b ; ex:lang ?c ; ex:dt ?d ; ex:iri ?e ; ex:in ?f ; ex:same ?g",
    'BIND(IRI(CONCAT(STR(ord:), ?o_orderkey)) AS ?o) BIND(STRLANG(?o_orderpriority, "en") AS ?a) BIND(STRDT(STR(?o_custkey), ex:code) AS ?b) BIND(LANG(?a) AS ?c) BIND(DATATYPE(?b) AS ?d) BIND(isIRI(?o) && !isIRI(?a) && isLiteral(?b) AS ?e) BIND(?o_orderstatus IN ("F", "P") AS ?f) BIND(sameTerm(?o_orderstatus, "O") AS ?g)',
    orders,
    arms(
        arm(_O, p("l"), lit("o_orderpriority") + " || '@en'", "orders"), arm(_O, p("t"), f"'\"' || o_custkey || '\"^^<{EX}code>'", "orders"), arm(_O, p("lang"), "'\"en\"'", "orders"), arm(_O, p("dt"), p("code"), "orders"),
        arm(_O, p("iri"), typed("'true'", "boolean"), "orders"), arm(_O, p("in"), typed("cast(o_orderstatus in ('F', 'P') as varchar)", "boolean"), "orders"), arm(_O, p("same"), typed("cast(o_orderstatus = 'O' as varchar)", "boolean"), "orders"),
    ),
)


def line_graph(spark, d):
    """Each order's lines: their number and flag."""
    o, n = F.concat(F.lit(f"<{EX}o"), "l_orderkey", F.lit(">")), F.concat(F.lit(f"<{EX}o"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit(">"))
    t = lambda s, pr, v: lineitem(spark, d).select(s.alias("subject"), F.lit(f"<{EX}{pr}>").alias("predicate"), v.alias("object"))
    return t(o, "line", n).union(t(n, "number", F.concat(F.lit('"'), "l_linenumber", F.lit(f'"^^<{XSD}integer>')))).union(t(n, "flag", F.concat(F.lit('"'), "l_returnflag", F.lit('"')))).distinct()


_LO = f"'<{EX}o' || l_orderkey || '>'"
_AGGREGATES = parse_query(PREFIXES + "SELECT ?o (SUM(?n) AS ?s) (MIN(?n) AS ?low) (MAX(?n) AS ?high) (COUNT(DISTINCT ?f) AS ?c) WHERE { ?o ex:line ?l . ?l ex:number ?n ; ex:flag ?f } GROUP BY ?o")
query("rdf_aggregates", f"select {_LO} as o, {typed('sum(l_linenumber)', 'integer')} as s, {typed('min(l_linenumber)', 'integer')} as low, {typed('max(l_linenumber)', 'integer')} as high, {typed('count(distinct l_returnflag)', 'integer')} as c from (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem) group by l_orderkey")(
    lambda spark, d: select_query(spark, _AGGREGATES, line_graph(spark, d))
)
_NESTED = Library.load(_PAIR_LIB)
_NESTED_MAP = parse_maps(_MAP_HEAD + '@prefix t: <http://example.com/templates#> . [] a ottr:InstanceMap ; ottr:template t:L ; ottr:source [ a ottr:H2Source ] ; ottr:query "given" ; ottr:argumentMaps ( [ ottr:type ottr:IRI ] [ ottr:type ( rdf:List xsd:string ) ; ottr:listSep "; " ] ) .')[0]


def bracket_cells(spark, d):
    """Lists in brackets, some of which do not match: those rows are left out."""
    cell = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("("), "c_name", F.lit("; "), "c_mktsegment", F.lit(")"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("("), "c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey"), cell)


query(
    "bottr_bracket_lists",
    arms(arm(_C, p("v"), lit("w"), "(select c_custkey, unnest([c_name, c_mktsegment]) as w from customer where c_custkey % 3 = 0)"), arm(_C, p("v"), lit("c_mktsegment"), "customer", "c_custkey % 3 = 2")),
)(lambda spark, d: run_map(spark, _NESTED, _NESTED_MAP, 0, bracket_cells(spark, d))[0])
LIMITED_SHAPE = [NodeShape(EX + "Order", None, {EX + "total": PropertyShape(EX + "total", pattern=("^[1-9]+$", "")), EX + "buyer": PropertyShape(EX + "buyer", max_count=0)})]
query("shacl_pattern", f"select {_OF} as focus, '\"' || case when o_orderkey % 7 = 0 then 'x' else cast(o_custkey as varchar) end || '\"^^<{XSD}integer>' as value from orders where o_orderkey % 5 <> 0 and (o_orderkey % 7 = 0 or not regexp_matches(cast(o_custkey as varchar), '^[1-9]+$'))")(
    lambda spark, d: validate(order_graph(spark, d), LIMITED_SHAPE).filter("constraint = 'pattern'").select("focus", "value")
)
query("shacl_maxcount", f"select {_OF} as focus, cast(null as varchar) as value from orders")(lambda spark, d: validate(order_graph(spark, d), LIMITED_SHAPE).filter("constraint = 'maxCount'").select("focus", "value"))

# ---- the order-line mapping of the benchmark
ORDER_LINE = """
t:Row [ ottr:IRI ?order, xsd:dateTime ?shipped, xsd:integer ?line, ottr:IRI ?part, ? ottr:IRI ?supplier, xsd:decimal ?quantity, ? xsd:decimal ?price, ? xsd:decimal ?discount, ? xsd:decimal ?tax, ? xsd:string ?flag, ? xsd:string ?status ] :: {
  ottr:Triple(?order, rdf:type, ex:Order), ottr:Triple(?order, ex:line, _:l), t:Line(_:l, ?line, ?part, ?supplier, ?quantity, ?discount, ?tax), t:Price(_:l, ?price), ottr:Triple(_:l, ex:flag, ?flag), ottr:Triple(_:l, ex:status, ?status), ottr:Triple(_:l, ex:shipped, ?shipped)
} .
t:Line [ ottr:IRI ?l, xsd:integer ?n, ottr:IRI ?p, ? ottr:IRI ?s, xsd:decimal ?q, ? xsd:decimal ?d, ? xsd:decimal ?t ] :: {
  ottr:Triple(?l, rdf:type, ex:Line), ottr:Triple(?l, ex:number, ?n), ottr:Triple(?l, ex:part, ?p), ottr:Triple(?l, ex:supplier, ?s), ottr:Triple(?l, ex:quantity, ?q), ottr:Triple(?l, ex:discount, ?d), ottr:Triple(?l, ex:tax, ?t)
} .
t:Price [ ottr:IRI ?l, xsd:decimal ?v ] :: { ottr:Triple(?l, ex:price, ?v) } .
"""
ORDER_LINES = Mapping.ottr(HEAD + ORDER_LINE, "t:Row")


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("ord:"), "l_orderkey").alias("order"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_shipdate").alias("shipped"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("part:"), "l_partkey").alias("part"), F.concat(F.lit("http://example.com/supplier/"), "l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


query("order_lines_by_predicate", None)(lambda spark, d: ORDER_LINES.triples(order_lines(spark, d), row_id="key").groupBy("predicate").agg(F.count(F.lit(1)).alias("n")))
ORACLE_SQL["order_lines_by_predicate"] = arms(
    *[f"select '<{EX}{x}>' as predicate, count(*) as n from lineitem" for x in ("line", "flag", "status", "shipped", "number", "part", "supplier", "quantity", "discount", "tax", "price")],
    f"select '{RDF_TYPE}' as predicate, 2 * count(*) as n from lineitem",
)
