"""SPARQL 1.1 queries and Turtle documents: one tokenizer, two parsers.

A group is a list of elements, tuples headed by bind, filter, values, optional, union, minus, group,
triples, graph, service or select.  An expression is ("term", t), ("var", name), ("call", name, args) or
("exists", group); built-in names are lower case, other functions are IRIs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

from graphloom.plans.rdf import BOOLEAN, DECIMAL, DOUBLE, FIRST, INTEGER, IRI, LANG_STRING, NIL, REST, TYPE, BNode, Literal, Prefixes, Var, unescaped

_NAME_CHAR = r"[\w\-·]"
_TOKEN = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{{}}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{{}}|^`\\\x00-\x20]*)*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<bnode>_:[\w](?:[\w.\-·]*{_NAME_CHAR})?)
    |(?P<var>[?$][\w]+)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*{_NAME_CHAR})?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-:·]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:·]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z_][\w]*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[\[\]{{}}().,;=<>!+\-*/|^?])""",
    re.X | re.S,
)


class SyntaxProblem(ValueError):
    """A query or document that cannot be read or is refused."""


@dataclass
class Select:
    items: list  # [(expression or None, variable)]; empty: all
    where: list
    distinct: bool = False
    group: list = field(default_factory=list)  # [(expression, variable or None)]
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # [(ascending, expression)]
    limit: int | None = None
    offset: int = 0
    values: tuple | None = None


@dataclass
class Query:
    form: str  # construct or select
    prefixes: Prefixes
    base: str
    template: list  # [(s, p, o)]
    select: Select
    source: str | None = None
    text: str = ""
    variables: frozenset = frozenset()


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"line {text.count(chr(10), 0, at) + 1}: cannot read {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    out.append(("end", "", at))
    return out


BUILT_IN = set(
    "str lang langmatches datatype iri uri bnode rand abs ceil floor round concat substr strlen replace ucase lcase encode_for_uri contains strstarts strends strbefore strafter "
    "year month day hours minutes seconds timezone tz now uuid struuid md5 sha1 sha256 sha384 sha512 strlang strdt sameterm isiri isuri isblank isliteral isnumeric regex bound if coalesce".split()
)
AGGREGATES = {"count", "sum", "min", "max", "avg", "sample", "group_concat"}
REFUSED = {"lang_dir", "haslang", "haslangdir", "strlangdir", "triple", "subject", "predicate", "object", "istriple"}


class Reader:
    """Terms and triples, as Turtle and SPARQL share them."""

    variables = True

    def __init__(self, text: str, base: str = "", prefixes: Prefixes | None = None):
        self.text, self.tokens, self.i = text, tokens(text), 0
        self.prefixes, self.base = Prefixes(prefixes or {}), base
        self.fresh = 0

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.tokens[self.i][2]) + 1
        raise SyntaxProblem(f"line {line}: {what}, found {self.value or 'the end'!r}")

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def take(self, value: str) -> str:
        if self.value.lower() != value.lower() or self.kind in ("string", "iri"):
            self.fail(f"expected {value}")
        return self.next()

    def word(self, *words: str) -> bool:
        return self.kind == "word" and self.value.lower() in words

    def maybe(self, value: str) -> bool:
        if self.kind in ("op", "word") and self.value.lower() == value.lower():
            self.i += 1
            return True
        return False

    def resolve(self, iri: str) -> str:
        iri = unescaped(iri)
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) or not self.base:
            return iri
        return urljoin(self.base, iri)

    def iri(self) -> IRI:
        if self.kind == "iri":
            return IRI(self.resolve(self.next()[1:-1]))
        if self.kind == "name":
            full = self.prefixes.expand(re.sub(r"\\(.)", r"\1", self.value))
            if full is None:
                self.fail("the prefix is not declared")
            self.i += 1
            return IRI(full)
        self.fail("expected an IRI")

    def literal(self) -> Literal:
        raw = self.next()
        text = unescaped(raw[3:-3] if raw[:3] in ('"""', "'''") else raw[1:-1])
        if self.kind == "lang":
            return Literal(text, LANG_STRING, self.next()[1:].lower())
        if self.kind == "op" and self.value == "^^":
            self.i += 1
            return Literal(text, self.iri().value)
        return Literal(text)

    def number(self, sign: str = "") -> Literal:
        raw = self.next()
        return Literal(sign + raw, DOUBLE if "e" in raw.lower() else DECIMAL if "." in raw else INTEGER)

    def new_bnode(self) -> BNode:
        self.fresh += 1
        return BNode(f" {self.fresh}")

    def node(self, triples: list):
        """A subject or object; triples of [..] and (..) are added."""
        if self.kind == "var" and self.variables:
            return Var(self.next()[1:])
        if self.kind == "bnode":
            return BNode(self.next()[2:])
        if self.kind == "string":
            return self.literal()
        if self.kind == "number":
            return self.number()
        if self.kind == "op" and self.value in "+-" and self.tokens[self.i + 1][0] == "number":
            return self.number(self.next().replace("+", "+"))
        if self.word("true", "false"):
            return Literal(self.next().lower(), BOOLEAN)
        if self.kind == "op" and self.value == "[":
            self.i += 1
            node = self.new_bnode()
            if self.value != "]":
                self.properties(node, triples)
            self.take("]")
            return node
        if self.kind == "op" and self.value == "(":
            self.i += 1
            items = []
            while self.value != ")":
                items.append(self.node(triples))
            self.take(")")
            head = IRI(NIL)
            for item in reversed(items):
                node = self.new_bnode()
                triples += [(node, IRI(FIRST), item), (node, IRI(REST), head)]
                head = node
            return head
        return self.iri()

    def verb(self):
        if self.word("a"):
            self.i += 1
            return IRI(TYPE)
        if self.kind == "var" and self.variables:
            return Var(self.next()[1:])
        return self.iri()

    def properties(self, subject, triples: list) -> None:
        while True:
            verb = self.verb()
            while True:
                triples.append((subject, verb, self.node(triples)))
                if not self.maybe(","):
                    break
            if not self.maybe(";"):
                return
            while self.maybe(";"):
                pass
            if self.value in (".", "]", "}") or self.kind == "end" or self.word("bind", "filter", "optional", "minus", "values", "graph", "service"):
                return

    def subject_triples(self, triples: list) -> None:
        bracket = self.kind == "op" and self.value in "[("
        subject = self.node(triples)
        if bracket and (self.value in (".", "}", "{") or self.kind == "end"):
            return
        self.properties(subject, triples)

    def prologue(self) -> None:
        while True:
            low = self.value.lower()
            if low not in ("prefix", "base", "@prefix", "@base"):
                return
            self.i += 1
            if low.endswith("prefix"):
                if self.kind != "name":
                    self.fail("expected a prefix")
                prefix = self.next()[:-1]
                self.prefixes[prefix] = self.resolve(self.next()[1:-1])
            else:
                self.base = self.resolve(self.next()[1:-1])
            if low.startswith("@"):
                self.take(".")


class Turtle(Reader):
    """A Turtle (or N-Triples) document as triples."""

    variables = False

    def parse(self) -> list:
        triples: list = []
        while self.kind != "end":
            self.prologue()
            if self.kind == "end":
                break
            self.subject_triples(triples)
            self.take(".")
        return triples


class QueryParser(Reader):
    def parse(self, default_prefixes: bool = True) -> Query:
        self.prologue()
        if self.word("construct"):
            self.i += 1
            template: list = []
            if self.word("where"):  # the short form: the group is the template
                self.i += 1
                where = self.group()
                if any(e[0] != "triples" for e in where):
                    raise SyntaxProblem("CONSTRUCT WHERE takes triples only")
                template = [t for e in where for t in e[1]]
                query = Query("construct", self.prefixes, self.base, template, self.modifiers(Select([], where)), None, self.text)
                query.variables = frozenset(value[1:] for kind, value, _ in self.tokens if kind == "var")
                return query
            self.take("{")
            while self.value != "}":
                self.subject_triples(template)
                self.maybe(".")
            self.take("}")
            source = self.dataset()
            self.maybe("where")
            select = self.modifiers(Select([], self.group()))
            query = Query("construct", self.prefixes, self.base, template, select, source, self.text)
        elif self.word("select"):
            query = Query("select", self.prefixes, self.base, [], self.select(), None, self.text)
        else:
            self.fail("expected CONSTRUCT or SELECT")
        if self.kind != "end":
            self.fail("expected the end of the query")
        query.variables = frozenset(value[1:] for kind, value, _ in self.tokens if kind == "var")
        return query

    def dataset(self) -> str | None:
        source = None
        while self.maybe("from"):
            self.maybe("named")
            source = source or self.iri().value
        return source

    def select(self) -> Select:
        self.take("select")
        out = Select([], [])
        out.distinct = self.maybe("distinct") or self.maybe("reduced")
        if not self.maybe("*"):
            while True:
                if self.kind == "var":
                    out.items.append((None, self.next()[1:]))
                elif self.maybe("("):
                    e = self.expression()
                    self.take("as")
                    out.items.append((e, self.next()[1:]))
                    self.take(")")
                else:
                    break
            if not out.items:
                self.fail("expected variables")
        self.dataset()
        self.maybe("where")
        out.where = self.group()
        return self.modifiers(out)

    def modifiers(self, out: Select) -> Select:
        while True:
            if self.word("group"):
                self.i += 1
                self.take("by")
                while True:
                    if self.kind == "var":
                        out.group.append((("var", self.next()[1:]), None))
                    elif self.maybe("("):
                        e, name = self.expression(), None
                        if self.maybe("as"):
                            name = self.next()[1:]
                        self.take(")")
                        out.group.append((e, name))
                    elif self.kind in ("word", "iri", "name") and not self.word("having", "order", "limit", "offset", "values"):
                        out.group.append((self.primary(), None))
                    else:
                        break
            elif self.maybe("having"):
                while self.kind == "op" and self.value == "(":
                    out.having.append(self.primary())
            elif self.word("order"):
                self.i += 1
                self.take("by")
                while True:
                    if self.word("asc", "desc"):
                        up = self.next().lower() == "asc"
                        out.order.append((up, self.primary()))
                    elif self.kind == "var" or self.value == "(" or (self.kind in ("word", "iri", "name") and not self.word("limit", "offset", "values", "group", "having")):
                        out.order.append((True, self.primary()))
                    else:
                        break
            elif self.maybe("limit"):
                out.limit = int(self.next())
            elif self.maybe("offset"):
                out.offset = int(self.next())
            elif self.word("values"):
                self.i += 1
                out.values = self.values()
            else:
                return out

    def values(self) -> tuple:
        names, rows = [], []
        single = self.kind == "var"
        if single:
            names.append(self.next()[1:])
        else:
            self.take("(")
            while self.value != ")":
                names.append(self.next()[1:])
            self.take(")")
        self.take("{")
        while self.value != "}":
            if not single:
                self.take("(")
            row = []
            while self.value != ")" and (not single or not row):
                row.append(None if self.maybe("undef") else self.node([]))
            if not single:
                self.take(")")
            if len(row) != len(names):
                self.fail("a VALUES row has the wrong length")
            rows.append(tuple(row))
        self.take("}")
        return tuple(names), rows

    def group(self) -> list:
        self.take("{")
        if self.word("select"):
            sub = self.select()
            self.take("}")
            return [("select", sub)]
        out: list = []
        while self.value != "}" or self.kind != "op":
            if self.maybe("bind"):
                self.take("(")
                e = self.expression()
                self.take("as")
                out.append(("bind", e, self.next()[1:]))
                self.take(")")
            elif self.maybe("filter"):
                out.append(("filter", self.constraint()))
            elif self.maybe("optional"):
                out.append(("optional", self.group()))
            elif self.maybe("minus"):
                out.append(("minus", self.group()))
            elif self.maybe("values"):
                out.append(("values", *self.values()))
            elif self.maybe("graph"):
                name = Var(self.next()[1:]) if self.kind == "var" else self.iri()
                out.append(("graph", name, self.group()))
            elif self.maybe("service"):
                self.maybe("silent")
                name = Var(self.next()[1:]) if self.kind == "var" else self.iri()
                out.append(("service", name, self.group()))
            elif self.kind == "op" and self.value == "{":
                arms = [self.group()]
                while self.maybe("union"):
                    arms.append(self.group())
                out.append(("union", arms) if len(arms) > 1 else ("group", arms[0]))
            else:
                triples: list = []
                self.subject_triples(triples)
                if out and out[-1][0] == "triples":
                    out[-1][1].extend(triples)
                else:
                    out.append(("triples", triples))
            self.maybe(".")
        self.take("}")
        return out

    def verb(self):
        """A predicate, which in a group may be a property path."""
        return self.path()

    def path(self):
        arms = [self.path_sequence()]
        while self.maybe("|"):
            arms.append(self.path_sequence())
        return arms[0] if len(arms) == 1 else ("alt", arms)

    def path_sequence(self):
        parts = [self.path_step()]
        while self.maybe("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def path_step(self):
        if self.maybe("^"):
            return ("inverse", self.path_step())
        if self.kind == "op" and self.value == "!":
            self.fail("negated property sets are not supported")
        if self.maybe("("):
            out = self.path()
            self.take(")")
        else:
            out = super().verb()
        while self.kind == "op" and self.value in ("*", "+", "?") and not isinstance(out, Var):
            out = ("repeat", self.next(), out)
        return out

    def constraint(self):
        if self.word("not", "exists"):
            return self.primary()
        if self.value == "(":
            return self.primary()
        return self.primary()

    # expressions, by rising precedence
    def expression(self):
        left = self.conjunction()
        while self.maybe("||"):
            left = ("call", "||", [left, self.conjunction()])
        return left

    def conjunction(self):
        left = self.relation()
        while self.maybe("&&"):
            left = ("call", "&&", [left, self.relation()])
        return left

    def relation(self):
        left = self.sum()
        if self.kind == "op" and self.value in ("=", "!=", "<", ">", "<=", ">="):
            op = self.next()
            return ("call", op, [left, self.sum()])
        negated = self.word("not") and self.tokens[self.i + 1][1].lower() == "in"
        if negated or self.word("in"):
            self.i += 1 + negated
            self.take("(")
            items = []
            while self.value != ")":
                items.append(self.expression())
                if self.value != ")":
                    self.take(",")
            self.take(")")
            out = ("call", "in", [left, *items])
            return ("call", "!", [out]) if negated else out
        return left

    def sum(self):
        left = self.product()
        while self.kind == "op" and self.value in ("+", "-"):
            op = self.next()
            left = ("call", op, [left, self.product()])
        return left

    def product(self):
        left = self.unary()
        while self.kind == "op" and self.value in ("*", "/"):
            op = self.next()
            left = ("call", op, [left, self.unary()])
        return left

    def unary(self):
        if self.kind == "op" and self.value in ("!", "-", "+"):
            op = self.next()
            if op in "+-" and self.kind == "number":
                return ("term", self.number(op))
            return ("call", {"!": "!", "-": "neg", "+": "pos"}[op], [self.unary()])
        return self.primary()

    def arguments(self) -> list:
        self.take("(")
        out = []
        self.maybe("distinct")
        while self.value != ")" or self.kind != "op":
            out.append(self.expression())
            if self.value != ")":
                self.take(",")
        self.take(")")
        return out

    def primary(self):
        if self.kind == "op" and self.value == "(":
            self.i += 1
            e = self.expression()
            self.take(")")
            return e
        if self.kind == "var":
            return ("var", self.next()[1:])
        if self.kind == "string":
            return ("term", self.literal())
        if self.kind == "number":
            return ("term", self.number())
        if self.word("true", "false"):
            return ("term", Literal(self.next().lower(), BOOLEAN))
        if self.word("not", "exists"):
            negated = self.next().lower() == "not"
            if negated:
                self.take("exists")
            e = ("exists", self.group())
            return ("call", "!", [e]) if negated else e
        if self.kind == "word":
            name = self.value.lower()
            if name in AGGREGATES:
                return self.aggregate()
            if name in REFUSED:
                self.fail("not in SPARQL 1.1")
            if name not in BUILT_IN:
                self.fail("unknown function")
            self.i += 1
            args = self.arguments()
            return ("call", {"uri": "iri", "isuri": "isiri"}.get(name, name), args)
        iri = self.iri()
        if self.kind == "op" and self.value == "(":
            return ("call", iri.value, self.arguments())
        return ("term", iri)

    def aggregate(self):
        name = self.next().lower()
        self.take("(")
        distinct, separator = self.maybe("distinct"), " "
        e = None if self.maybe("*") else self.expression()
        if self.maybe(";"):
            self.take("separator")
            self.take("=")
            separator = self.literal().lexical
        self.take(")")
        return ("aggregate", name, distinct, e, separator)


#: Names that a row query may use without declaring them.
def parse_query(text: str, prefixes: Prefixes | None = None) -> Query:
    return QueryParser(text, prefixes=prefixes).parse()


def parse_turtle(text: str, base: str = "") -> tuple[list, Prefixes]:
    reader = Turtle(text, base)
    return reader.parse(), reader.prefixes


def walk(e, visit) -> None:
    """Call visit on an expression and all below it."""
    visit(e)
    if e[0] == "call":
        for x in e[2]:
            walk(x, visit)
    elif e[0] == "aggregate" and e[3] is not None:
        walk(e[3], visit)
