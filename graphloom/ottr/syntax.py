"""stOTTR: tokens, documents, and the template library."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from graphloom.plans.rdf import BOOLEAN, DECIMAL, DOUBLE, INTEGER, IRI, LANG_STRING, OTTR, STRING, BNode, ListTerm, Literal, Prefixes, Var, unescaped

NONE = IRI(OTTR + "none")
TRIPLE = OTTR + "Triple"
NULLABLE_TRIPLE = OTTR + "NullableTriple"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|/\*\*\*.*?\*\*\*/|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<annotation>@@)
    |(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<var>\?[A-Za-z_][\w]*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<op>::|\+\+|\^\^|[\[\]{}(),.=!?|<>])
    |(?P<name>(?:[^\W\d_][\w.\-]*)?:(?:[\w:%](?:[\w.\-:%]*[\w\-:%])?)?)
    |(?P<bare>[A-Za-z][\w]*)""",
    re.X | re.S,
)


class OttrError(ValueError):
    """A template document or a use of it that is not right."""


@dataclass(frozen=True)
class Type:
    """A basic type's IRI, or List, NEList, LUB of another type."""

    name: str
    of: "Type | None" = None

    def __str__(self):
        return f"{self.name}<{self.of}>" if self.of else self.name


@dataclass(frozen=True)
class Parameter:
    name: str
    type: Type | None = None
    optional: bool = False
    nonblank: bool = False
    default: object | None = None


@dataclass(frozen=True)
class Argument:
    term: object
    expand: bool = False


@dataclass(frozen=True)
class Instance:
    template: str
    arguments: tuple[Argument, ...]
    expander: str | None = None


@dataclass
class Template:
    iri: str
    parameters: list[Parameter]
    kind: str  # template, base or signature
    body: list[Instance] = field(default_factory=list)
    annotations: list[Instance] = field(default_factory=list)


@dataclass
class Document:
    prefixes: Prefixes
    templates: list[Template] = field(default_factory=list)
    instances: list[Instance] = field(default_factory=list)


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if text[at] == "<" and out and out[-1][1] in ("List", "NEList", "LUB"):
            out.append(("op", "<", at))
            at += 1
            continue
        if not m:
            raise OttrError(f"line {text.count(chr(10), 0, at) + 1}: cannot read {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    out.append(("end", "", at))
    return out


class Parser:
    def __init__(self, text: str, prefixes: Prefixes | None = None):
        self.text, self.tokens, self.i = text, tokens(text), 0
        self.doc = Document(Prefixes(prefixes or {}))
        self.base = ""

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.tokens[self.i][2]) + 1
        raise OttrError(f"line {line}: {what}, found {self.value or 'the end'!r}")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        if (value is not None and self.value != value) or (kind is not None and self.kind != kind):
            self.fail(f"expected {value or kind}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def maybe(self, value: str) -> bool:
        if self.value == value and self.kind in ("op", "bare", "annotation", "word"):
            self.i += 1
            return True
        return False

    def several(self, one, end: str) -> list:
        out = []
        while self.value != end:
            out.append(one())
            if self.value != end:
                self.take(",")
        self.take(end)
        return out

    def iri(self) -> str:
        if self.kind == "iri":
            raw = unescaped(self.take()[1:-1])
            return raw if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw) else self.base + raw
        if self.kind == "name":
            name = self.take()
            full = self.doc.prefixes.expand(name)
            if full is None:
                self.i -= 1
                self.fail(f"prefix of {name} is not declared")
            return full
        self.fail("expected an IRI")

    def parse(self) -> Document:
        while self.kind != "end":
            low = self.value.lower()
            if low in ("@prefix", "prefix", "@base", "base"):
                self.i += 1
                if low.endswith("prefix"):
                    name = self.take(kind="name")[:-1]
                    self.doc.prefixes[name] = unescaped(self.take(kind="iri")[1:-1])
                else:
                    self.base = unescaped(self.take(kind="iri")[1:-1])
                if low.startswith("@"):
                    self.take(".")
            else:
                self.statement()
        return self.doc

    def statement(self) -> None:
        expander = None
        if self.kind == "bare" and self.value in ("cross", "zipMin", "zipMax"):
            expander = self.take()
            self.take("|")
        iri = self.iri()
        if self.maybe("("):
            self.doc.instances.append(Instance(iri, tuple(self.several(self.argument, ")")), expander))
            self.take(".")
            return
        self.take("[")
        template = Template(iri, self.several(self.parameter, "]"), "signature")
        if self.maybe("@@"):
            template.annotations.append(self.instance())
            while self.maybe(","):
                self.take("@@")
                template.annotations.append(self.instance())
        if self.maybe("::"):
            if self.maybe("BASE"):
                template.kind = "base"
            else:
                self.take("{")
                template.kind, template.body = "template", self.several(self.instance, "}")
        self.take(".")
        self.doc.templates.append(template)

    def type(self) -> Type:
        if self.kind == "bare" and self.value in ("List", "NEList", "LUB"):
            name = self.take()
            self.take("<")
            of = self.type()
            self.take(">")
            return Type(name, of)
        return Type(self.iri())

    def parameter(self) -> Parameter:
        optional = nonblank = False
        while self.kind == "op" and self.value in ("?", "!"):
            optional, nonblank = optional or self.value == "?", nonblank or self.value == "!"
            self.i += 1
        kind = None if self.kind == "var" else self.type()
        name = self.take(kind="var")[1:]
        default = self.term() if self.maybe("=") else None
        return Parameter(name, kind, optional, nonblank, default)

    def instance(self) -> Instance:
        expander = None
        if self.kind == "bare" and self.value in ("cross", "zipMin", "zipMax"):
            expander = self.take()
            self.take("|")
        iri = self.iri()
        self.take("(")
        return Instance(iri, tuple(self.several(self.argument, ")")), expander)

    def argument(self) -> Argument:
        expand = self.maybe("++")
        return Argument(self.term(), expand)

    def term(self):
        kind, value = self.kind, self.value
        if kind == "var":
            return Var(self.take()[1:])
        if kind == "bnode":
            return BNode(self.take()[2:])
        if kind == "number":
            self.i += 1
            return Literal(value, DOUBLE if "e" in value.lower() else DECIMAL if "." in value else INTEGER)
        if kind == "string":
            self.i += 1
            body = value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1]
            text = unescaped(body)
            if self.kind == "word":
                return Literal(text, LANG_STRING, self.take()[1:].lower())
            if self.maybe("^^"):
                datatype = self.iri()
                return Literal(text, datatype)
            return Literal(text, STRING)
        if kind == "bare":
            self.i += 1
            if value in ("true", "false"):
                return Literal(value, BOOLEAN)
            if value == "none":
                return NONE
            self.i -= 1
        if value == "(":
            self.i += 1
            return ListTerm(tuple(self.several(self.term, ")")))
        if value == "[":
            self.i += 1
            self.take("]")
            self.fresh = getattr(self, "fresh", 0) + 1
            return BNode(f" {self.fresh}")  # a label that no document can write
        return IRI(self.iri())


def parse(text: str, prefixes: Prefixes | None = None) -> Document:
    return Parser(text, prefixes).parse()


BASE_TEMPLATES = {
    TRIPLE: Template(TRIPLE, [Parameter("subject", Type(OTTR + "IRI")), Parameter("predicate", Type(OTTR + "IRI"), nonblank=True), Parameter("object")], "base"),
    NULLABLE_TRIPLE: Template(NULLABLE_TRIPLE, [Parameter("subject", optional=True), Parameter("predicate", optional=True), Parameter("object", optional=True)], "base"),
}


class Library:
    """Templates by IRI.  A pattern template beats a signature of the same IRI; the first of equals stays."""

    def __init__(self):
        self.templates: dict[str, Template] = {}
        self.prefixes = Prefixes()
        self.all: list[Template] = []
        self.instances: list[Instance] = []

    def add(self, doc: Document) -> "Library":
        rank = {"signature": 0, "base": 1, "template": 2}
        for prefix, namespace in doc.prefixes.items():
            self.prefixes.setdefault(prefix, namespace)
        for t in doc.templates:
            self.all.append(t)
            old = self.templates.get(t.iri)
            if old is None or rank[t.kind] > rank[old.kind]:
                self.templates[t.iri] = t
        self.instances += doc.instances
        return self

    @staticmethod
    def load(*sources: str) -> "Library":
        """Files, folders of .stottr files, or stOTTR text."""
        out = Library()
        for source in sources:
            if os.path.isdir(source):
                for folder, _, names in sorted(os.walk(source)):
                    for name in sorted(names):
                        if name.endswith(".stottr"):
                            with open(os.path.join(folder, name), encoding="utf-8") as f:
                                out.add(parse(f.read()))
            elif "\n" in source or "::" in source or source.lstrip().startswith("@"):
                out.add(parse(source))
            else:
                with open(source, encoding="utf-8") as f:
                    out.add(parse(f.read()))
        return out

    def get(self, iri: str) -> Template:
        t = BASE_TEMPLATES.get(iri) or self.templates.get(iri)
        if t is None:
            raise OttrError(f"template <{iri}> is not defined")
        return t

    def resolve(self, name: str) -> str:
        """A template's IRI from a prefixed name or IRI."""
        return self.prefixes.expand(name) or name.strip("<>")
