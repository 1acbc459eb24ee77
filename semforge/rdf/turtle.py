"""A reader of the Turtle subset that vocabularies and shapes are written in: a tokenizer and a recursive descent.

These files describe a schema and have a few hundred statements, so they are read on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession

from semforge.functions.iri import RDF, TYPE, XSD

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<mark>[\[\]().;,])
    |(?P<name>(?:_:[\w.-]+|[A-Za-z_][\w.-]*:[\w.~%/-]*|:[\w.~%/-]*|[A-Za-z_]\w*)(?<!\.))""",
    re.VERBOSE | re.DOTALL,
)
ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
Node = tuple[str, str, str | None, str | None]


class TurtleError(ValueError):
    """Text that isn't of the subset."""


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None or m.end() == at:
            raise TurtleError(f"can't read {text[at : at + 30]!r}")
        if m.lastgroup != "space":
            yield m.lastgroup or "", m.group()
        at = m.end()
    yield "end", ""


def _unescape(raw: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPE.get(m[1], m[1]), raw, flags=re.DOTALL)


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens = _tokens(text)
        self.kind, self.value = next(self.tokens)
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.blank = count(1)
        self.out: list[tuple[str, str, Node]] = []

    def next(self) -> str:
        value = self.value
        self.kind, self.value = next(self.tokens)
        return value

    def expect(self, mark: str) -> None:
        if self.value != mark:
            raise TurtleError(f"{mark} is missing before {self.value!r}")
        self.next()

    def read(self) -> list[tuple[str, str, Node]]:
        while self.kind != "end":
            if self.value.lower() in ("@prefix", "@base", "prefix", "base"):
                word = self.next().lower()
                if word.endswith("prefix"):
                    name = self.next().rstrip(":")
                    self.prefixes[name] = self.next()[1:-1]
                else:
                    self.base = self.next()[1:-1]
                if word.startswith("@"):
                    self.expect(".")
                continue
            if self.value == "[":
                subject = self.node()[1]
                if self.value == ".":
                    self.next()
                    continue
            else:
                subject = self.node()[1]
            self.properties(subject, ".")
            self.expect(".")
        return self.out

    def properties(self, subject: str, end: str) -> None:
        while self.value != end:
            if self.value == ";":
                self.next()
                continue
            if self.value == "a":
                self.next()
                predicate = TYPE
            else:
                predicate = self.node()[1]
            while True:
                self.out.append((subject, predicate, self.node()))
                if self.value != ",":
                    break
                self.next()
            if self.value not in (";", end):
                raise TurtleError(f"unexpected {self.value!r}")

    def node(self) -> Node:
        kind, value = self.kind, self.value
        if value == "[":
            self.next()
            me = f"_:b{next(self.blank)}"
            self.properties(me, "]")
            self.expect("]")
            return "iri", me, None, None
        if value == "(":
            self.next()
            items = []
            while self.value != ")":
                items.append(self.node())
            self.next()
            names = [f"_:b{next(self.blank)}" for _ in items]
            for name, item, rest in zip(names, items, [*names[1:], f"{RDF}nil"], strict=True):
                self.out += [(name, f"{RDF}first", item), (name, f"{RDF}rest", ("iri", rest, None, None))]
            return "iri", names[0] if names else f"{RDF}nil", None, None
        self.next()
        if kind == "iri":
            iri = value[1:-1]
            return "iri", iri if ":" in iri else self.base + iri, None, None
        if kind in ("text", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.kind == "lang":
                return "literal", text, f"{RDF}langString", self.next()[1:].lower()
            if self.kind == "type":
                self.next()
                return "literal", text, self.node()[1], None
            return "literal", text, f"{XSD}string", None
        if kind == "number":
            return "literal", value, f"{XSD}{'double' if 'e' in value.lower() else 'decimal' if '.' in value else 'integer'}", None
        if value in ("true", "false"):
            return "literal", value, f"{XSD}boolean", None
        if value.startswith("_:"):
            return "iri", value, None, None
        prefix, colon, name = value.partition(":")
        if not colon or prefix not in self.prefixes:
            raise TurtleError(f"unknown name {value!r}")
        return "iri", self.prefixes[prefix] + name, None, None


def parse(text: str) -> list[tuple[str, str, Node]]:
    """Statements as (subject, predicate, (kind, value, datatype, language))."""
    return _Reader(text).read()


QUAD = "graph string, subject string, predicate string, object_kind string, object string, datatype string, language string"


def read_turtle(spark: SparkSession, text: str, graph: str) -> DataFrame:
    return spark.createDataFrame([(graph, s, p, *o) for s, p, o in parse(text)], QUAD)
