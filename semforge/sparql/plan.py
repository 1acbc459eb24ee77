"""Algebra to DataFrames. A variable is a column of structs (kind, value, datatype, language); null is unbound.

Variables that are bound on both sides join by equality, so Spark may use any of its joins; only those that may be unbound need the
looser test. Triple patterns of a group about one subject are a star and join by the subject's plain text, which over a ``Store`` needs no
exchange. Stars and patterns join in the order of their rows, counted where the quads are a ``Store`` and else guessed from what they fix,
connected ones first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semforge.functions.iri import XSD
from semforge.rdf.store import Store
from semforge.sparql.parser import AGGREGATES, Group, Path, Pattern, Query, SparqlError, Term, Var, parse

CAP = 500
_TERM = "struct<kind:string,value:string,datatype:string,language:string>"
_NUMBERS = tuple(XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "nonNegativeInteger"))


def _term(kind: Column | str, value: Column, datatype: Column | str | None = None, language: Column | None = None) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return F.struct(lit(kind).alias("kind"), value.cast("string").alias("value"), lit(datatype).alias("datatype"), (F.lit(None).cast("string") if language is None else language).alias("language"))


def _constant(t: Term) -> Column:
    return _term(t.kind, F.lit(t.value), t.datatype, F.lit(t.language).cast("string"))


class _Solutions:
    """Rows with one column for each variable; ``sure`` are those that are bound in every row."""

    def __init__(self, df: DataFrame, names: set[str], sure: set[str]) -> None:
        self.df, self.names, self.sure = df, names, sure


def _col(name: str) -> Column:
    return F.col(f"`?{name}`")


class Planner:
    def __init__(self, quads: DataFrame | Store) -> None:
        self.store = quads if isinstance(quads, Store) else None
        self.quads = self.store.quads if self.store else quads
        self.spark = self.quads.sparkSession
        self.fresh = 0

    # Patterns

    def triples(self, graph: Var | Term | None) -> DataFrame:
        columns = ["subject", "predicate", "object_kind", "object", "datatype", "language"]
        if graph is None:
            # The default graph is the union of all; a statement in two graphs is one.
            return self.quads.select(*columns).distinct()
        if isinstance(graph, Term):
            return self.quads.filter(F.col("graph") == graph.value).select(*columns)
        return self.quads.select("graph", *columns)

    def pattern(self, p: Pattern, graph: Var | Term | None) -> _Solutions:
        if isinstance(p.predicate, Path):
            pairs = self.path(p.predicate, graph)
            rows = pairs.select(F.col("s").alias("_s"), F.col("o").alias("_o"))
            parts = [(p.subject, F.col("_s")), (p.object, F.col("_o"))]
            for node, column in parts:
                if isinstance(node, Term):
                    rows = rows.filter(column == _constant(node))
        else:
            rows = self.matches(p, graph)
            parts = [(p.subject, _term("iri", F.col("subject"))), (p.predicate, _term("iri", F.col("predicate"))), (p.object, self.object())]
        if isinstance(graph, Var):
            parts.append((graph, _term("iri", F.col("graph"))))
        named: dict[str, Column] = {}
        for node, column in parts:
            if isinstance(node, Var):
                if node.name in named:
                    rows = rows.filter(named[node.name] == column)
                else:
                    named[node.name] = column
        out = rows.select(*[c.alias(f"?{n}") for n, c in named.items()]) if named else rows.select(F.lit(1).alias("_one"))
        return _Solutions(out, set(named), set(named))

    @staticmethod
    def object() -> Column:
        return _term(F.col("object_kind"), F.col("object"), F.col("datatype"), F.col("language"))

    def matches(self, p: Pattern, graph: Var | Term | None) -> DataFrame:
        """Statements that a pattern fits; only what it fixes is filtered, so that it reaches the scan."""
        rows = self.quads if graph is None or isinstance(graph, Var) else self.quads.filter(F.col("graph") == graph.value)
        if isinstance(p.subject, Term):
            rows = rows.filter(F.col("subject") == p.subject.value)
        if isinstance(p.predicate, Term):
            rows = rows.filter(F.col("predicate") == p.predicate.value)
        if isinstance(p.object, Term):
            rows = rows.filter((F.col("object_kind") == p.object.kind) & (F.col("object") == p.object.value))
            if p.object.kind == "literal":
                rows = rows.filter(F.col("datatype").eqNullSafe(F.lit(p.object.datatype)) if p.object.language is None else F.col("language") == p.object.language)
        if graph is None:
            rows = rows.select("subject", "predicate", "object_kind", "object", "datatype", "language").distinct()
        return rows

    def path(self, p: Term | Path, graph: Var | Term | None) -> DataFrame:
        """(s, o) pairs of terms."""
        t = self.triples(graph if not isinstance(graph, Var) else None)
        if isinstance(p, Term):
            return t.filter(F.col("predicate") == p.value).select(_term("iri", F.col("subject")).alias("s"), _term(F.col("object_kind"), F.col("object"), F.col("datatype"), F.col("language")).alias("o"))
        parts = [self.path(x, graph) for x in p.parts]
        if p.kind == "inverse":
            return parts[0].select(F.col("o").alias("s"), F.col("s").alias("o"))
        if p.kind == "choice":
            return reduce(DataFrame.union, parts)
        if p.kind == "sequence":
            return reduce(lambda a, b: a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o"), parts)
        nodes = t.select(F.explode(F.array(_term("iri", F.col("subject")), _term(F.col("object_kind"), F.col("object"), F.col("datatype"), F.col("language")))).alias("s")).distinct().select("s", F.col("s").alias("o"))
        if p.kind == "maybe":
            return parts[0].union(nodes).distinct()
        from semforge.rdf.closure import transitive

        many = transitive(parts[0].select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("s"), F.col("b").alias("o"))
        return many if p.kind == "plus" else many.union(nodes).distinct()

    # Joins

    def join(self, a: _Solutions, b: _Solutions, how: str = "inner", extra: Column | None = None) -> _Solutions:
        shared = sorted(a.names & b.names)
        self.fresh += 1
        renamed = b.df.select(*[_col(n).alias(f"_{self.fresh}{n}" if n in shared else f"?{n}") for n in sorted(b.names)]) if b.names else b.df.select(F.lit(1).alias(f"_{self.fresh}"))
        tests = []
        for n in shared:
            left, right = _col(n), F.col(f"`_{self.fresh}{n}`")
            tests.append(left == right if n in a.sure and n in b.sure else left.isNull() | right.isNull() | (left == right))
        if extra is not None:
            tests.append(extra)
        on = reduce(Column.__and__, tests) if tests else F.lit(True)
        out = a.df.join(renamed, on, {"inner": "inner", "left": "left"}[how])
        names = a.names | b.names
        columns = [(F.coalesce(_col(n), F.col(f"`_{self.fresh}{n}`")) if n in shared and not (n in a.sure) else _col(n)).alias(f"?{n}") for n in sorted(names)]
        return _Solutions(out.select(*columns) if columns else out.select(F.lit(1).alias("_one")), names, a.sure | b.sure if how == "inner" else set(a.sure))

    def without(self, a: _Solutions, b: _Solutions, positive: bool = False, minus: bool = False) -> _Solutions:
        """Rows of a that have no compatible row in b, or have one; MINUS needs a common variable."""
        shared = sorted(a.names & b.names)
        if minus and not shared:
            return a
        self.fresh += 1
        renamed = b.df.select(*[_col(n).alias(f"_{self.fresh}{n}") for n in shared]) if shared else b.df.select(F.lit(1).alias(f"_{self.fresh}"))
        tests = []
        for n in shared:
            left, right = _col(n), F.col(f"`_{self.fresh}{n}`")
            tests.append(left == right if n in a.sure and n in b.sure else left.isNull() | right.isNull() | (left == right))
        if minus and not all(n in a.sure and n in b.sure for n in shared):
            tests.append(reduce(Column.__or__, [_col(n).isNotNull() & F.col(f"`_{self.fresh}{n}`").isNotNull() for n in shared]))
        on = reduce(Column.__and__, tests) if tests else F.lit(True)
        return _Solutions(a.df.join(renamed, on, "left_semi" if positive else "left_anti"), a.names, a.sure)

    def unit(self) -> _Solutions:
        return _Solutions(self.spark.range(1).select(F.lit(1).alias("_one")), set(), set())

    # Groups

    def group(self, g: Group, graph: Var | Term | None = None) -> _Solutions:
        now: _Solutions | None = None
        filters: list[tuple] = []
        k = 0
        elements = g.elements

        def add(x: _Solutions) -> None:
            nonlocal now
            now = x if now is None else self.join(now, x)

        while k < len(elements):
            kind = elements[k][0]
            if kind == "triple":
                block = []
                while k < len(elements) and elements[k][0] == "triple":
                    block.append(elements[k][1])
                    k += 1
                for star in self.ordered(block, set() if now is None else now.names):
                    add(self.star(star, graph))
                continue
            e = elements[k]
            k += 1
            if kind == "optional":
                inner = Group([x for x in e[1].elements if x[0] != "filter"])
                tests = [x[1] for x in e[1].elements if x[0] == "filter"]
                left, right = now or self.unit(), self.group(inner, graph)
                now = self.optional(left, right, tests)
            elif kind == "minus":
                now = self.without(now or self.unit(), self.group(e[1], graph), minus=True)
            elif kind == "graph":
                add(self.group(e[2], e[1]))
            elif kind == "group":
                add(self.group(e[1], graph))
            elif kind == "union":
                branches = [self.group(b, graph) for b in e[1]]
                names = set().union(*[b.names for b in branches])
                same = [b.df.select(*[(_col(n) if n in b.names else F.lit(None).cast(_TERM)).alias(f"?{n}") for n in sorted(names)]) for b in branches]
                add(_Solutions(reduce(DataFrame.unionByName, same), names, set.intersection(*[b.sure for b in branches])))
            elif kind == "bind":
                now = now or self.unit()
                if e[1].name in now.names:
                    raise SparqlError(f"?{e[1].name} is bound already")
                now = _Solutions(now.df.withColumn(f"?{e[1].name}", self.value(e[2], now.names)), now.names | {e[1].name}, now.sure)
            elif kind == "values":
                names = [v.name for v in e[1]]
                rows = [tuple(None if t is None else (t.kind, t.value, t.datatype, t.language) for t in r) for r in e[2]]
                df = self.spark.createDataFrame(rows, ", ".join(f"`?{n}` {_TERM}" for n in names))
                add(_Solutions(df, set(names), {n for i, n in enumerate(names) if all(r[i] is not None for r in e[2])}))
            elif kind == "subselect":
                add(self.select(e[1]))
            elif kind == "exists":
                filters.append(e)
            elif kind == "filter":
                filters.append(e)
        now = now or self.unit()
        for f in filters:
            if f[0] == "filter":
                now = _Solutions(now.df.filter(self.truth(f[1], now.names)), now.names, now.sure)
            else:
                now = self.without(now, self.group(f[2], graph), positive=f[1])
        return now

    def optional(self, left: _Solutions, right: _Solutions, tests: list[tuple]) -> _Solutions:
        if not tests:
            return self.join(left, right, "left")
        # Filters of an OPTIONAL see both sides: the rows that pass are joined to the left ones by number.
        self.fresh += 1
        number = f"_n{self.fresh}"
        numbered = left.df.withColumn(number, F.sha2(F.to_json(F.struct(*[_col(n) for n in sorted(left.names)])), 256)) if left.names else left.df.withColumn(number, F.lit(""))
        both = self.join(_Solutions(numbered.select(*[_col(n).alias(f"?{n}") for n in sorted(left.names)]), left.names, left.sure), right)
        for t in tests:
            both = _Solutions(both.df.filter(self.truth(t, both.names)), both.names, both.sure)
        rest = self.without(left, both)
        names = left.names | right.names
        missing = rest.df.select(*[(_col(n) if n in left.names else F.lit(None).cast(_TERM)).alias(f"?{n}") for n in sorted(names)])
        return _Solutions(both.df.select(*[_col(n).alias(f"?{n}") for n in sorted(names)]).unionByName(missing), names, set(left.sure))

    def ordered(self, patterns: list[Pattern], bound: set[str]) -> list[list[Pattern]]:
        """Stars, the cheapest first, then always one that is connected to what is bound; within a star, the cheapest pattern first."""

        def variables(ps: list[Pattern]) -> set[str]:
            return {x.name for p in ps for x in (p.subject, p.predicate, p.object) if isinstance(x, Var)}

        stars: dict[object, list[Pattern]] = {}
        for i, p in enumerate(patterns):
            plain = isinstance(p.subject, Var) and isinstance(p.predicate, Term)
            stars.setdefault(p.subject.name if plain else i, []).append(p)
        left, out, names = [sorted(x, key=self.cost) for x in stars.values()], [], set(bound)
        while left:
            near = [x for x in left if variables(x) & names] or left
            best = min(near, key=lambda x: self.cost(x[0]))
            left.remove(best)
            out.append(best)
            names |= variables(best)
        return out

    def cost(self, p: Pattern) -> float:
        """Rows of a pattern: as counted, a fixed subject or object leaving one in a thousand; or by what is fixed."""
        if self.store is None:
            return 4 * isinstance(p.subject, Var) + 2 * isinstance(p.object, Var) + 3 * isinstance(p.predicate, Var) + isinstance(p.predicate, Path)
        rows = self.store.rows(p.predicate.value if isinstance(p.predicate, Term) else None)
        return rows / 1000 ** (isinstance(p.subject, Term) + isinstance(p.object, Term)) * (10 if isinstance(p.predicate, Path) else 1)

    def star(self, patterns: list[Pattern], graph: Var | Term | None) -> _Solutions:
        """Patterns about one subject, joined by its text."""
        if len(patterns) == 1 or isinstance(graph, Var):
            return reduce(self.join, [self.pattern(p, graph) for p in patterns])
        parts = [self.matches(p, graph) for p in patterns]
        rows, named = parts[0].select("subject", self.object().alias("_o0")), {patterns[0].subject.name: _term("iri", F.col("subject"))}
        for i, part in enumerate(parts[1:], 1):
            rows = rows.join(part.select("subject", self.object().alias(f"_o{i}")), "subject")
        for i, p in enumerate(patterns):
            if isinstance(p.object, Var):
                column = F.col(f"_o{i}")
                if p.object.name in named:
                    rows = rows.filter(named[p.object.name] == column)
                else:
                    named[p.object.name] = column
        return _Solutions(rows.select(*[c.alias(f"?{n}") for n, c in named.items()]), set(named), set(named))

    # Expressions

    def value(self, e: tuple, names: set[str]) -> Column:
        kind = e[0]
        if kind == "var":
            return _col(e[1].name) if e[1].name in names else F.lit(None).cast(_TERM)
        if kind == "term":
            return _constant(e[1])
        if kind == "aggregate":
            raise SparqlError("aggregates belong into SELECT, HAVING and ORDER BY of a grouped query")
        if kind == "math":
            a, b = (self.number(x, names) for x in e[2:])
            out = {"+": a + b, "-": a - b, "*": a * b, "/": a / F.nullif(b, F.lit(0.0))}[e[1]]
            return F.when(out.isNotNull(), _number(out))
        if kind == "call":
            return self.call(e[1], e[2], names)
        return F.when(self.truth(e, names).isNotNull(), _term("literal", self.truth(e, names), f"{XSD}boolean"))

    def text(self, e: tuple, names: set[str]) -> Column:
        return self.value(e, names)["value"]

    def number(self, e: tuple, names: set[str]) -> Column:
        return _as_number(self.value(e, names))

    def call(self, name: str, args: list[tuple], names: set[str]) -> Column:
        def plain(c: Column) -> Column:
            return F.when(c.isNotNull(), _term("literal", c, f"{XSD}string"))

        if name == "COALESCE":
            return F.coalesce(*[self.value(a, names) for a in args])
        if name == "IF":
            return F.when(self.truth(args[0], names), self.value(args[1], names)).otherwise(self.value(args[2], names))
        if name == "CONCAT":
            return plain(F.concat(*[self.text(a, names) for a in args]))
        if name in ("STR", "LCASE", "UCASE"):
            return plain({"STR": lambda x: x, "LCASE": F.lower, "UCASE": F.upper}[name](self.text(args[0], names)))
        if name == "REPLACE":
            return plain(F.regexp_replace(self.text(args[0], names), self.text(args[1], names), self.text(args[2], names)))
        if name == "LANG":
            v = self.value(args[0], names)
            return F.when(v["kind"] == "literal", _term("literal", F.coalesce(v["language"], F.lit("")), f"{XSD}string"))
        if name == "DATATYPE":
            v = self.value(args[0], names)
            return F.when(v["datatype"].isNotNull(), _term("iri", v["datatype"]))
        if name in ("IRI", "URI"):
            return F.when(self.value(args[0], names).isNotNull(), _term("iri", self.text(args[0], names)))
        if name == "STRLEN":
            return F.when(self.value(args[0], names).isNotNull(), _term("literal", F.length(self.text(args[0], names)), f"{XSD}integer"))
        if name == "ABS":
            n = F.abs(self.number(args[0], names))
            return F.when(n.isNotNull(), _number(n))
        t = self.truth(("call", name, args), names)
        return F.when(t.isNotNull(), _term("literal", t, f"{XSD}boolean"))

    def truth(self, e: tuple, names: set[str]) -> Column:
        """The effective boolean value; null is an error, which a filter takes as false."""
        kind = e[0]
        if kind in ("and", "or"):
            a, b = (self.truth(x, names) for x in e[1:])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.truth(e[1], names)
        if kind == "compare":
            return _compare(e[1], self.value(e[2], names), self.value(e[3], names))
        if kind == "in":
            return reduce(Column.__or__, [_compare("=", self.value(e[1], names), self.value(x, names)) for x in e[2]], F.lit(False))
        if kind == "call":
            name, args = e[1], e[2]
            if name == "BOUND":
                return self.value(args[0], names).isNotNull()
            if name in ("ISIRI", "ISURI", "ISLITERAL"):
                return self.value(args[0], names)["kind"] == ("literal" if name == "ISLITERAL" else "iri")
            if name == "ISNUMERIC":
                return self.number(args[0], names).isNotNull()
            if name == "REGEX":
                flags = args[2][1].value if len(args) > 2 else ""
                pattern = self.text(args[1], names)
                return F.rlike(self.text(args[0], names), F.concat(F.lit(f"(?{flags})"), pattern) if flags else pattern)
            if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
                a, b = self.text(args[0], names), self.text(args[1], names)
                return {"CONTAINS": a.contains, "STRSTARTS": a.startswith, "STRENDS": a.endswith}[name](b)
            if name == "LANGMATCHES":
                a, b = F.lower(self.text(args[0], names)), F.lower(self.text(args[1], names))
                return F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-"))))
        v = self.value(e, names)
        n = _as_number(v)
        return F.when(v["datatype"] == f"{XSD}boolean", v["value"].isin("true", "1")).when(n.isNotNull(), n != 0).when(v["kind"] == "literal", v["value"] != "")

    # Queries

    def select(self, q: Query) -> _Solutions:
        now = self.group(q.where)
        aggregates: list[tuple] = []

        def collect(e: object) -> None:
            if isinstance(e, tuple):
                if e and e[0] == "aggregate":
                    aggregates.append(e)
                else:
                    for x in e:
                        collect(x)
            elif isinstance(e, list):
                for x in e:
                    collect(x)

        items = q.items if q.items is not None else [(Var(n), None) for n in sorted(now.names)]
        collect([e for _, e in items if e is not None] + q.having + [e for e, _ in q.order])
        if aggregates or q.group_by:
            now, items, having, order = self.grouped(q, now, items, aggregates)
        else:
            having, order = q.having, q.order
        for h in having:
            now = _Solutions(now.df.filter(self.truth(h, now.names)), now.names, now.sure)
        for v, e in items:
            if e is not None:
                now = _Solutions(now.df.withColumn(f"?{v.name}", self.value(e, now.names)), now.names | {v.name}, now.sure)
        wanted = [v.name for v, _ in items]
        df = now.df
        keys = []
        for i, (e, up) in enumerate(order):
            v = self.value(e, now.names)
            # Unbound first, then IRIs, then literals by number or text.
            for j, c in enumerate((F.when(v.isNull(), 0).when(v["kind"] == "iri", 1).otherwise(2), _as_number(v), v["value"])):
                df = df.withColumn(f"_o{i}_{j}", c)
                keys.append(F.col(f"_o{i}_{j}").asc() if up else F.col(f"_o{i}_{j}").desc())
        columns = [(_col(n) if n in now.names else F.lit(None).cast(_TERM)).alias(f"?{n}") for n in wanted]
        if q.distinct:
            df = df.select(*columns, *[c for c in df.columns if c.startswith("_o")]).dropDuplicates([f"?{n}" for n in wanted])
            columns = [_col(n) for n in wanted]
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return _Solutions(df.select(*columns), set(wanted), now.sure & set(wanted))

    def grouped(self, q: Query, now: _Solutions, items: list, aggregates: list[tuple]) -> tuple:
        df, keys = now.df, []
        for i, (e, name) in enumerate(q.group_by):
            key = name.name if name else f"_g{i}"
            if e != ("var", name):
                df = df.withColumn(f"?{key}", self.value(e, now.names))
            keys.append(key)
        names = now.names | set(keys)
        out, made = [], {}
        for i, (_, kind, distinct, arg) in enumerate(dict.fromkeys(aggregates)):
            made["aggregate", kind, distinct, arg] = f"_a{i}"
            v = None if arg is None else self.value(arg, names)
            if kind == "COUNT":
                c = F.count("*") if v is None and not distinct else F.count_distinct(F.struct(*[_col(n) for n in sorted(now.names)])) if v is None else F.count_distinct(v) if distinct else F.count(v)
                c = _term("literal", c, f"{XSD}integer")
            elif kind in ("SUM", "AVG"):
                n = _as_number(v)
                c = _number(F.coalesce((F.sum_distinct(n) if distinct else F.sum(n)) if kind == "SUM" else F.avg(n), F.lit(0.0)))
            elif kind in ("MIN", "MAX"):
                pick = F.min if kind == "MIN" else F.max
                c = pick(F.struct(_as_number(v).alias("n"), v["value"].alias("x"), v.alias("v")))["v"]
            else:
                c = F.first(v, ignorenulls=True)
            out.append(c.alias(f"?_a{i}"))
        df = df.groupBy(*[_col(k) for k in keys]).agg(*out) if out else df.select(*[_col(k) for k in keys]).distinct()
        result = _Solutions(df, set(keys) | {f"_a{i}" for i in range(len(out))}, now.sure & set(keys))

        def swap(e):
            if isinstance(e, tuple):
                if e and e[0] == "aggregate":
                    return ("var", Var(made[e]))
                return tuple(swap(x) for x in e)
            return [swap(x) for x in e] if isinstance(e, list) else e

        for v, e in items:
            if e is None and v.name not in keys:
                raise SparqlError(f"?{v.name} isn't grouped by")
        return result, [(v, None if e is None else swap(e)) for v, e in items], [swap(h) for h in q.having], [(swap(e), up) for e, up in q.order]


def _as_number(v: Column) -> Column:
    return F.when(v["datatype"].isin(*_NUMBERS), v["value"].try_cast("double"))


def _number(n: Column) -> Column:
    """Whole results as integers, others as decimals."""
    whole = n == F.floor(n)
    return _term("literal", F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string")), F.when(whole, f"{XSD}integer").otherwise(f"{XSD}decimal"))


def _compare(mark: str, a: Column, b: Column) -> Column:
    x, y = _as_number(a), _as_number(b)
    numbers = x.isNotNull() & y.isNotNull()
    times = (a["datatype"] == f"{XSD}dateTime") & (b["datatype"] == f"{XSD}dateTime")
    if mark in ("=", "!="):
        terms = (a["kind"] == b["kind"]) & (a["value"] == b["value"]) & a["datatype"].eqNullSafe(b["datatype"]) & a["language"].eqNullSafe(b["language"])
        equal = F.when(numbers, x == y).when(a.isNotNull() & b.isNotNull(), terms)
        return equal if mark == "=" else ~equal
    ops = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    op = ops[mark]
    literal = (a["kind"] == "literal") & (b["kind"] == "literal") & x.isNull() & y.isNull()
    return F.when(numbers, op(x, y)).when(F.coalesce(times, F.lit(False)), op(F.try_to_timestamp(a["value"]), F.try_to_timestamp(b["value"]))).when(literal, op(a["value"], b["value"]))


def select(quads: DataFrame | Store, text: str, cap: int | None = CAP, typed: bool = False) -> DataFrame:
    """Solutions of a SELECT, ``cap`` at most: values as text, or as term structs where ``typed``."""
    q = parse(text)
    if q.form != "select":
        raise SparqlError("not a SELECT")
    out = Planner(quads).select(q)
    names = [v.name for v, _ in q.items] if q.items is not None else sorted(out.names)
    df = out.df.select(*[(_col(n) if typed else _col(n)["value"]).alias(n) for n in names])
    return df if cap is None else df.limit(cap)


def ask(quads: DataFrame | Store, text: str) -> bool:
    q = parse(text)
    if q.form != "ask":
        raise SparqlError("not an ASK")
    return bool(Planner(quads).group(q.where).df.limit(1).count())


__all__ = ["AGGREGATES", "ask", "select"]
