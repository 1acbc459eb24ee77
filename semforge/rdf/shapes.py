"""Validation of quads against shapes: a SHACL subset compiled to joins and counts.

Shapes are read on the driver; each constraint is one DataFrame of violations, and all are united.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.functions.iri import RDF, RDFS, SH, TYPE
from semforge.rdf.turtle import parse
from semforge.storage import cut_lineage, spread


@dataclass
class Property:
    path: str
    min_count: int | None = None
    max_count: int | None = None
    one_of: list[str] | None = None
    node_kind: str | None = None
    class_: str | None = None
    datatype: str | None = None
    severity: str = "Violation"
    message: str = ""


@dataclass
class Shape:
    iri: str
    target: str
    closed: bool = False
    ignored: list[str] = field(default_factory=list)
    severity: str = "Violation"
    message: str = ""
    properties: list[Property] = field(default_factory=list)


def read_shapes(text: str) -> list[Shape]:
    """Node shapes of a Turtle text. A property without severity or message has its shape's."""
    triples: dict[str, dict[str, list[tuple]]] = {}
    for s, p, o in parse(text):
        triples.setdefault(s, {}).setdefault(p, []).append(o)

    def one(node: str, name: str) -> str | None:
        found = triples.get(node, {}).get(SH + name)
        return found[0][1] if found else None

    def items(head: str | None) -> list[str]:
        out = []
        while head and head != f"{RDF}nil":
            out.append(triples[head][f"{RDF}first"][0][1])
            head = triples[head][f"{RDF}rest"][0][1]
        return out

    shapes = []
    for node, values in triples.items():
        if not any(o[1] == f"{SH}NodeShape" for o in values.get(TYPE, ())) or not (target := one(node, "targetClass")):
            continue
        shape = Shape(node, target, one(node, "closed") == "true", items(one(node, "ignoredProperties")), (one(node, "severity") or f"{SH}Violation").removeprefix(SH), one(node, "message") or "")
        for _, p, *_ in values.get(f"{SH}property", ()):
            number = {k: int(x) if (x := one(p, k)) is not None else None for k in ("minCount", "maxCount")}
            shape.properties.append(Property(one(p, "path") or "", number["minCount"], number["maxCount"], items(one(p, "in")) or None, (one(p, "nodeKind") or "").removeprefix(SH) or None, one(p, "class"), one(p, "datatype"), (one(p, "severity") or f"{SH}{shape.severity}").removeprefix(SH), one(p, "message") or shape.message))
        shapes.append(shape)
    return shapes


def validate_shapes(quads: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(focus, path, code, severity, message) of each violation.

    Focus nodes are those with the target class as a type that is given; only ``class`` looks at superclasses. Values of ``in`` compare
    by text. All shapes are judged together: the focus nodes' statements are joined once and kept, each value is held against its
    properties as its row passes, and one aggregate counts the values of all properties.
    """
    schema = "focus string, path string, code string, severity string, message string"
    if not shapes:
        return quads.sparkSession.createDataFrame([], schema)
    # Each statement goes to where its copies go before they are told apart, so that no task holds all that it read.
    triples = spread(quads.select("subject", "predicate", "object_kind", "object", "datatype")).distinct()
    types = triples.filter(F.col("predicate") == TYPE).select("subject", F.col("object").alias("type"))
    number = F.explode(F.array_compact(F.array(*[F.when(F.col("type") == x.target, F.lit(k)) for k, x in enumerate(shapes)])))
    focus = types.filter(F.col("type").isin(*{x.target for x in shapes})).select("subject", number.alias("shape")).distinct()
    values = triples.join(focus, "subject")
    wanted = sorted({p.class_ for x in shapes for p in x.properties if p.class_ is not None})
    if wanted:
        from semforge.rdf.closure import transitive

        up = triples.filter(F.col("predicate") == f"{RDFS}subClassOf").select(F.col("subject").alias("a"), F.col("object").alias("b"))
        kinds = transitive(up.filter("a <> b")).filter(F.col("b").isin(*wanted)).union(quads.sparkSession.createDataFrame([(c, c) for c in wanted], "a string, b string"))
        # A node's classes, of those that any shape asks for.
        classes = types.join(kinds, F.col("type") == F.col("a")).groupBy(F.col("subject").alias("node")).agg(F.collect_set("b").alias("classes"))
        values = values.join(classes, F.col("object") == F.col("node"), "left")
    # Three branches read them.
    values = cut_lineage(values, "values")

    def fault(when, path, code: str, p: Property | Shape):
        return F.when(when, F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(p.severity).alias("severity"), F.lit(p.message).alias("message")))

    by_value, by_count = [], []
    for k, shape in enumerate(shapes):
        own = F.col("shape") == k
        for j, p in enumerate(shape.properties):
            here, path = own & (F.col("predicate") == p.path), F.lit(p.path)
            if p.min_count is not None:
                by_count.append(fault(own & (F.col(f"n{k}_{j}") < p.min_count), path, "minCount", p))
            if p.max_count is not None:
                by_count.append(fault(own & (F.col(f"n{k}_{j}") > p.max_count), path, "maxCount", p))
            if p.one_of is not None:
                by_value.append(fault(here & ~F.col("object").isin(*p.one_of), path, "in", p))
            if p.node_kind is not None:
                wrong = {"IRI": F.col("object_kind") != "iri", "Literal": F.col("object_kind") != "literal", "BlankNodeOrIRI": F.col("object_kind") != "iri"}[p.node_kind]
                by_value.append(fault(here & wrong, path, "nodeKind", p))
            if p.datatype is not None:
                by_value.append(fault(here & ~F.col("datatype").eqNullSafe(F.lit(p.datatype)), path, "datatype", p))
            if p.class_ is not None:
                by_value.append(fault(here & ~F.coalesce(F.array_contains("classes", p.class_), F.lit(False)), path, "class", p))
    parts = []

    def found(rows: DataFrame, faults: list) -> DataFrame:
        return rows.select(F.col("subject").alias("focus"), F.inline(F.array_compact(F.array(*faults))))

    if by_value:
        parts.append(found(values, by_value))
    if by_count:
        # Every focus node has its type among its statements, so it is in some group even if it lacks all properties.
        counts = [F.count_if(F.col("predicate") == p.path).alias(f"n{k}_{j}") for k, x in enumerate(shapes) for j, p in enumerate(x.properties) if p.min_count is not None or p.max_count is not None]
        parts.append(found(values.groupBy("subject", "shape").agg(*counts), by_count))
    closed = [(k, x) for k, x in enumerate(shapes) if x.closed]
    if closed:
        extra = [fault((F.col("shape") == k) & ~F.col("predicate").isin(TYPE, *x.ignored, *[p.path for p in x.properties]), F.col("predicate"), "closed", x) for k, x in closed]
        parts.append(found(values.select("subject", "predicate", "shape").distinct(), extra))
    if not parts:
        return quads.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
