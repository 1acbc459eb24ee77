"""Contracts of a projection: queries that must answer, and the gate that all standards checks go through."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.functions.iri import OWL, TYPE
from semforge.rdf.shapes import Shape, validate_shapes
from semforge.sparql import SparqlError, ask, parse, select


@dataclass(frozen=True)
class Contract:
    """A query with the fewest rows that it must give, and a bound of the number in its one row where it counts. ASK must be true."""

    name: str
    query: str
    least_rows: int = 1
    least_count: int | None = None


def run_contracts(quads: DataFrame, contracts: Sequence[Contract]) -> DataFrame:
    """(contract, rows, status, message) of each contract, by name; a query outside the read-only language fails and isn't run."""
    out = []
    for c in sorted(contracts, key=lambda x: x.name):
        try:
            if parse(c.query).form == "ask":
                n, message = int(ask(quads, c.query)), None
                ok = n >= min(c.least_rows, 1)
            else:
                found = select(quads, c.query).limit(max(c.least_rows, 1)).collect()
                n, ok = len(found), len(found) >= c.least_rows
                message = None if ok else f"fewer than {c.least_rows} rows"
                if ok and c.least_count is not None and int(float(found[0][0])) < c.least_count:
                    ok, message = False, f"counts {found[0][0]}, fewer than {c.least_count}"
        except SparqlError as e:
            n, ok, message = 0, False, str(e)
        out.append((c.name, n, "passed" if ok else "failed", message))
    return quads.sparkSession.createDataFrame(out, "contract string, rows long, status string, message string")


def standards_gate(quads: DataFrame, shapes: Sequence[Shape], contracts: Sequence[Contract], graphs: Sequence[str], classes: Sequence[str], context_terms: Mapping[str, str]) -> DataFrame:
    """(failure, detail) of everything that a release of the ontology would be refused for; no row means that it passes.

    Graphs that must be there, classes that must have a shape, declared properties without a term of the JSON-LD context, violations of
    shapes by shape severity, and contracts.
    """
    spark = quads.sparkSession
    parts = [spark.createDataFrame([("SHAPE_MISSING", c) for c in sorted(set(classes) - {s.target for s in shapes})], "failure string, detail string")]
    wanted = spark.createDataFrame([(g,) for g in graphs], "graph string")
    parts.append(wanted.join(quads.select("graph").distinct(), "graph", "left_anti").select(F.lit("GRAPH_MISSING").alias("failure"), F.col("graph").alias("detail")))
    declared = quads.filter((F.col("predicate") == TYPE) & F.col("object").isin(f"{OWL}ObjectProperty", f"{OWL}DatatypeProperty")).select("subject").distinct()
    terms = sorted(set(context_terms.values()))
    parts.append(declared.filter(~F.col("subject").isin(*terms) if terms else F.lit(True)).select(F.lit("CONTEXT_TERM_MISSING").alias("failure"), F.col("subject").alias("detail")))
    faults = validate_shapes(quads, list(shapes)).filter("severity = 'Violation'")
    parts.append(faults.groupBy("path", "code").agg(F.count("*").alias("n")).select(F.lit("SHAPE_VIOLATED").alias("failure"), F.concat_ws(" ", "code", "path", F.col("n").cast("string")).alias("detail")))
    parts.append(run_contracts(quads, contracts).filter("status = 'failed'").select(F.lit("CONTRACT_FAILED").alias("failure"), F.col("contract").alias("detail")))
    return reduce(DataFrame.unionByName, parts)
