"""Sinks for quads: N-Quads by line, and TriG and JSON-LD by resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semforge.functions.iri import TYPE, XSD


def _escaped(col: Column) -> Column:
    out = col
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _node(iri: Column) -> Column:
    return F.when(iri.startswith("_:"), iri).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def _object() -> Column:
    text = F.concat(F.lit('"'), _escaped(F.col("object")), F.lit('"'))
    tail = F.when(F.col("language").isNotNull(), F.concat(F.lit("@"), F.col("language"))).when(F.coalesce("datatype", F.lit(f"{XSD}string")) != f"{XSD}string", F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise("")
    return F.when(F.col("object_kind") == "iri", _node(F.col("object"))).otherwise(F.concat(text, tail))


def nquads(quads: DataFrame) -> DataFrame:
    """One line for each quad; ``df.write.text`` puts them anywhere."""
    graph = F.when(F.col("graph").isNull() | (F.col("graph") == ""), "").otherwise(F.concat(F.lit(" <"), F.col("graph"), F.lit(">")))
    return quads.select(F.concat(_node(F.col("subject")), F.lit(" <"), F.col("predicate"), F.lit("> "), _object(), graph, F.lit(" .")).alias("value"))


def trig(quads: DataFrame) -> DataFrame:
    """One block of TriG for each resource of a graph; statements are in order."""
    line = F.concat(F.lit("<"), F.col("predicate"), F.lit("> "), _object())
    by = quads.groupBy("graph", "subject").agg(F.concat_ws(" ;\n    ", F.array_sort(F.collect_set(line))).alias("body"))
    return by.select(F.concat(F.lit("<"), F.col("graph"), F.lit("> {\n  "), _node(F.col("subject")), F.lit(" "), F.col("body"), F.lit(" .\n}")).alias("value"))


def jsonld(quads: DataFrame) -> DataFrame:
    """One JSON-LD node object for each resource of a graph: @id, @type and its properties' values."""
    kinds = quads.filter(F.col("predicate") == TYPE).groupBy("graph", "subject").agg(F.array_sort(F.collect_set("object")).alias("@type"))
    value = F.struct(F.when(F.col("object_kind") == "iri", F.col("object")).alias("@id"), F.when(F.col("object_kind") == "literal", F.col("object")).alias("@value"), F.when(F.col("language").isNull(), F.col("datatype")).alias("@type"), F.col("language").alias("@language"))
    values = quads.filter(F.col("predicate") != TYPE).groupBy("graph", "subject", "predicate").agg(F.array_sort(F.collect_set(F.to_json(value))).alias("v"))
    entry = F.concat(F.to_json(F.array("predicate")), F.lit(""), F.lit(":["), F.concat_ws(",", "v"), F.lit("]"))
    entry = F.regexp_replace(entry, r'^\["(.*?)"\]:', '"$1":')
    props = values.groupBy("graph", "subject").agg(F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("p"))
    both = props.join(kinds, ["graph", "subject"], "full_outer")
    head = F.concat(F.lit('{"@id":'), F.regexp_replace(F.to_json(F.array("subject")), r"^\[|\]$", ""), F.when(F.col("@type").isNotNull(), F.concat(F.lit(',"@type":'), F.to_json("@type"))).otherwise(""))
    return both.select(F.concat(head, F.when(F.col("p").isNotNull(), F.concat(F.lit(","), F.col("p"))).otherwise(""), F.lit("}")).alias("value"))
