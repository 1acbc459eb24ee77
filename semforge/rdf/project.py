"""Projection of objects, identities, relations, events and facts to quads; provenance, documents and counts over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semforge.functions.ids import stable_id
from semforge.functions.iri import EX, PROV, SKOS, TYPE, XSD
from semforge.storage import spread

COLUMNS = ("graph", "subject", "predicate", "object_kind", "object", "datatype", "language")


def iri(predicate: str, value: Column) -> Column:
    return F.struct(F.lit(predicate).alias("predicate"), F.lit("iri").alias("object_kind"), value.alias("object"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("language"))


def literal(predicate: str, value: Column, kind: str = "string") -> Column:
    return F.struct(F.lit(predicate).alias("predicate"), F.lit("literal").alias("object_kind"), value.cast("string").alias("object"), F.lit(f"{XSD}{kind}").alias("datatype"), F.lit(None).cast("string").alias("language"))


def datetime_literal(predicate: str, value: Column) -> Column:
    """A dateTime where the text is one; a time of 19 characters is UTC; what can't be read is a plain literal."""
    text = F.regexp_replace(F.trim(value.cast("string")), "^(\\S+) ", "$1T")
    text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), F.concat(text, F.lit("Z"))).otherwise(text)
    ok = F.try_to_timestamp(text).isNotNull()
    return F.struct(F.lit(predicate).alias("predicate"), F.lit("literal").alias("object_kind"), F.when(ok, text).otherwise(value.cast("string")).alias("object"), F.when(ok, f"{XSD}dateTime").otherwise(f"{XSD}string").alias("datatype"), F.lit(None).cast("string").alias("language"))


def to_quads(rows: DataFrame, graph: str, subject: Column, statements: Sequence[Column]) -> DataFrame:
    """One quad for each statement of each row; statements without a value are left out. One pass, no shuffle."""
    return rows.select(F.lit(graph).alias("graph"), subject.alias("subject"), F.inline(F.array(*statements))).filter("object IS NOT NULL").select(*COLUMNS)


def objects(rows: DataFrame, graph: str, subject: Column, class_name: str, columns: Mapping[str, str]) -> DataFrame:
    """Type and literal properties of objects: columns maps property names to columns."""
    return to_quads(rows, graph, subject, [iri(TYPE, F.lit(EX + class_name)), *[literal(EX + p, F.col(c)) for p, c in columns.items()]])


def identities(rows: DataFrame, graph: str) -> DataFrame:
    """Assertions (assertion_id, object_iri, confidence and source columns) as IdentityAssertion nodes."""
    subject = F.concat(F.lit(f"{EX}assertion/"), F.col("assertion_id"))
    names = {"sourceSystem": "source_system", "sourceSchema": "source_schema", "sourceTable": "source_table", "sourceRecordId": "source_record_id", "sourceSnapshotId": "source_snapshot_id", "decisionMode": "decision_mode"}
    return to_quads(rows, graph, subject, [iri(TYPE, F.lit(f"{EX}IdentityAssertion")), iri(f"{EX}assertsIdentity", F.col("object_iri")), literal(f"{EX}confidence", F.col("confidence"), "decimal"), *[literal(EX + p, F.col(c)) for p, c in names.items() if c in rows.columns]])


def relations(rows: DataFrame, graph: str) -> DataFrame:
    """Relations (relation_id, subject_iri, predicate_iri, object_iri, temporal, object_is_location): an edge each, and a node where it is temporal or about a place."""
    edge = F.struct(F.col("predicate_iri").alias("predicate"), F.lit("iri").alias("object_kind"), F.col("object_iri").alias("object"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("language"))
    direct = to_quads(rows, graph, F.col("subject_iri"), [edge])
    node = F.concat(F.lit(f"{EX}relation/"), F.col("relation_id"))
    reified = to_quads(rows.filter("temporal OR object_is_location"), graph, node, [iri(TYPE, F.when(F.col("object_is_location"), f"{EX}LocationAssignment").otherwise(f"{EX}RelationAssertion")), iri(f"{EX}relationSubject", F.col("subject_iri")), iri(f"{EX}relationPredicate", F.col("predicate_iri")), iri(f"{EX}relationObject", F.col("object_iri"))])
    return direct.unionByName(reified)


def events(rows: DataFrame, graph: str) -> DataFrame:
    """Events (event_iri, class_name, subject_iri, occurred_at and source columns): two types, the subject and literals."""
    kind = F.concat(F.lit(EX), F.col("class_name"))
    parts = [iri(TYPE, F.lit(f"{EX}BusinessEvent")), iri(TYPE, kind), iri(f"{EX}hasSubject", F.col("subject_iri")), datetime_literal(f"{EX}occurredAt", F.col("occurred_at"))]
    names = {"sourceSchema": "source_schema", "sourceTable": "source_table", "sourceRecordId": "source_record_id", "sourceSnapshotId": "source_snapshot_id"}
    return to_quads(rows, graph, F.col("event_iri"), [*parts, *[literal(EX + p, F.col(c)) for p, c in names.items() if c in rows.columns]])


def event_relations(rows: DataFrame, known: DataFrame, graph: str) -> DataFrame:
    """Edges between events (from_iri, predicate_iri, to_iri), only where both ends exist."""
    ends = known.select("event_iri").distinct()
    out = rows.join(ends.withColumnRenamed("event_iri", "from_iri"), "from_iri", "left_semi").join(ends.withColumnRenamed("event_iri", "to_iri"), "to_iri", "left_semi")
    return out.select(F.lit(graph).alias("graph"), F.col("from_iri").alias("subject"), F.col("predicate_iri").alias("predicate"), F.lit("iri").alias("object_kind"), F.col("to_iri").alias("object"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("language"))


def facts(rows: DataFrame, graph: str) -> DataFrame:
    """Facts (fact_iri, status, fact_type, subject_iri, input_iris) as source or derived facts, with edges to what they derive from."""
    main = to_quads(rows, graph, F.col("fact_iri"), [iri(TYPE, F.when(F.col("status") == "derived", f"{EX}DerivedFact").otherwise(f"{EX}SourceFact")), literal(f"{EX}factType", F.col("fact_type"))])
    owner = to_quads(rows, graph, F.col("subject_iri"), [iri(f"{EX}hasFact", F.col("fact_iri"))])
    from_ = to_quads(rows.select("fact_iri", F.explode("input_iris").alias("i")), graph, F.col("fact_iri"), [iri(f"{PROV}wasDerivedFrom", F.col("i"))])
    return reduce(DataFrame.unionByName, [main, owner.filter("subject IS NOT NULL"), from_])


def concepts(rows: DataFrame, graph: str) -> DataFrame:
    """Concepts (concept_iri, scheme_iri, label, match_iri) of a vocabulary."""
    return to_quads(rows, graph, F.col("concept_iri"), [iri(TYPE, F.lit(f"{SKOS}Concept")), iri(f"{SKOS}inScheme", F.col("scheme_iri")), literal(f"{SKOS}prefLabel", F.col("label")), iri(f"{SKOS}exactMatch", F.col("match_iri"))]).distinct()


def preflight(devices: DataFrame, required: Sequence[str]) -> DataFrame:
    """How many rows lack each required field, and how many rows and snapshots there are."""
    return devices.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"blank_{c}") for c in required])


def statement_id(prefix: str = "ST") -> Column:
    return stable_id(prefix, *[F.col(c) for c in ("graph", "subject", "predicate", "object_kind", "object", "datatype", "language")], n=32)


def coverage(quads: DataFrame, statement_provenance: DataFrame, subject_provenance: DataFrame, kinds: Sequence[str] = ("source", "derived")) -> DataFrame:
    """(graph, eligible, covered, rate): statements of source and derived graphs with provenance of their own or of their subject."""
    rows = quads.filter(F.col("graph").isin(*kinds)).withColumn("statement_id", statement_id())
    a = statement_provenance.select("statement_id").distinct().withColumn("_s", F.lit(True))
    b = subject_provenance.select("subject").distinct().withColumn("_p", F.lit(True))
    ok = F.coalesce("_s", "_p", F.lit(False))
    return rows.join(a, "statement_id", "left").join(b, "subject", "left").groupBy("graph").agg(F.count("*").alias("eligible"), F.count_if(ok).alias("covered"), F.avg(ok.cast("double")).alias("rate"))


def graph_counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("graph").agg(F.count("*").alias("statements"), F.countDistinct("subject").alias("resources"))


def union_graph(*graphs: DataFrame) -> DataFrame:
    """The statements of several graphs, each once."""
    return spread(reduce(DataFrame.unionByName, [x.select("subject", "predicate", "object_kind", "object") for x in graphs])).distinct()


def statements(quads: DataFrame, subject: str | None = None, predicate: str | None = None, limit: int = 100) -> DataFrame:
    """Statements that fit a pattern, in order."""
    out = quads if subject is None else quads.filter(F.col("subject") == subject)
    out = out if predicate is None else out.filter(F.col("predicate") == predicate)
    return out.orderBy("subject", "predicate", "object", "graph").limit(limit)


def document(quads: DataFrame, subject: str) -> DataFrame:
    """(subject, properties): a map from each predicate to its sorted values, of one resource."""
    own = quads.filter(F.col("subject") == subject).groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("object")).alias("values"))
    return own.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "values")))).alias("properties"))


def device_context(quads: DataFrame, device: str, as_of: str | None = None, most: int = 200) -> DataFrame:
    """(section, id, at) of a device: events about it, facts and states that it has, and its other edges; the newest first.

    Times compare as text, and those that are missing pass.
    """
    about = quads.filter((F.col("predicate") == f"{EX}hasSubject") & (F.col("object") == device)).select(F.lit("event").alias("section"), F.col("subject").alias("id"))
    own = quads.filter((F.col("subject") == device) & (F.col("object_kind") == "iri") & (F.col("predicate") != TYPE))
    section = F.when(F.col("predicate") == f"{EX}hasFact", "fact").when(F.col("predicate") == f"{EX}hasCurrentState", "state").otherwise("relation")
    nodes = about.unionByName(own.select(section.alias("section"), F.col("object").alias("id")))
    times = quads.filter(F.col("predicate").isin(f"{EX}occurredAt", f"{EX}observedAt")).groupBy(F.col("subject").alias("id")).agg(F.max("object").alias("at"))
    out = nodes.join(times, "id", "left")
    out = out if as_of is None else out.filter(F.col("at").isNull() | (F.col("at") <= as_of))
    return out.select("section", "id", "at").orderBy("section", F.col("at").desc_nulls_last(), "id").limit(most)


def explain(facts_: DataFrame, derivations: DataFrame, decisions: DataFrame, fact_id: str) -> DataFrame:
    """(role, id) around one fact, one step away: its inputs, what derives from it, and decisions that rest on it."""
    inputs = derivations.filter(F.col("output_fact_id") == fact_id).select(F.lit("input").alias("role"), F.col("input_fact_id").alias("id"))
    outputs = derivations.filter(F.col("input_fact_id") == fact_id).select(F.lit("derived").alias("role"), F.col("output_fact_id").alias("id"))
    rest = decisions.filter(F.array_contains("input_fact_ids", fact_id)).select(F.lit("decision").alias("role"), F.col("decision_id").alias("id"))
    own = facts_.filter(F.col("fact_id") == fact_id).select(F.lit("fact").alias("role"), F.col("fact_id").alias("id"))
    return reduce(DataFrame.unionByName, [own, inputs, outputs, rest])


def with_fallback(canonical: DataFrame, relational: DataFrame, key: str) -> DataFrame:
    """Canonical rows, and for keys that have none the relational ones, labelled as pending."""
    rest = relational.join(canonical.select(key).distinct(), key, "left_anti")
    return canonical.withColumn("origin", F.lit("canonical")).unionByName(rest.withColumn("origin", F.lit("pending")))


def truth_coverage(canonical: DataFrame, relational: DataFrame, kind: str) -> DataFrame:
    """(kind, relational, canonical, missing) by kind of object."""
    a = relational.groupBy(kind).agg(F.count("*").alias("relational"))
    b = canonical.groupBy(kind).agg(F.count("*").alias("canonical"))
    out = a.join(b, kind, "full_outer").fillna(0, ["relational", "canonical"])
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("relational") - F.col("canonical")))
