"""Events from operational rows, facts from relations and events, and rule reasoning over raw statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semforge.functions.ids import stable_id

#: Event types of record kinds, and fact types of relations.
EVENT_KINDS = {"inspection": "InspectionEvent", "defect": "DefectCreatedEvent", "work_order": "WorkOrderEvent"}
RELATION_FACTS = {"device_has_inspection": "observation_event", "device_has_defect": "defect_event", "device_has_work_order": "work_order_event"}


def relation_facts(relations: DataFrame) -> DataFrame:
    """Accepted relations of devices (relation_key, subject_type, subject_key, object_key, status, source_snapshot_id) to observed facts."""
    kinds = F.create_map(*[F.lit(x) for kv in RELATION_FACTS.items() for x in kv])
    out = relations.filter("status = 'accepted' AND subject_type = 'device'").withColumn("fact_type", F.element_at(kinds, F.col("relation_key"))).filter("fact_type IS NOT NULL")
    return out.select(stable_id("FACT", F.col("relation_key"), F.col("subject_key"), F.col("object_key"), F.col("source_snapshot_id")).alias("fact_id"), "fact_type", "subject_key", "object_key", F.lit("recorded_for").alias("predicate"), "source_snapshot_id")


def project_events(records: DataFrame) -> DataFrame:
    """Operational rows (kind, record_id, candidate_id, identity_status, occurred_at, source_schema, source_snapshot_id) to events.

    The subject is the device only where its identity is accepted; all else stays for review. Unknown kinds keep their name.
    """
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])
    ok = F.col("identity_status") == "accepted"
    return records.select(
        stable_id("EVT", F.col("source_schema"), F.col("kind"), F.col("record_id"), F.col("source_snapshot_id")).alias("event_id"),
        F.coalesce(F.element_at(kinds, F.col("kind")), F.col("kind")).alias("event_type"),
        F.when(ok, F.col("candidate_id")).alias("subject_key"),
        F.when(ok, "accepted").otherwise("needs_review").alias("status"),
        "occurred_at",
        "source_schema",
        "source_snapshot_id",
        "record_id",
    )


def with_provenance(events: DataFrame) -> DataFrame:
    """Adds provenance_hash of the source pointer, correlation_id, and previous_event_id within subject, schema and snapshot."""
    pointer = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_schema", "record_id", "source_snapshot_id")])
    order = Window.partitionBy("subject_key", "source_schema", "source_snapshot_id").orderBy(F.col("occurred_at").asc_nulls_last(), "event_id")
    return events.withColumns({"provenance_hash": F.sha2(pointer, 256), "correlation_id": stable_id("COR", F.col("subject_key"), F.col("source_schema"), n=16), "previous_event_id": F.lag("event_id").over(order)})


def status_facts(defects: DataFrame) -> DataFrame:
    """Defect facts (fact_id, subject_key, raw_status) to status facts with status_present."""
    raw = F.nullif(F.trim("raw_status"), F.lit(""))
    return defects.select(stable_id("FACT", F.lit("defect_status"), F.col("fact_id")).alias("status_fact_id"), F.col("fact_id").alias("source_fact_id"), "subject_key", raw.alias("raw_status"), raw.isNotNull().alias("status_present"))


def derive(facts: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, facts, derivations): the first rule of each input fact type, by rule_id, applied to facts (fact_id, fact_type, value).

    A fact without a value gets a decision that needs review, and neither a derived fact nor a derivation.
    """
    first = rules.groupBy("input_fact_type").agg(F.min(F.struct("rule_id", "output_fact_type", "rule_version")).alias("r")).select(F.col("input_fact_type").alias("fact_type"), "r.*")
    joined = facts.join(first, "fact_type")
    ok = F.nullif(F.trim("value"), F.lit("")).isNotNull()
    decisions = joined.select(stable_id("DEC", F.col("rule_id"), F.col("fact_id")).alias("decision_id"), "rule_id", "rule_version", F.col("fact_id").alias("input_fact_id"), F.when(ok, "derived").otherwise("needs_review").alias("outcome"))
    good = joined.filter(ok).withColumn("derived_id", stable_id("FACT", F.col("output_fact_type"), F.col("fact_id"), F.col("rule_version")))
    derived = good.select(F.col("derived_id").alias("fact_id"), F.col("output_fact_type").alias("fact_type"), "value", F.array("fact_id").alias("input_fact_ids"), "rule_version")
    derivations = good.select(stable_id("DRV", F.col("derived_id"), F.col("fact_id")).alias("derivation_id"), F.col("derived_id").alias("output_fact_id"), F.col("fact_id").alias("input_fact_id"), "rule_id", "rule_version")
    return decisions, derived, derivations


def map_statuses(statuses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Status facts to canonical states by the approved dictionary on schema, table, raw status and snapshot.

    Both sides are keyed alike; of several versions the latest counts.
    """
    keys = ("source_schema", "source_table", "raw_status", "source_snapshot_id")
    approved = dictionary.filter("review_status = 'approved'").groupBy(*keys).agg(F.max(F.struct("mapping_version", "canonical_state")).alias("m")).select(*keys, "m.*")
    return statuses.join(approved, list(keys)).withColumn("canonical_fact_id", stable_id("FACT", F.lit("canonical_defect_state"), F.col("status_fact_id"), F.col("mapping_version")))


def status_review(dictionary: DataFrame, key: str, canonical: str, reviewer: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, audit) after one raw status is approved: its version goes up by one and an audit row says so."""
    hit = F.col("raw_status") == key
    after = dictionary.withColumns({"mapping_version": F.col("mapping_version") + F.when(hit, 1).otherwise(0), "canonical_state": F.when(hit, F.lit(canonical)).otherwise(F.col("canonical_state")), "review_status": F.when(hit, "approved").otherwise(F.col("review_status"))})
    audit = after.filter(hit).select(stable_id("AUD", F.col("raw_status"), F.col("mapping_version")).alias("audit_id"), "raw_status", "canonical_state", "mapping_version", F.lit(reviewer).alias("reviewer"))
    return after, audit
