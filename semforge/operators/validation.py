"""Validators, constraints and coverage: what is missing becomes a row with a severity, never a guess."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, entity: str, checks: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """(entity, check, outcome, severity): every check on every row in one pass; a check that can't be told fails."""
    results = F.array(*[F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("outcome"), F.lit(severity).alias("severity")) for name, ok, severity in checks])
    return df.select(F.col(entity).alias("entity"), F.inline(results))


def candidate_validators(df: DataFrame) -> DataFrame:
    """The five validators of candidates (candidate_id, proposed, original, device_id, evidence_level, reason_codes, status)."""
    text = F.coalesce(F.trim("proposed"), F.lit(""))
    return validate(
        df,
        "candidate_id",
        (
            ("contract", F.col("candidate_id").isNotNull() & F.col("status").isNotNull(), "error"),
            ("identity", F.col("device_id").isNotNull(), "error"),
            ("evidence", F.col("evidence_level").isin("strong", "source_preview_and_replay"), "warning"),
            ("semantic", (text != "") & (F.length(text) <= 500), "error"),
            ("consistency", ~F.exists("reason_codes", lambda c: c.contains("CONFLICT")), "error"),
        ),
    )


def constraint_violations(events: DataFrame, facts: DataFrame, sources: DataFrame, relations: DataFrame, predicates: DataFrame) -> DataFrame:
    """(constraint, entity): events and facts without a source pointer, writable sources, accepted relations of no registered predicate."""

    def no_pointer(df: DataFrame, key: str, name: str) -> DataFrame:
        blank = reduce(Column.__or__, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in ("source_schema", "source_record_id", "source_snapshot_id")])
        return df.filter(blank).select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("entity"))

    parts = [
        no_pointer(events, "event_id", "EVENT_PROVENANCE"),
        no_pointer(facts, "fact_id", "FACT_PROVENANCE"),
        sources.filter(~F.coalesce(F.col("read_only"), F.lit(False))).select(F.lit("SOURCE_READ_ONLY").alias("constraint"), F.col("source_system").alias("entity")),
        relations.filter("status = 'accepted'").join(predicates.select("predicate").distinct(), "predicate", "left_anti").select(F.lit("PREDICATE_REGISTERED").alias("constraint"), F.col("relation_id").cast("string").alias("entity")),
    ]
    return reduce(DataFrame.unionByName, parts)


def governance(assertions: DataFrame, contracts: DataFrame, devices: DataFrame, located: DataFrame, events: DataFrame, causal: DataFrame) -> DataFrame:
    """(issue, entity): assertions outside approved contracts, devices without a location, events without a cause."""
    allowed = contracts.filter("status = 'approved'").select("relation", "subject_type", "object_type").distinct()
    parts = [
        assertions.join(allowed, ["relation", "subject_type", "object_type"], "left_anti").select(F.lit("RELATION_CONTRACT").alias("issue"), F.col("assertion_id").cast("string").alias("entity")),
        devices.join(located.select("device_id").distinct(), "device_id", "left_anti").select(F.lit("LOCATION_GAP").alias("issue"), F.col("device_id").cast("string").alias("entity")),
        events.join(causal.select("event_id").distinct(), "event_id", "left_anti").select(F.lit("CAUSAL_GAP").alias("issue"), F.col("event_id").cast("string").alias("entity")),
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage_gaps(counts: Mapping[str, DataFrame]) -> DataFrame:
    """(gap, n) of each named set of rows that isn't empty; the sets are counted side by side."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("gap"), "n") for name, df in counts.items()]
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def registry_errors(aliases: Mapping[str, str], registered: Sequence[str], types: Mapping[str, tuple[str, str]], known_types: Sequence[str], namespaces: Mapping[str, str]) -> list[str]:
    """Faults of the small registries that the engine is started with."""
    out = [f"alias {a} has no target {b}" for a, b in sorted(aliases.items()) if b not in registered]
    out += [f"relation {r} has unknown type {x}" for r, pair in sorted(types.items()) for x in pair if x not in known_types]
    return out + [f"namespace {n} isn't an https address that ends in a slash" for n, u in sorted(namespaces.items()) if not (u.startswith("https://") and u.endswith("/"))]
