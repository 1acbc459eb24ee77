"""Knowledge assets, machine contracts, registered relations and the assertions that links stand for."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.functions.ids import snake_case, stable_id

#: Stable relation keys and other spellings of them; the relation of each kind of link.
ALIASES = {"has_inspection": "device_has_inspection", "has_defect": "device_has_defect", "has_work_order": "device_has_work_order", "located_at": "device_located_at", "parent_of": "device_parent_of"}
LINK_RELATIONS = {"inspection": "device_has_inspection", "defect": "device_has_defect", "work_order": "device_has_work_order"}


def assets(parts: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(assets, issues) of kinds of rows (key, title, status, source): the first of equal keys is an asset, the others are issues."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "key", "title", "status", "source") for kind, df in parts.items()])
    rows = rows.withColumn("asset_id", stable_id("KA", F.col("kind"), F.col("key")))
    counted = rows.groupBy("asset_id").agg(F.min(F.struct("source", "title", "status", "kind", "key")).alias("f"), F.count("*").alias("n"))
    return counted.select("asset_id", "f.kind", "f.key", "f.title", "f.status", "f.source", F.lit(1).alias("version")), counted.filter("n > 1").select("asset_id", F.lit("DUPLICATE_PROPOSAL").alias("issue"), "n")


def machine_contracts(versions: DataFrame) -> DataFrame:
    """Asset versions (asset_id, version, kind, title, operation) to contracts as JSON: understanding, decision, calculation, constraints, action."""
    limits = F.array(*[F.lit(x) for x in ("read_only_source", "no_automatic_merge", "evidence_required", "human_approval", "replay_required", "versioned_rule", "no_direct_publication")])
    return versions.select(
        stable_id("MC", F.col("asset_id"), F.col("version")).alias("contract_id"),
        "asset_id",
        "version",
        F.to_json(F.struct("kind", "title")).alias("understanding"),
        F.to_json(F.struct(F.when(F.col("kind") == "rule", "rule_match").otherwise("reference").alias("mode"), F.lit("needs_review").alias("on_missing"))).alias("decision"),
        F.to_json(F.struct(F.coalesce("operation", F.lit("none")).alias("operation"))).alias("calculation"),
        F.to_json(limits).alias("constraints"),
        F.to_json(F.struct(F.when(F.col("kind") == "rule", "propose").otherwise("inform").alias("action"), F.lit(False).alias("source_write"))).alias("action"),
    )


def discover(seen: DataFrame, column: str, registry: DataFrame, key: str) -> DataFrame:
    """Names that data has and the registry doesn't, as rows for review; never accepted."""
    known = registry.select(F.col(key).alias("_k")).distinct()
    out = seen.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return out.join(known, F.col("name") == F.col("_k"), "left_anti").withColumn("status", F.lit("needs_review"))


def registry_gaps(registry: DataFrame, key: str, seen: DataFrame, column: str) -> DataFrame:
    """Registered names with how often data has them."""
    counts = seen.groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))
    return registry.join(counts, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("gap"))


def normalize_relations(df: DataFrame, column: str, registered: tuple[str, ...] = tuple(ALIASES.values())) -> DataFrame:
    """Spellings of a relation to its stable key; an unknown one fails when its row is read."""
    name = snake_case(F.trim(column))
    known = F.create_map(*[F.lit(x) for kv in (ALIASES | {r: r for r in registered}).items() for x in kv])
    key = F.element_at(known, name)
    return df.withColumn("relation_key", F.when(key.isNotNull(), key).otherwise(F.raise_error(F.concat(F.lit("unknown relation "), F.col(column)))))


def link_assertions(links: DataFrame) -> DataFrame:
    """Links (link_id, kind, device_id, record_id) to relation assertions; unknown kinds and links without a device are skipped."""
    relation = F.element_at(F.create_map(*[F.lit(x) for kv in LINK_RELATIONS.items() for x in kv]), F.col("kind"))
    out = links.withColumn("relation", relation).filter("relation IS NOT NULL AND device_id IS NOT NULL")
    return out.select(stable_id("REL", F.col("relation"), F.col("device_id"), F.col("record_id")).alias("assertion_id"), "relation", F.col("device_id").alias("subject_key"), F.col("record_id").alias("object_key"))
