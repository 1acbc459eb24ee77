"""Decisions from states and risks, and action plans that keep what a reviewer has decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.functions.ids import stable_id

#: Plans in these states are never overwritten by a new run.
STICKY = ("APPROVED", "REJECTED", "CANCELLED")


def decide(states: DataFrame, risks: DataFrame, state: str = "PENDING", least_score: int = 3, rule_id: str = "ACT-1") -> DataFrame:
    """Subjects in the state that have a risk fact (subject_key, fact_id, risk_score, created_at) of the score: the latest such counts."""
    latest = risks.filter(F.col("risk_score") >= least_score).groupBy("subject_key").agg(F.max(F.struct("created_at", "fact_id", "risk_score")).alias("r")).select("subject_key", F.col("r.fact_id").alias("risk_fact_id"), F.col("r.risk_score").alias("risk_score"))
    out = states.filter(F.col("state") == state).join(latest, "subject_key")
    return out.select(stable_id("DEC", F.lit(rule_id), F.col("subject_key"), F.col("risk_fact_id")).alias("decision_id"), F.lit(rule_id).alias("rule_id"), "subject_key", "state", "risk_fact_id", "risk_score", F.lit("planned").alias("outcome"))


def decide_by_rules(states: DataFrame, risks: DataFrame, rules: DataFrame) -> DataFrame:
    """Decisions of a table of rules, of which only enabled ones count: (rule_id, rule_version, input_state, risk_fact_type,
    risk_predicate, min_risk_score, action_type, target_type, requires_approval, status).

    A rule decides for each subject in its state that has a risk fact (subject_key, fact_id, fact_type, predicate, risk_score, created_at)
    of its type and predicate with its least score: the latest such, ties to the greater id. A missing score is no risk. Subjects, facts
    and rules meet in joins, so neither many rules nor a subject with very many facts comes to one task whole.
    """
    enabled = rules.filter("status = 'enabled'").drop("status")
    at = F.struct("created_at", "fact_id", "risk_score")
    kinds = (F.col("fact_type") == F.col("risk_fact_type")) & (F.col("predicate") == F.col("risk_predicate")) & (F.col("risk_score") >= F.col("min_risk_score"))
    latest = risks.join(enabled.select("rule_id", "rule_version", "risk_fact_type", "risk_predicate", "min_risk_score"), kinds).groupBy("rule_id", "rule_version", "subject_key").agg(F.max(at).alias("r"))
    matched = states.join(enabled, F.col("state") == F.col("input_state")).join(latest, ["rule_id", "rule_version", "subject_key"])
    decision = stable_id("DEC", F.col("rule_version"), F.col("subject_key"), F.col("r.fact_id"))
    return matched.select(decision.alias("decision_id"), "rule_id", "rule_version", "subject_key", "state", F.col("r.fact_id").alias("risk_fact_id"), F.col("r.risk_score").alias("risk_score"), "action_type", "target_type", "requires_approval", F.lit("planned").alias("outcome"))


def plan_actions(decisions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One plan for each decision's key. A plan that a reviewer has closed keeps its status; nothing is executed."""
    new = decisions.select(stable_id("PLAN", F.col("decision_id")).alias("plan_id"), "decision_id", "subject_key", F.when(F.col("outcome") == "planned", "PENDING_APPROVAL").otherwise("DRAFT").alias("status"), F.lit(False).alias("source_write"))
    if existing is None:
        return new
    old = existing.select("plan_id", F.col("status").alias("_old"))
    return new.join(old, "plan_id", "left").withColumn("status", F.when(F.col("_old").isin(*STICKY), F.col("_old")).otherwise(F.col("status"))).drop("_old")


def unbound(decisions: DataFrame, plans: DataFrame) -> DataFrame:
    return decisions.join(plans.select("decision_id"), "decision_id", "left_anti")


def preview_gate(plans: DataFrame) -> DataFrame:
    """Adds gate: blocked without an approval or a subject, needs_review without evidence, else ready."""
    gate = F.when(F.col("subject_key").isNull() | F.col("status").isin("REJECTED", "CANCELLED", "DRAFT"), "blocked").when((F.col("status") != "APPROVED") | F.col("risk_fact_id").isNull(), "needs_review").otherwise("ready")
    return plans.withColumn("gate", gate)


def review_plan(plans: DataFrame, plan_id: str, decision: str) -> DataFrame:
    """The plans after one that waits is approved, rejected or cancelled; closed ones don't change."""
    if decision not in STICKY:
        raise ValueError(f"no decision {decision}")
    return plans.withColumn("status", F.when((F.col("plan_id") == plan_id) & (F.col("status") == "PENDING_APPROVAL"), decision).otherwise(F.col("status")))
