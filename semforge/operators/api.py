"""The read surface: a resource is a table with its columns' roles, and has a summary, a list and a detail.

Routes differ in these roles alone, so they are data. Every answer says that nothing was written to a source and nothing published.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.operators import decisions, events, gates, identity, reads, rules, states, validation
from semforge.rdf import project


@dataclass(frozen=True)
class Resource:
    """Roles of a table's columns. ``children`` maps a list's name to (table, order, most rows)."""

    table: str
    key: str
    kind: str
    status: str
    searched: tuple[str, ...]
    order: tuple[str, ...]
    children: Mapping[str, tuple[str, tuple[str, ...], int]] = field(default_factory=dict)


#: Resources of the surface by the last part of their path.
RESOURCES = {
    "unified-devices": Resource("unified_device", "device_id", "source_schema", "status", ("device_id", "asset", "name", "location"), ("source_schema", "asset"), {"events": ("device_event", ("occurred_at", "event_id"), 50), "locations": ("function_location", ("code",), 20)}),
    "unified-locations": Resource("function_location", "location_id", "source_schema", "status", ("code", "description"), ("source_schema", "code"), {"devices": ("unified_device", ("asset",), 50)}),
    "knowledge-assets": Resource("knowledge_asset", "asset_id", "kind", "status", ("title", "key"), ("kind", "key"), {"versions": ("knowledge_version", ("version",), 50)}),
    "semantic-facts": Resource("fact", "fact_id", "fact_type", "status", ("subject_key", "predicate", "fact_type"), ("created_at", "fact_id"), {"derivations": ("derivation", ("derivation_id",), 50)}),
    "semantic-status-dictionary": Resource("status_dictionary", "status_id", "canonical_state", "review_status", ("raw_status", "canonical_state"), ("source_schema", "raw_status")),
    "semantic-states": Resource("state", "subject_key", "state", "status", ("subject_key",), ("subject_key",)),
    "semantic-events": Resource("event", "event_id", "event_type", "status", ("event_type", "subject_key", "record_id"), ("occurred_at", "event_id"), {"facts": ("fact", ("created_at", "fact_id"), 50)}),
    "semantic-decisions": Resource("decision", "decision_id", "rule_id", "outcome", ("subject_key", "rule_id"), ("decision_id",), {"plans": ("plan", ("plan_id",), 20)}),
    "semantic-action-plans": Resource("plan", "plan_id", "rule_id", "status", ("subject_key", "plan_id"), ("plan_id",), {"approvals": ("approval", ("approval_id",), 20)}),
    "object-types": Resource("object_type", "object_type", "parent", "status", ("object_type", "label"), ("object_type",)),
    "relation-types": Resource("relation_type", "relation_key", "subject_type", "status", ("relation_key", "label"), ("relation_key",)),
    "event-types": Resource("event_type", "event_type", "parent", "status", ("event_type", "label"), ("event_type",)),
    "candidates": Resource("candidate", "candidate_id", "site", "review_state", ("candidate_id", "original", "proposed", "asset"), ("site", "candidate_id"), {"reviews": ("review", ("created_at", "request_key"), 50)}),
    "published": Resource("publication", "publication_id", "site", "status", ("original", "proposed"), ("published_at", "publication_id")),
    "formal-approval-queue": Resource("approval_queue", "candidate_id", "site", "state", ("original", "proposed"), ("site", "candidate_id")),
    "cleaning-tasks": Resource("cleaning_task", "task_id", "rule_id", "status", ("task_id", "rule_id"), ("task_id",)),
    "cleaning-rules": Resource("cleaning_rule", "rule_id", "operation", "status", ("rule_id", "operation"), ("rule_id",)),
    "rule-proposals": Resource("rule_proposal", "proposal_id", "operation", "status", ("proposal_id", "operation"), ("proposal_id",)),
    "identity-review": Resource("identity_assertion", "assertion_id", "decision_mode", "status", ("assertion_id", "source_record_id"), ("status", "assertion_id")),
    "replay-diffs": Resource("state_diff", "subject_key", "change", "change", ("subject_key",), ("subject_key",)),
    "clusters": Resource("cluster", "cluster_id", "cluster", "status", ("cluster", "cluster_id"), ("cluster", "cluster_id")),
    "coverage": Resource("coverage_gap", "gap", "severity", "status", ("gap",), ("severity", "gap")),
    "releases": Resource("release", "release_id", "status", "status", ("release_id",), ("release_id",)),
    "metadata": Resource("metadata_entry", "row_id", "kind", "category", ("key", "name", "label", "description", "table_name", "category"), ("kind", "key", "row_id")),
}
Tables = Mapping[str, DataFrame]


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumns({"source_write": F.lit(False), "formal_publication": F.lit(False)})


def summary(name: str, tables: Tables) -> DataFrame:
    """(kind, status, n) of a resource."""
    r = RESOURCES[name]
    rows = tables[r.table].select(F.col(r.kind).cast("string").alias("kind"), F.col(r.status).cast("string").alias("status"))
    return _marked(reads.counts_by(rows, "kind", "status"))


def listing(name: str, tables: Tables, filters: Mapping[str, object] | None = None, term: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """A page of a resource, filtered and searched, in its total order, with the number of each child of the page's rows."""
    r = RESOURCES[name]
    df = tables[r.table]
    found = reads.search(reads.facet_filter(df, filters or {}), term, [c for c in r.searched if c in df.columns])
    out = reads.page(found, [F.col(c) for c in dict.fromkeys((*r.order, r.key)) if c in df.columns], number, size)
    for child, (table, _, _) in r.children.items():
        if table in tables and r.key in tables[table].columns:
            counts = tables[table].join(out.select(r.key).distinct(), r.key, "left_semi").groupBy(r.key).agg(F.count("*").alias(f"n_{child}"))
            out = out.join(counts, r.key, "left").fillna(0, [f"n_{child}"])
    return _marked(out)


def detail(name: str, tables: Tables, value: object) -> DataFrame:
    """One row of a resource with ordered, bounded lists of its children."""
    r = RESOURCES[name]
    children = {c: (tables[t], [F.col(x).desc_nulls_last() if x.endswith("_at") else F.col(x) for x in order if x in tables[t].columns], most) for c, (t, order, most) in r.children.items() if t in tables and r.key in tables[t].columns}
    return _marked(reads.detail(tables[r.table], r.key, value, children))


def facets(name: str, tables: Tables, columns: Sequence[str] | None = None) -> DataFrame:
    """(facet, value, n) of a resource's kind and status, or of other columns."""
    r = RESOURCES[name]
    return reads.metadata_summary(tables[r.table], columns or list(dict.fromkeys((r.kind, r.status))))


#: What each of the surface's commands does: pure functions of DataFrames, recorded by the caller.
COMMANDS: dict[str, Callable] = {
    "status-dictionary/replay": events.map_statuses,
    "status-dictionary/review": events.status_review,
    "semantic-states/replay": states.replay_states,
    "semantic-execution/preview": decisions.preview_gate,
    "semantic-execution/dispatch": decisions.plan_actions,
    "semantic-action-plans/approval": decisions.review_plan,
    "semantic-reasoning/analyze": rules.mine_rules,
    "rule-agent/discover": rules.mine_rules,
    "rule-agent/proposals/preview": rules.impact,
    "rule-agent/proposals/replay": rules.replay_rule,
    "rule-agent/proposals/confirm": gates.rule_from_proposal,
    "rule-agent/proposals/queue": rules.import_queue,
    "rule-agent/ai-review": gates.verdict_gate,
    "ai-review/auto-approve": gates.auto_approve,
    "ai-review/decision": gates.record_once,
    "reviews": gates.review_gate,
    "cleaning/replay": rules.replay_cleaning,
    "cleaning/publish": gates.publish,
    "identity/revoke": identity.set_lifecycle,
    "identity-review/decide": identity.set_lifecycle,
    "world-model/coverage": validation.coverage_gaps,
    "world-model/device/context": project.device_context,
    "world-model/facts/explain": project.explain,
    "semantic/canonical/statements": project.statements,
    "semantic/canonical/device": project.document,
    "semantic/canonical/summary": project.graph_counts,
    "semantic/source-of-truth": project.truth_coverage,
}
