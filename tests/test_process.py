"""Facts, states, decisions and identity on the fixture tables of FIXTURES.md."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from semforge.operators import cleaning, decisions, events, facts, gates, identity, releases, rules, states
from semforge.storage import new_folder

T = lambda s: dt.datetime.fromisoformat(s)
STATE = "subject_key string, fact_id string, to_state string, event_type string, mapped boolean, effective_at timestamp, recorded_at timestamp, source_row_id string"


@pytest.fixture(scope="module")
def replayed(spark):
    rows = [
        ("D1", "CLOSED", "CLOSED", "DefectAcceptanceEvent", False, T("2024-01-05"), T("2024-01-05 00:01")),
        ("D1", "RESOLVED", "RESOLVED", "ResolutionEvent", False, T("2024-01-04"), T("2024-01-04 00:01")),
        ("D1", "PROCESSING", "PROCESSING", "DefectProcessingEvent", False, T("2024-01-03"), T("2024-01-03 00:01")),
        ("D1", "PENDING", "PENDING", "DefectAcceptedEvent", False, T("2024-01-02"), T("2024-01-02 00:01")),
        ("D1", "NEW", "NEW", "DefectCreatedEvent", False, T("2024-01-01"), T("2024-01-01 00:01")),
        ("D1", "LATE", "PENDING", "DefectAcceptedEvent", False, T("2024-01-01 12:00"), T("2024-02-01")),
        ("S1", "SNAP", "CLOSED", "defect", True, T("2024-02-01"), T("2024-02-01 00:01")),
        ("X1", "NOTIME", "NEW", "DefectCreatedEvent", False, None, T("2024-02-01 00:01")),
        ("X1", "BADSTATE", "NOWHERE", "DefectCreatedEvent", False, T("2024-02-01"), T("2024-02-01 00:01")),
    ]
    return spark.createDataFrame([(*r, r[1]) for r in rows], STATE)


def test_state_replay(replayed):
    moves, current = states.replay_states(replayed)
    rows = {r.fact_id: r for r in moves.collect()}
    assert [f for f, r in sorted(rows.items(), key=lambda x: str(x[1].effective_at)) if r.status == "accepted" and r.subject_key == "D1"] == ["NEW", "LATE", "PROCESSING", "RESOLVED", "CLOSED"]
    assert [f for f, r in rows.items() if r.late] == ["LATE"] and rows["PENDING"].reason == "invalid_transition"
    assert rows["SNAP"].reason == "approved_snapshot_seed" and rows["NOTIME"].reason == "missing_effective_at" and rows["BADSTATE"].reason == "invalid_transition"
    assert {r.subject_key: (r.state, r.version) for r in current.collect()} == {"D1": ("CLOSED", 5), "S1": ("CLOSED", 1)}
    assert states.run_status(moves) == "needs_review"
    assert {r.subject_key: (r.state, r.version) for r in states.folded_states(moves).collect()} == {"D1": ("CLOSED", 5), "S1": ("CLOSED", 1), "X1": (None, 0)}


@pytest.mark.parametrize("strict", [False, True])
def test_parallel_fold_is_the_sequential_one(spark, strict):
    """One subject with most of the facts, ties of time, unknown times and states: the scan over many tasks and the fold agree on every row."""
    rng = random.Random(5)
    kinds = [*states.EVENT_TYPES.values(), "other", None]
    rows = []
    for i in range(3000):
        to = rng.choice([*states.STATES[:6], "NOWHERE", None])
        fitting = [r for r in states.TRANSITIONS if r[2] == to]
        event = rng.choice(fitting)[1] if fitting and rng.random() < 0.8 else rng.choice(kinds)
        at = None if rng.random() < 0.05 else T("2024-01-01") + dt.timedelta(hours=rng.randrange(200))
        rows.append((rng.choice(["hot"] * 8 + ["a", "b", "c", None]), f"f{i}", to, event, rng.random() < 0.3, at, None if rng.random() < 0.05 else T("2024-01-01") + dt.timedelta(hours=rng.randrange(300)), f"s{i % 7}", *[rng.random() < 0.7 for _ in states.GUARDS]))
    df = spark.createDataFrame(rows, STATE + "".join(f", {g} boolean" for g in states.GUARDS))
    order = lambda r: (r[0] is not None, r[0] or "", r[5] is None, r[5] or T("1970-01-01"), r[6] is None, r[6] or T("1970-01-01"), r[7], r[1])
    in_order = pd.DataFrame(sorted(rows, key=order), columns=df.columns)
    want = pd.concat(states._fold(states.TRANSITIONS, states.STATES, strict)(iter([in_order])))
    flags = {r.fact_id: r.late for r in states.late_flags(df, ["subject_key"]).collect()}
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        moves = states.replay_states(df, strict_guards=strict)[0].collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    got = {r.fact_id: (r.from_state, r.transition_type, r.status, r.reason) for r in moves}
    none = lambda x: None if pd.isna(x) else x
    assert got == {r.fact_id: (none(r.from_state), r.transition_type, r.status, r.reason) for r in want.itertuples()}
    assert {r.fact_id: r.late for r in moves} == flags and sum(flags.values()) > 100


def test_hot_subject_is_dealt_over_tasks(spark, tmp_path):
    """The facts of one subject are folded by all tasks, and hardly any row comes to the driver."""
    facts = spark.range(40_000).selectExpr("'one' AS subject_key", "CAST(id AS string) AS fact_id", "element_at(array('NEW', 'PENDING', 'PROCESSING', 'RESOLVED', 'CLOSED'), CAST(id % 5 + 1 AS int)) AS to_state",
        "element_at(array('DefectCreatedEvent', 'DefectAcceptedEvent', 'DefectProcessingEvent', 'ResolutionEvent', 'DefectAcceptanceEvent'), CAST(id % 5 + 1 AS int)) AS event_type", "false AS mapped", "timestamp_seconds(id) AS effective_at", "timestamp_seconds(id) AS recorded_at", "'r' AS source_row_id")
    seen, carried = [], states._carried
    try:
        states._carried = lambda parts, identity: seen.append(parts) or carried(parts, identity)
        moves, current = states.replay_states(facts)
    finally:
        states._carried = carried
    assert len(seen[0]) == int(spark.conf.get("spark.sql.shuffle.partitions")) and {p["first_subject"] for p in seen[0]} == {"one"}
    assert moves.filter("status = 'accepted'").count() == 40_000 and current.first().version == 40_000


def test_scope_and_guards(replayed):
    assert {r.subject_key for r in states.replay_states(replayed, scope="S1")[0].collect()} == {"S1"}
    strict = states.replay_states(replayed, strict_guards=True)[0].filter("fact_id = 'LATE'").first()
    assert strict.status == "needs_review" and strict.reason == "guard_failed"
    open_ = states.replay_states(replayed.withColumn("review_accept_evidence", F.lit(True)), strict_guards=True)[0].filter("fact_id = 'LATE'").first()
    assert open_.status == "accepted"


def test_guards(spark):
    df = spark.createDataFrame([('{"team_num": "T"}', "x"), ('{"acceptance_pass": true}', None), ("bad", "ResolutionEvent"), ('{"status": "CONFIRMED"}', "y"), (None, None)], "c string, e string")
    g = states.guard_columns(F.col("c"), F.col("e"))
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in g.items()]).collect()]
    assert got == [(True, False, False, False), (False, False, True, False), (False, True, False, False), (False, False, False, True), (False, False, False, False)]


def test_fact_builders(spark):
    rows = [
        ("OBS1", "observation_event", "D", '{"temperature": 91, "unit": "C"}', "s", T("2024-01-01")),
        ("OBS2", "observation_event", "D", '{"temperature": 95, "unit": "C"}', "s", T("2024-01-02")),
        ("DEF1", "defect_event", "D", '{"description": "轴承温度高", "severity": "high"}', "s", T("2024-01-01 01:00")),
        ("DEF2", "defect_event", "D", '{"description": " 轴承温度高 ", "severity": "HIGH"}', "s", T("2024-01-10 01:00")),
        ("DEF3", "defect_event", "E", '{"description": "a"}', "s", T("2024-01-01")),
        ("DEF4", "defect_event", "E", '{"description": "a"}', "s", T("2024-01-31")),
        ("DEF5", "defect_event", "F", '{"description": "a"}', "s", T("2024-01-01")),
        ("DEF6", "defect_event", "F", '{"description": "a"}', "s", T("2024-01-31 00:00:01")),
        *[(f"BAD{i}", "observation_event", "G", v, "s", None) for i, v in enumerate(['{"value": "NaN", "unit": "C"}', '{"value": 5}', "bad", "[]", "{}", '{"measurements": [{"metric": "flow", "value": "2", "unit": "l"}, {"value": "x", "unit": "l"}]}', None])],
    ]
    out = facts.build(spark.createDataFrame(rows, "fact_id string, fact_type string, subject_key string, value string, source_snapshot_id string, observed_at timestamp"))
    n = {k: v.filter("subject_key = 'D'").count() for k, v in out.items()}
    assert n == {"measurement": 2, "review": 0, "history_stat": 1, "trend": 1, "severe_defect": 2, "repeated_defect": 1, "risk_assessment": 1}
    h, t, r = (out[k].filter("subject_key = 'D'").first() for k in ("history_stat", "trend", "risk_assessment"))
    assert (h.mean, t.delta, t.direction, r.risk_score) == (93.0, 4.0, "up", 5)
    assert {x.subject_key for x in out["repeated_defect"].collect()} == {"D", "E"}
    assert {x.reason for x in out["review"].collect()} == {"not_a_finite_number", "missing_unit"} and out["measurement"].filter("subject_key = 'G'").count() == 1


def test_decisions_and_sticky_plans(spark):
    s = spark.createDataFrame([("V", "PENDING"), ("W", "CLOSED")], "subject_key string, state string")
    r = spark.createDataFrame([("V", "old", 5, T("2024-01-01")), ("V", "new", 3, T("2024-01-02")), ("V", "low", 2, T("2024-01-03")), ("W", "x", 5, T("2024-01-01"))], "subject_key string, fact_id string, risk_score int, created_at timestamp")
    d = decisions.decide(s, r)
    assert [(x.subject_key, x.risk_fact_id) for x in d.collect()] == [("V", "new")]
    plans = decisions.plan_actions(d)
    plan = plans.first()
    assert plan.status == "PENDING_APPROVAL"
    approved = decisions.review_plan(plans, plan.plan_id, "APPROVED")
    again = decisions.plan_actions(d, approved).collect()
    assert [(x.plan_id, x.status) for x in again] == [(plan.plan_id, "APPROVED")]
    assert decisions.unbound(d, plans).count() == 0


def test_rule_table(spark):
    s = spark.createDataFrame([("V", "PENDING"), ("W", "CLOSED"), (None, "PENDING")], "subject_key string, state string")
    r = spark.createDataFrame([("V", "f1", "risk", "p", 5, T("2024-01-01")), ("V", "f2", "risk", "p", 3, T("2024-01-02")), ("V", "f3", "risk", "q", 9, T("2024-01-03")), ("V", "f4", "risk", "p", None, T("2024-01-04")), ("W", "f5", "risk", "p", 9, T("2024-01-01")), (None, "f6", "risk", "p", 9, T("2024-01-01"))], "subject_key string, fact_id string, fact_type string, predicate string, risk_score int, created_at timestamp")
    rules = spark.createDataFrame([("R1", "v1", "PENDING", "risk", "p", 3, "check", "d", True, "enabled"), ("R2", "v2", "PENDING", "risk", "p", 5, "fix", "d", True, "enabled"), ("R3", "v3", "CLOSED", "risk", "q", 1, "x", "d", True, "enabled"), ("R4", "v4", "CLOSED", "risk", "p", 1, "x", "d", True, "disabled")], "rule_id string, rule_version string, input_state string, risk_fact_type string, risk_predicate string, min_risk_score int, action_type string, target_type string, requires_approval boolean, status string")
    out = decisions.decide_by_rules(s, r, rules).collect()
    assert {(x.rule_id, x.subject_key, x.risk_fact_id, x.risk_score, x.action_type) for x in out} == {("R1", "V", "f2", 3, "check"), ("R2", "V", "f1", 5, "fix")}
    assert len({x.decision_id for x in out}) == 2 and decisions.plan_actions(decisions.decide_by_rules(s, r, rules)).count() == 2
    assert decisions.decide_by_rules(s, r, rules.limit(0)).count() == 0


def test_identity_cascade(spark):
    d = spark.createDataFrame([("d1", "S", "1", "L1", "Main Pump"), ("d2", "S", "2", "L2", "Fan"), ("d3", "S", "3", "L2", "Valve"), ("d4", "S", "3", "L4", "Fan")], "device_id string, site string, asset string, location string, text string")
    r = spark.createDataFrame([(1, "S", "1", None, None), (2, "S", "9", "L1", None), (3, "S", None, "L1", "main-pump"), (4, "S", None, "L1", "other"), (5, "S", None, None, "Valve"), (6, "S", " ", "L2", "Fan"), (7, None, "1", None, None), (8, "S", "3", None, None)], "record_id int, site string, asset string, location string, text string")
    got = {x.record_id: (x.score, x.decision, x.candidate_id) for x in identity.match_identity(r, d).collect()}
    assert got == {1: (1.0, "accepted", "d1"), 2: (0.0, "needs_review", None), 3: (0.95, "needs_review", "d1"), 4: (0.86, "needs_review", "d1"), 5: (0.78, "needs_review", "d3"), 6: (0.0, "blocked", None), 7: (0.0, "blocked", None), 8: (0.0, "needs_review", None)}


def test_cross_system_never_merges(spark):
    d = spark.createDataFrame([("A", "S", "1", "x"), ("B", "S", "1", "y"), ("B", "T", "1", "z"), ("A", "", "2", "v"), ("B", "", "2", "w")], "source_schema string, site string, asset string, device_id string")
    out = identity.cross_system(d).collect()
    assert [(o.left_id, o.right_id, o.score, o.decision, o.automatic_merge) for o in out] == [("x", "y", 0.98, "needs_review", False)]


def test_rules(spark):
    df = spark.createDataFrame([(0, "  a（b） "), (1, None), (2, "10KV bus"), (3, "plain")], "i int, x string")

    def run(rule):
        return [(r.m, r.t, r.r) for r in df.orderBy("i").select(rules.transform(F.col("x"), rule).alias("o")).select(F.col("o.matched").alias("m"), F.col("o.text").alias("t"), F.col("o.reason").alias("r")).collect()]

    assert run(rules.Rule("r", "trim"))[0] == (True, "a（b）", "trim")
    assert run(rules.Rule("r", "normalize", parameters={"mode": "nfkc_whitespace"}))[0] == (True, "a(b)", "normalize")
    assert run(rules.Rule("r", "replace", {"prefix": "10"}, {"from": "KV", "to": "kV"})) == [(False, "  a（b） ", "prefix_not_matched"), (False, "", "prefix_not_matched"), (True, "10kV bus", "replace"), (False, "plain", "prefix_not_matched")]
    assert run(rules.Rule("r", "trim", {"descriptionPattern": "x"}))[0][2] == "unsupported_description_pattern"
    for bad in (("drop", {}, {}), ("replace", {}, {}), ("replace", {}, {"from": "a", "to": "a"}), ("trim", {"what": 1}, {}), ("normalize", {}, {"mode": "x"}), ("replace", {}, {"from": "a" * 81, "to": ""})):
        with pytest.raises(rules.RuleError):
            rules.Rule("r", bad[0], bad[1], bad[2])


def test_difference_class(spark):
    rows = [("给水泵", "1号给水泵房", "LOCATION_DESCRIPTION_CONTAINS_DEVICE"), ("1号给水泵电机", "给水泵", "DEVICE_DESCRIPTION_CONTAINS_LOCATION"), ("", "x", "NOT_COMPARABLE"), (None, None, "NOT_COMPARABLE"), ("abcdef", "abcdxy", "PARTIAL_TEXT_OVERLAP"), ("abc", "xyz", "LOW_TEXT_OVERLAP"), ("same", "SAME", "HIGH_TEXT_OVERLAP")]
    df = spark.createDataFrame(rows, "a string, b string, w string")
    assert all(r.got == r.w for r in df.select("w", cleaning.difference_class(F.col("a"), F.col("b"))["difference"].alias("got")).collect())


def test_status_review(spark):
    d = spark.createDataFrame([("F", "CLOSED", 1, "draft"), ("O", "NEW", 1, "approved")], "raw_status string, canonical_state string, mapping_version int, review_status string")
    after, audit = events.status_review(d, "F", "UNKNOWN", "me")
    assert [(r.mapping_version, r.canonical_state, r.review_status) for r in after.filter("raw_status = 'F'").collect()] == [(2, "UNKNOWN", "approved")] and audit.count() == 1


def test_review_gate_and_ledger(spark):
    c = spark.createDataFrame([("c1", "pending", "pass"), ("c2", "approved", "pass"), ("c3", "pending", "fail")], "candidate_id string, review_state string, validator_status string")
    r = spark.createDataFrame([("k1", "c1", "approve", None, "text"), ("k2", "c2", "approve", None, "text"), ("k3", "c3", "approve", None, "t"), ("k4", "c1", "reject", " ", None), ("k0", "c1", "approve", None, "t"), ("k5", "zz", "approve", None, "t")], "request_key string, candidate_id string, decision string, note string, description string")
    receipts = spark.createDataFrame([("k0",)], "request_key string")
    ok, refused = gates.review_gate(r, c, receipts)
    assert [x.request_key for x in ok.collect()] == ["k1"]
    assert {x.request_key: x.reasons for x in refused.collect()}["k4"] == ["NOTE_MISSING"]
    assert gates.record_once(receipts, ok.select("request_key")).count() == 2 == gates.record_once(gates.record_once(receipts, ok.select("request_key")), ok.select("request_key")).count()


def test_releases(spark):
    folder = new_folder(spark, "releases")
    r = releases.Releases(spark, folder)
    df, other = spark.range(3), spark.range(5)
    with pytest.raises(releases.ReleaseError):
        r.rows()
    a, b = r.prepare(df, {"v": 1}), r.prepare(other, {"v": 1})
    assert r.prepare(df.repartition(2), {"v": 1}) == a != r.prepare(df, {"v": 2})
    for x in (a, "REL-none"):
        with pytest.raises(releases.ReleaseError):
            r.activate(x)
    for x in (a, b):
        r.approve(x, "me")
        r.activate(x)
        r.activate(x)
    assert r.active == b and r.rows().count() == 5 and r.rollback() == a and r.active == a and r.rows().count() == 3
    with pytest.raises(releases.ReleaseError):
        r.rollback()
    assert [(x.event, x.release) for x in releases.Releases(spark, folder).ledger.orderBy("seq").collect() if x.event not in ("prepared", "approved")] == [("activated", a), ("backed_up", a), ("activated", b), ("rolled_back", a)]
    df.limit(1).write.mode("overwrite").parquet(f"{folder}/{b}")
    with pytest.raises(releases.ReleaseError, match="changed"):
        r.activate(b)
    assert r.active == a


def test_ends_of_tasks_sort_no_facts(spark, replayed, monkeypatch):
    """What tasks tell of their first and last subjects is read by hash aggregates and lookups: facts aren't sorted for it again."""
    plans, cut = [], states.cut_lineage
    monkeypatch.setattr(states, "cut_lineage", lambda df, name="step": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or cut(df, name))
    states.replay_states(replayed)
    assert len(plans) > 1 and not any("SortAggregate" in x or "Sort [" in x for name, x in plans if name != "replay" and name != "ends")
    assert "ends" not in dict(plans) or "Aggregate" not in dict(plans)["ends"]
