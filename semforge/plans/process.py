"""E, B, T and G operators over the driver's tables: events as observations and defects, orders as work orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from semforge.operators import decisions, events, facts, merkle, reads, states
from semforge.plans.tables import t
from semforge.registry import register
from semforge.storage import new_folder
from semforge.streaming import upsert


def observations(spark, sf):
    """events as observed facts: clicks and views measure, errors are defects."""
    e = t(spark, sf, "events")
    unit = F.when(F.col("event_type") == "click", "C").when(F.col("event_type") == "view", "kW")
    value = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.when(F.col("value") > 60, "high").otherwise("low").alias("severity"), F.concat(F.lit("code "), F.floor(F.col("value") / 10).cast("string")).alias("description")))).otherwise(F.to_json(F.struct(F.col("value").alias("temperature"), unit.alias("unit"))))
    return e.select(F.concat(F.lit("E"), F.col("event_id")).alias("fact_id"), F.when(F.col("event_type") == "error", "defect_event").otherwise("observation_event").alias("fact_type"), F.concat(F.lit("U"), F.col("user_id")).alias("subject_key"), value.alias("value"), F.lit("snap-1").alias("source_snapshot_id"), F.col("ts").cast("timestamp").alias("observed_at"))


_M = "(SELECT concat('U', user_id) AS subject_key, 'temperature' AS metric, CASE WHEN event_type = 'click' THEN 'C' WHEN event_type = 'view' THEN 'kW' END AS unit, value AS number, ts, event_id FROM events WHERE event_type <> 'error')"


@register("B1_measurements", f"SELECT subject_key, metric, unit, number FROM {_M} WHERE unit IS NOT NULL")
def b1(spark, sf):
    return facts.build(observations(spark, sf))["measurement"].select("subject_key", "metric", "unit", "number")


@register("B1_review", f"SELECT subject_key, 'missing_unit' AS reason, count(*) AS n FROM {_M} WHERE unit IS NULL GROUP BY 1")
def b1_review(spark, sf):
    return facts.build(observations(spark, sf))["review"].groupBy("subject_key", "reason").agg(F.count("*").alias("n"))


@register("B2_history_stat", f"SELECT subject_key, metric, unit, count(*) AS n, min(number) AS low, max(number) AS high, round(avg(number), 6) AS mean FROM {_M} WHERE unit IS NOT NULL GROUP BY ALL")
def b2(spark, sf):
    return facts.build(observations(spark, sf))["history_stat"].select("subject_key", "metric", "unit", "n", "low", "high", F.round("mean", 6).alias("mean"))


@register("B3_trend", f"SELECT subject_key, unit, n, round(l - f, 6) AS delta, CASE WHEN l > f THEN 'up' WHEN l < f THEN 'down' ELSE 'flat' END AS direction FROM (SELECT subject_key, unit, count(*) AS n, arg_min(number, ts) AS f, arg_max(number, ts) AS l FROM {_M} WHERE unit IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)")
def b3(spark, sf):
    return facts.build(observations(spark, sf))["trend"].select("subject_key", "unit", "n", F.round("delta", 6).alias("delta"), "direction")


@register("B4_severe", "SELECT concat('E', event_id) AS fact_id FROM events WHERE event_type = 'error' AND value > 60")
def b4(spark, sf):
    return facts.build(observations(spark, sf))["severe_defect"].select("fact_id")


_REP = """(SELECT subject_key, text, min(ts) AS start FROM (SELECT concat('U', user_id) AS subject_key, concat('code ', CAST(floor(value / 10) AS BIGINT)) AS text, ts,
  count(*) OVER (PARTITION BY user_id, floor(value / 10) ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAY FOLLOWING) AS c FROM events WHERE event_type = 'error') WHERE c >= 2 GROUP BY ALL)"""


@register("B5_repeated", f"SELECT subject_key, text, start FROM {_REP}")
def b5(spark, sf):
    return facts.build(observations(spark, sf))["repeated_defect"].select("subject_key", "text", F.col("start").cast("timestamp_ntz").alias("start"))


@register(
    "B6_risk",
    f"""SELECT subject_key, count(*) AS n_evidence, least(5, greatest(CASE WHEN max(hot) = 1 THEN 4 ELSE 3 END, count(*) + 2))::BIGINT AS risk_score FROM (
    SELECT subject_key, 1 AS hot FROM {_M} WHERE unit = 'C' AND number >= 80 UNION ALL SELECT concat('U', user_id), 0 FROM events WHERE event_type = 'error' AND value > 60 UNION ALL SELECT subject_key, 0 FROM {_REP}) GROUP BY 1""",
)
def b6(spark, sf):
    return facts.build(observations(spark, sf))["risk_assessment"].select("subject_key", "n_evidence", "risk_score")


def records(spark, sf):
    o = t(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "inspection").when(F.col("o_orderstatus") == "O", "defect").otherwise("survey")
    return o.select(kind.alias("kind"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").cast("string").alias("candidate_id"), F.when(F.col("o_totalprice") > 50000, "accepted").otherwise("needs_review").alias("identity_status"), F.col("o_orderdate").alias("occurred_at"), F.lit("S1").alias("source_schema"), F.lit("snap-1").alias("source_snapshot_id"))


_EV = """(SELECT concat('EVT-', substr(sha256(concat('S1|', kind, '|', o_orderkey, '|snap-1')), 1, 24)) AS event_id, CASE kind WHEN 'inspection' THEN 'InspectionEvent' WHEN 'defect' THEN 'DefectCreatedEvent' ELSE kind END AS event_type,
  CASE WHEN o_totalprice > 50000 THEN CAST(o_custkey AS VARCHAR) END AS subject_key, CASE WHEN o_totalprice > 50000 THEN 'accepted' ELSE 'needs_review' END AS status, o_orderdate AS occurred_at, CAST(o_orderkey AS VARCHAR) AS record_id
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'inspection' WHEN 'O' THEN 'defect' ELSE 'survey' END AS kind FROM orders))"""


@register("E2_project_events", f"SELECT event_id, event_type, subject_key, status FROM {_EV}")
def e2(spark, sf):
    return events.project_events(records(spark, sf)).select("event_id", "event_type", "subject_key", "status")


@register("E3_provenance", f"SELECT event_id, sha256(concat('S1|', record_id, '|snap-1')) AS provenance_hash, lag(event_id) OVER (PARTITION BY subject_key ORDER BY occurred_at NULLS LAST, event_id) AS previous_event_id FROM {_EV}")
def e3(spark, sf):
    return events.with_provenance(events.project_events(records(spark, sf))).select("event_id", "provenance_hash", "previous_event_id")


@register("E1_relation_facts", "SELECT concat('FACT-', substr(sha256(concat('device_has_defect|', o_custkey, '|', o_orderkey, '|snap-1')), 1, 24)) AS fact_id, 'defect_event' AS fact_type, CAST(o_custkey AS VARCHAR) AS subject_key FROM orders WHERE o_orderstatus = 'O'")
def e1(spark, sf):
    o = t(spark, sf, "orders")
    r = o.select(F.when(F.col("o_orderstatus") == "O", "device_has_defect").otherwise("other").alias("relation_key"), F.lit("device").alias("subject_type"), F.col("o_custkey").cast("string").alias("subject_key"), F.col("o_orderkey").cast("string").alias("object_key"), F.lit("accepted").alias("status"), F.lit("snap-1").alias("source_snapshot_id"))
    return events.relation_facts(r).select("fact_id", "fact_type", "subject_key")


def _defects(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("fact_id"), F.col("o_custkey").cast("string").alias("subject_key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("raw_status"))


@register("E4_status_facts", "SELECT CAST(o_orderkey AS VARCHAR) AS source_fact_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS raw_status, o_orderstatus <> 'P' AS status_present FROM orders")
def e4(spark, sf):
    return events.status_facts(_defects(spark, sf)).select("source_fact_id", "raw_status", "status_present")


@register("E5_reasoning", "SELECT 'R1' AS rule_id, CASE WHEN o_orderstatus <> 'P' THEN 'derived' ELSE 'needs_review' END AS outcome, count(*) AS n FROM orders GROUP BY 2")
def e5(spark, sf):
    f = _defects(spark, sf).select("fact_id", F.lit("defect_status").alias("fact_type"), F.col("raw_status").alias("value"))
    rules = spark.createDataFrame([("defect_status", "R2", "x", "1"), ("defect_status", "R1", "defect_state", "2")], "input_fact_type string, rule_id string, output_fact_type string, rule_version string")
    return events.derive(f, rules)[0].groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))


@register("E6_status_mapping", "SELECT CAST(o_orderkey AS VARCHAR) AS source_fact_id, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' ELSE 'PENDING' END AS canonical_state, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END::INTEGER AS mapping_version FROM orders WHERE o_orderstatus <> 'P'")
def e6(spark, sf):
    d = spark.createDataFrame([("S1", "orders", "F", "s", 1, "RESOLVED", "approved"), ("S1", "orders", "F", "s", 2, "CLOSED", "approved"), ("S1", "orders", "O", "s", 1, "PENDING", "approved"), ("S1", "orders", "O", "s", 3, "NEW", "draft")], "source_schema string, source_table string, raw_status string, source_snapshot_id string, mapping_version int, canonical_state string, review_status string")
    s = events.status_facts(_defects(spark, sf)).withColumns({"source_schema": F.lit("S1"), "source_table": F.lit("orders"), "source_snapshot_id": F.lit("s")})
    return events.map_statuses(s, d).select("source_fact_id", "canonical_state", "mapping_version")


def transitions_input(spark, sf):
    """lineitems of an order as its defect's facts."""
    x = t(spark, sf, "lineitem")
    k = F.col("l_linenumber")
    to = F.element_at(F.array(*map(F.lit, ("NEW", "PENDING", "PROCESSING", "RESOLVED", "CLOSED", "PROCESSING", "RESOLVED"))), k)
    ev = F.element_at(F.array(*map(F.lit, ("DefectCreatedEvent", "DefectAcceptedEvent", "DefectProcessingEvent", "ResolutionEvent", "DefectAcceptanceEvent", "DefectProcessingEvent", "ResolutionEvent"))), k)
    return x.select(F.col("l_orderkey").cast("string").alias("subject_key"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), to.alias("to_state"), ev.alias("event_type"), F.lit(False).alias("mapped"), F.col("l_shipdate").cast("timestamp").alias("effective_at"), F.col("l_shipdate").cast("timestamp").alias("recorded_at"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("source_row_id"))


_FOLD = """WITH RECURSIVE f AS (SELECT CAST(l_orderkey AS VARCHAR) AS subject_key, ['NEW','PENDING','PROCESSING','RESOLVED','CLOSED','PROCESSING','RESOLVED'][l_linenumber] AS to_state,
  ['DefectCreatedEvent','DefectAcceptedEvent','DefectProcessingEvent','ResolutionEvent','DefectAcceptanceEvent','DefectProcessingEvent','ResolutionEvent'][l_linenumber] AS ev,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, concat_ws('-', l_linenumber, l_partkey, l_suppkey), concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS rn FROM lineitem),
  r(from_state, ev, to_state) AS (VALUES (NULL, 'DefectCreatedEvent', 'NEW'), ('NEW', 'DefectAcceptedEvent', 'PENDING'), ('PENDING', 'DefectProcessingEvent', 'PROCESSING'), ('PROCESSING', 'ResolutionEvent', 'RESOLVED'),
  ('RESOLVED', 'DefectAcceptanceEvent', 'CLOSED'), ('CLOSED', 'DefectProcessingEvent', 'PROCESSING'), ('CANCELLED', 'DefectProcessingEvent', 'PROCESSING')),
  w AS (SELECT subject_key, 0 AS rn, CAST(NULL AS VARCHAR) AS state, 0::BIGINT AS version FROM (SELECT DISTINCT subject_key FROM f) UNION ALL
  SELECT f.subject_key, f.rn, CASE WHEN ok THEN f.to_state ELSE w.state END, w.version + CASE WHEN ok THEN 1 ELSE 0 END FROM w JOIN f ON f.subject_key = w.subject_key AND f.rn = w.rn + 1,
  LATERAL (SELECT EXISTS (SELECT 1 FROM r WHERE r.ev = f.ev AND r.to_state = f.to_state AND (r.from_state IS NULL OR r.from_state = w.state)) AS ok))"""


_LAST = _FOLD + " SELECT subject_key, state, version FROM (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY rn DESC) AS last FROM w) WHERE last = 1"


@register("T1_replay_fold", _LAST)
def t1_sql(spark, sf):
    return states.folded_states(states.replay_states(transitions_input(spark, sf))[0]).select("subject_key", "state", "version")


@register("T5_current_state", f"SELECT subject_key, state, version FROM ({_LAST}) WHERE version > 0")
def t5(spark, sf):
    return states.replay_states(transitions_input(spark, sf))[1].select("subject_key", "state", "version")


@register("T1_transitions", f"SELECT status, count(*)::BIGINT AS n FROM ({_FOLD} SELECT subject_key, rn, CASE WHEN version > lag(version) OVER (PARTITION BY subject_key ORDER BY rn) THEN 'accepted' ELSE 'needs_review' END AS status FROM w) WHERE rn > 0 GROUP BY 1")
def t1(spark, sf):
    return states.replay_states(transitions_input(spark, sf))[0].groupBy("status").agg(F.count("*").alias("n"))


@register("T7_scoped_replay", f"SELECT subject_key, state, version FROM ({_LAST}) WHERE version > 0 AND subject_key = '7'")
def t7(spark, sf):
    return states.replay_states(transitions_input(spark, sf), scope="7")[1].select("subject_key", "state", "version")


@register("T2_guards", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) > 0 AS team_assignment_present, event_type = 'purchase' AS resolution_evidence_present, CAST(json_extract_string(props, '$.k') AS INTEGER) = 1 AS acceptance_pass FROM events""")
def t2(spark, sf):
    e = t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumn("ctx", F.to_json(F.struct(F.when(k > 0, k.cast("string")).alias("team_id"), k.cast("string").alias("acceptance_pass"))))
    g = states.guard_columns(F.col("ctx"), F.when(F.col("event_type") == "purchase", "ResolutionEvent"))
    return e.select("event_id", *[g[n].alias(n) for n in ("team_assignment_present", "resolution_evidence_present", "acceptance_pass")])


@register("T3_context_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'payload' ELSE json_extract_string(props, '$.k') END AS k FROM events")
def t3(spark, sf):
    payload = F.when(F.col("event_id") % 2 == 0, F.lit('{"k": "payload"}')).otherwise(F.lit("bad"))
    return t(spark, sf, "events").select("event_id", states.context_value("k", F.col("props"), payload).alias("k"))


@register("T4_late_rows", "SELECT count(*) FILTER (late) AS n_late, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_shipdate > a.l_shipdate AND b.l_suppkey < a.l_suppkey) AS late FROM lineitem a)")
def t4(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("effective_at"), F.col("l_suppkey").alias("recorded_at"))
    return states.late_flags(x, ["l_orderkey"]).agg(F.count_if("late").alias("n_late"), F.count("*").alias("n"))


@register("T6_replay_diff", """SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'state_changed' WHEN a.d <> b.d THEN 'effective_time_changed' END AS change FROM
  (SELECT o_custkey, max(o_orderstatus) AS s, max(o_orderdate) AS d FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderstatus) AS s, max(o_orderdate) AS d FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey) WHERE change IS NOT NULL GROUP BY 1""")
def t6(spark, sf):
    o = t(spark, sf, "orders")

    def of(part):
        return o.filter(f"o_orderkey % 2 = {part}").groupBy(F.col("o_custkey").alias("subject_key")).agg(F.max("o_orderstatus").alias("state"), F.max("o_orderdate").alias("effective_at"))

    return states.diff_states(of(0), of(1)).groupBy("change").agg(F.count("*").alias("n"))


@register("T6_merkle_diff", "SELECT o_custkey AS subject_key, CASE WHEN o_custkey % 97 = 0 THEN 'removed' ELSE 'changed' END AS change FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 97 IN (0, 1)")
def t6_merkle(spark, sf):
    """States before and after a replay that moved a few subjects, as published snapshots: only leaves that differ are read."""
    s = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject_key")).agg(F.max("o_orderstatus").alias("state"), F.max("o_orderdate").alias("effective_at"))
    new = s.filter("subject_key % 97 <> 0").withColumn("state", F.when(F.col("subject_key") % 97 == 1, F.lit("X")).otherwise(F.col("state")))
    old_at, new_at = (merkle.publish(df, ["subject_key"], new_folder(spark, "merkle")) for df in (s, new))
    return merkle.diff_published(spark, old_at, new_at, ["subject_key"])


@register("L2_scoped_replay", _LAST.replace("FROM lineitem)", "FROM lineitem WHERE l_linenumber <= 3 OR l_orderkey IN (7, 32))"))
def l2_scoped(spark, sf):
    """States of the first facts of all subjects; when the rest have come, only two subjects are replayed, and all others stay."""
    every = transitions_input(spark, sf)
    first = every.filter(F.substring_index(F.col("source_row_id"), "-", 1).cast("int") <= 3)
    old = states.folded_states(states.replay_states(first)[0]).select("subject_key", "state", "version")
    new = states.folded_states(states.replay_states(every.filter(F.col("subject_key").isin("7", "32")))[0]).select("subject_key", "state", "version")
    return states.recompute_scope(old, new, ["7", "32"])


@register("L2_stream_upsert", "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def l2_upsert(spark, sf):
    """All events as a stream of four files, merged batch by batch into the latest of each user."""
    e, source, folder = t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), new_folder(spark, "events"), new_folder(spark, "upsert")
    e.repartition(4, "event_id").write.parquet(source)
    upsert.upsert_files(spark, source, e.schema.simpleString()[7:-1].replace(":", " "), folder, ["user_id"], ["ts", "event_id"], new_folder(spark, "stream")).awaitTermination()
    return upsert.read_table(spark, folder)


def _states_and_risks(spark, sf):
    s = reads.latest_by(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("subject_key"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("CLOSED").alias("state"))
    r = t(spark, sf, "events").select(F.col("user_id").alias("subject_key"), F.col("event_id").alias("fact_id"), F.floor(F.col("value") / 20).alias("risk_score"), F.col("ts").alias("created_at"))
    return s, r


_DEC = """(SELECT s.o_custkey AS subject_key, r.event_id AS risk_fact_id, CAST(floor(r.value / 20) AS BIGINT) AS risk_score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) s
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE floor(value / 20) >= 3) r ON r.user_id = s.o_custkey AND r.rn = 1 WHERE s.rn = 1 AND s.o_orderstatus = 'O')"""


@register("G1_decisions", f"SELECT subject_key, risk_fact_id, risk_score FROM {_DEC}")
def g1(spark, sf):
    return decisions.decide(*_states_and_risks(spark, sf)).select("subject_key", "risk_fact_id", "risk_score")


_RULES = (
    ("ACT-1", "1", "PENDING", "risk", "purchase", 3, "inspect", "device", True, "enabled"),
    ("ACT-2", "1", "PENDING", "risk", "view", 5, "repair", "device", True, "enabled"),
    ("ACT-3", "2", "CLOSED", "risk", "error", 1, "reopen", "order", False, "enabled"),
    ("ACT-4", "1", "PENDING", "risk", "view", 0, "ignore", "device", True, "disabled"),
)


@register(
    "G1_rule_table",
    f"""WITH r(rule_id, rule_version, input_state, risk_fact_type, risk_predicate, least, action_type, target_type, requires_approval, status) AS (VALUES {", ".join(str(x).replace("True", "true").replace("False", "false") for x in _RULES)}),
    s AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'CLOSED' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
    m AS (SELECT r.*, s.k, s.state, e.event_id, CAST(floor(e.value / 20) AS BIGINT) AS score, row_number() OVER (PARTITION BY r.rule_id, s.k ORDER BY e.ts DESC, e.event_id DESC) AS rn
      FROM r JOIN s ON s.state = r.input_state JOIN events e ON e.user_id = s.k AND e.event_type = r.risk_predicate AND floor(e.value / 20) >= r.least WHERE r.status = 'enabled')
    SELECT rule_id, rule_version, k AS subject_key, state, event_id AS risk_fact_id, score AS risk_score, action_type, requires_approval FROM m WHERE rn = 1""",
)
def g1_rules(spark, sf):
    s, r = _states_and_risks(spark, sf)
    kinds = t(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.lit("risk").alias("fact_type"), F.col("event_type").alias("predicate"))
    rules = spark.createDataFrame(_RULES, "rule_id string, rule_version string, input_state string, risk_fact_type string, risk_predicate string, min_risk_score int, action_type string, target_type string, requires_approval boolean, status string")
    return decisions.decide_by_rules(s, r.join(kinds, "fact_id"), rules).select("rule_id", "rule_version", "subject_key", "state", "risk_fact_id", "risk_score", "action_type", "requires_approval")


@register("G2_action_plans", f"SELECT subject_key, CASE WHEN subject_key % 3 = 0 THEN 'APPROVED' ELSE 'PENDING_APPROVAL' END AS status FROM {_DEC}")
def g2(spark, sf):
    d = decisions.decide(*_states_and_risks(spark, sf))
    first = decisions.plan_actions(d)
    old = first.withColumn("status", F.when(F.col("subject_key") % 3 == 0, "APPROVED").otherwise("DRAFT"))
    return decisions.plan_actions(d, old).select("subject_key", "status")


@register("G3_unbound", f"SELECT subject_key, risk_fact_id FROM {_DEC} WHERE subject_key % 2 = 1")
def g3(spark, sf):
    d = decisions.decide(*_states_and_risks(spark, sf))
    return decisions.unbound(d, decisions.plan_actions(d).filter("subject_key % 2 = 0")).select("subject_key", "risk_fact_id")


@register("G4_preview_gate", f"SELECT subject_key, CASE WHEN subject_key % 3 = 0 THEN 'ready' WHEN subject_key % 3 = 1 THEN 'blocked' ELSE 'needs_review' END AS gate FROM {_DEC}")
def g4(spark, sf):
    d = decisions.decide(*_states_and_risks(spark, sf))
    p = decisions.plan_actions(d).join(d.select("decision_id", "risk_fact_id"), "decision_id")
    p = p.withColumn("status", F.when(F.col("subject_key") % 3 == 0, "APPROVED").when(F.col("subject_key") % 3 == 1, "REJECTED").otherwise("PENDING_APPROVAL"))
    return decisions.preview_gate(p).select("subject_key", "gate")
