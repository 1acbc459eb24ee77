"""Scans, sinks, gates and contracts over the driver's tables: files and ledgers go through the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from semforge.functions import ids
from semforge.functions.iri import EX, OWL, TYPE
from semforge.operators import contracts, gates, rules, validation
from semforge.operators.releases import Releases
from semforge.operators.versions import Versions, diff
from semforge.pipeline import run_dag
from semforge.plans.semantics import quads
from semforge.plans.tables import t
from semforge.rdf.closure import closure, with_inferred
from semforge.rdf.shapes import Property, Shape
from semforge.rdf.turtle import read_turtle
from semforge.registry import register
from semforge.sources import files, snapshots
from semforge.sparql import SparqlError
from semforge.sparql import parse as parse_query
from semforge.storage import new_folder


def _many(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("S2_metadata_snapshot", " UNION ALL ".join(f"SELECT '{x}' AS \"table\", 'captured' AS status, count(*) AS rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{x}')::INTEGER AS n_columns FROM {x}" for x in TABLES))
def s2(spark, sf):
    m = snapshots.snapshot_tables({x: t(spark, sf, x) for x in TABLES}, new_folder(spark, "snapshot"))
    return m.select("table", "status", "rows", F.size("columns").alias("n_columns"))


@register("S3_context_scan", "SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS key, trim(c_name) AS name, '' AS missing FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), trim(s_name), '' FROM supplier")
def s3(spark, sf):
    wanted = {"customer": snapshots.Context(("C_CUSTKEY", "C_NAME", "C_NOTE"), {"c_mktsegment": ("BUILDING", "MACHINERY")}, ("c_name",)), "supplier": snapshots.Context(("S_SUPPKEY", "S_NAME", "S_NOTE"))}
    rows = snapshots.context_tables({x: t(spark, sf, x) for x in wanted}, wanted)
    names = {"key": ("C_CUSTKEY", "S_SUPPKEY"), "name": ("C_NAME", "S_NAME"), "missing": ("C_NOTE", "S_NOTE")}
    return rows.select("table", *[F.coalesce(*[F.try_element_at("row", F.lit(c)) for c in both]).alias(n) for n, both in names.items()])


@register("S5_checkpointed_extract", "SELECT 'nation' AS name, 'first' AS run, count(*) AS rows FROM nation UNION ALL SELECT 'region', 'first', count(*) FROM region")
def s5(spark, sf):
    at = new_folder(spark, "extract")
    tables = {x: (lambda x=x: t(spark, sf, x)) for x in ("region", "nation")}
    runs = [(name, run) for run in ("first", "second") for name in files.checkpointed_extract(spark, tables, at)]
    counted = spark.read.parquet(f"{at}/nation").agg(F.count("*").alias("rows")).select(F.lit("nation").alias("name"), "rows").unionByName(spark.read.parquet(f"{at}/region").agg(F.count("*").alias("rows")).select(F.lit("region").alias("name"), "rows"))
    return _many(spark, "name string, run string", runs).join(counted, "name")


@register("S6_key_inventory", "SELECT table_name AS \"table\", column_name AS \"column\", CASE WHEN contains(upper(column_name), 'NAME') THEN 'description' WHEN regexp_matches(upper(column_name), 'DATE|TIME') THEN 'time' ELSE 'other' END AS kind FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'nation')")
def s6(spark, sf):
    return files.key_inventory([(x, c) for x in ("customer", "orders", "nation") for c in t(spark, sf, x).columns], spark)


@register("S7_csv_as_text", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def s7(spark, sf):
    at = new_folder(spark, "csv")
    files.write_csv(t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), at)
    return files.read_csv(spark, at)


@register("S8_named_files", "SELECT 'S' AS source_schema, 'G' AS source_group, 'PARTS' AS source_table, row_number() OVER (ORDER BY p_partkey)::INTEGER AS n, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")
def s8(spark, sf):
    at = new_folder(spark, "named")
    t(spark, sf, "part").select("p_partkey", "p_name").coalesce(1).sortWithinPartitions("p_partkey").write.option("header", True).csv(at)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(jvm.Path(at)) if f.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.Path(f"{at}/S__G__PARTS.csv"))
    return files.read_named_csvs(spark, f"{at}/*.csv").select(F.col("SOURCE_SCHEMA").alias("source_schema"), F.col("SOURCE_GROUP").alias("source_group"), F.col("SOURCE_TABLE").alias("source_table"), F.col("ROW_NUMBER").alias("n"), F.col("P_PARTKEY").alias("p_partkey"))


@register("S9_all_text_table", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def s9(spark, sf):
    at = new_folder(spark, "csv")
    files.write_csv(t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), at, bom=False)
    return files.read_csv(spark, at, strict=False)


@register("S10_read_only", "SELECT 'inside' AS target, 'refused' AS outcome UNION ALL SELECT 'source', 'refused' UNION ALL SELECT 'beside', 'allowed'")
def s10(spark, sf):
    out = []
    for name, at in (("inside", f"{sf}/orders.parquet/x"), ("source", f"{sf}/orders.parquet"), ("beside", f"{sf}-copy/orders.parquet")):
        try:
            files.guard_write(at, f"{sf}/orders.parquet")
            out.append((name, "allowed"))
        except files.SourceError:
            out.append((name, "refused"))
    return _many(spark, "target string, outcome string", out)


@register("S11_turtle", f"SELECT concat('{EX}nation/', n_nationkey) AS subject, n_name AS object FROM nation")
def s11(spark, sf):
    # A vocabulary-sized text: Turtle is a format of ontologies, data comes as N-Quads.
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    text = f"@prefix ex: <{EX}> .\n" + "\n".join(f"<{EX}nation/{r.n_nationkey}> a ex:Nation ; ex:displayName {json.dumps(r.n_name)} ." for r in rows)
    return read_turtle(spark, text, "g").filter(F.col("predicate") == f"{EX}displayName").select("subject", "object")


@register("S13_csv_export", "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def s13(spark, sf):
    """An export with a byte order mark, read back with Spark's plain reader: the mark is in front of the first name."""
    at = new_folder(spark, "export")
    files.write_csv(t(spark, sf, "part").select("p_partkey", "p_name"), at)
    raw = spark.read.option("header", True).csv(at)
    return raw.select(F.col(f"`{raw.columns[0]}`").alias(raw.columns[0].removeprefix("﻿")), raw.columns[1])


@register("S14_verified_read", "SELECT 'whole' AS copy, (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'changed', NULL")
def s14(spark, sf):
    """A snapshot's table is read if it is what the manifest says, and refused once its rows have changed."""
    at, out = new_folder(spark, "frozen"), []
    snapshots.snapshot_tables({"nation": t(spark, sf, "nation")}, at)
    out.append(("whole", snapshots.verified_table(spark, at, "nation").count()))
    t(spark, sf, "nation").filter("n_nationkey > 0").write.mode("overwrite").parquet(f"{at}/nation")
    try:
        out.append(("changed", snapshots.verified_table(spark, at, "nation").count()))
    except files.SourceError:
        out.append(("changed", None))
    return _many(spark, "copy string, rows long", out)


@register("X25_content_hash", "SELECT n_nationkey, sha256(concat('{\"key\":', n_nationkey, ',\"name\":\"', n_name, '\"}')) AS hash FROM nation")
def x25(spark, sf):
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    return _many(spark, "n_nationkey int, hash string", [(r.n_nationkey, ids.content_hash({"name": r.n_name, "key": r.n_nationkey, "run_id": 5, "created_at": "now"})) for r in rows])


@register("X28_masked_text", "SELECT n_name AS word, true AS allowed FROM nation")
def x28(spark, sf):
    """Update words are allowed in comments, strings and IRIs: each name stands in all three, beside one."""
    out = []
    for r in t(spark, sf, "nation").select("n_name").collect():
        try:
            parse_query(f"SELECT ?s WHERE {{ ?s <urn:delete> 'drop {r.n_name}' . }} # insert {r.n_name}")
            out.append((r.n_name, True))
        except SparqlError:
            out.append((r.n_name, False))
    return _many(spark, "word string, allowed boolean", out)


@register("O14_read_only_gate", "SELECT n_name AS word, false AS allowed FROM nation")
def o14(spark, sf):
    out = []
    for k, r in enumerate(t(spark, sf, "nation").select("n_name").collect()):
        word = ("INSERT DATA", "DELETE DATA", "LOAD", "CLEAR", "DROP", "CREATE")[k % 6]
        try:
            parse_query(f"{word} {{ <urn:{r.n_name}> <urn:p> <urn:o> }}")
            out.append((r.n_name, True))
        except SparqlError:
            out.append((r.n_name, False))
    return _many(spark, "word string, allowed boolean", out)


@register("V5_registry_contract", "SELECT concat('alias ', n_name, ' has no target ', n_regionkey) AS fault FROM nation WHERE n_regionkey > 2")
def v5(spark, sf):
    n = t(spark, sf, "nation").collect()
    r = [str(x.r_regionkey) for x in t(spark, sf, "region").filter("r_regionkey <= 2").collect()]
    return _many(spark, "fault string", [(x,) for x in validation.registry_errors({x.n_name: str(x.n_regionkey) for x in n}, r, {}, (), {"ex": EX})])


@register("L4_resume", "SELECT * FROM (VALUES ('a', 'first', false), ('b', 'first', false), ('a', 'second', true), ('b', 'second', true), ('a', 'changed', false), ('b', 'changed', false)) x(step, run, resumed)")
def l4(spark, sf):
    """A second run resumes every step; one of another specification runs all of them again."""
    out, state = [], None
    handlers = {"rows": lambda p, _: {"rows": t(spark, sf, p["table"]).count()}, "double": lambda p, i: {"rows": p["times"] * sum(x["rows"] for x in i.values())}}
    for run, times in (("first", 2), ("second", 2), ("changed", 3)):
        spec = {"steps": [{"id": "a", "handler": "rows", "parameters": {"table": "nation"}}, {"id": "b", "handler": "double", "depends_on": ["a"], "parameters": {"times": times}}]}
        state = run_dag(spec, handlers, previous=state)
        out += [(k, run, bool(v["resumed"])) for k, v in state["steps"].items()]
    return _many(spark, "step string, run string, resumed boolean", out)


@register("L2_scoped_recompute", "SELECT subject_key, CASE WHEN subject_key = '7' THEN 'recomputed' ELSE 'untouched' END AS outcome, count(*) AS facts FROM (SELECT CAST(user_id AS VARCHAR) AS subject_key FROM events) GROUP BY 1")
def l2(spark, sf):
    """States of one subject are computed anew; those of all others stay as they were, marked old here to tell them."""
    from semforge.operators.states import recompute_scope

    e = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("subject_key"))
    old = e.groupBy("subject_key").agg(F.count("*").alias("facts")).withColumn("outcome", F.lit("untouched"))
    new = e.groupBy("subject_key").agg(F.count("*").alias("facts")).withColumn("outcome", F.lit("recomputed"))
    return recompute_scope(old, new, ["7"]).select("subject_key", "outcome", "facts")


@register("N1_sql_function", "SELECT p_partkey, contains(p_name, 'blue')::INTEGER AS blue, 0 AS unknown FROM part")
def n1(spark, sf):
    rules.register_sql(spark, [rules.Rule("R-blue", "replace", {}, {"from": "blue", "to": "navy"})])
    return t(spark, sf, "part").selectExpr("p_partkey", "rule_local_match(p_name, 'R-blue') AS blue", "rule_local_match(p_name, 'R-none') AS unknown")


@register("N3_dag_handlers", "SELECT 'count' AS step, (SELECT count(*) FROM region) AS rows UNION ALL SELECT 'sum', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)")
def n3(spark, sf):
    handlers = {"count": lambda p, _: {"rows": t(spark, sf, p["table"]).count()}, "sum": lambda p, i: {"rows": t(spark, sf, p["table"]).count() + sum(x["rows"] for x in i.values())}}
    state = run_dag({"steps": [{"id": "sum", "handler": "sum", "depends_on": ["count"], "parameters": {"table": "nation"}}, {"id": "count", "handler": "count", "parameters": {"table": "region"}}]}, handlers)
    return _many(spark, "step string, rows long", [(k, v["result"]["rows"]) for k, v in state["steps"].items()])


@register("N4_failed_checks", "SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'STATE' END, CASE WHEN o_totalprice >= 100000 THEN NULL ELSE 'PRICE' END) AS failed FROM orders")
def n4(spark, sf):
    checks = gates.failed((F.col("o_orderstatus") == "F", "STATE"), (F.col("o_totalprice") >= 100000, "PRICE"))
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws(",", checks).alias("failed"))


@register("N4b_proposals", "SELECT r_name AS source, r_name <> 'ASIA' AS accepted FROM region UNION ALL SELECT 'long', false UNION ALL SELECT 'unknown', false")
def n4b(spark, sf):
    """Proposals of a rule by name: equal source and target, texts over 80 characters and unknown operations are refused."""
    out = []
    proposals = [(r.r_name, {"operation": "replace", "parameters": {"from": r.r_name, "to": "ASIA"}}) for r in t(spark, sf, "region").collect()]
    proposals += [("long", {"operation": "replace", "parameters": {"from": "x" * 81, "to": "y"}}), ("unknown", {"operation": "rewrite", "parameters": {}})]
    for name, p in proposals:
        try:
            gates.rule_from_proposal(p)
            out.append((name, True))
        except rules.RuleError:
            out.append((name, False))
    return _many(spark, "source string, accepted boolean", out)


@register("N4c_drafts", "SELECT p_partkey AS draft_id, concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'UNKNOWN_CLUSTER' END, CASE WHEN p_size % 7 = 0 OR p_size % 2 = 0 THEN 'CHARACTERS_OUTSIDE_SIGNATURE' END, CASE WHEN p_size % 3 = 0 THEN 'NOT_REPLAYABLE' END, CASE WHEN p_size < 10 THEN 'CONFIDENCE' END) AS reasons FROM part")
def n4c(spark, sf):
    size = F.col("p_size")
    drafts = t(spark, sf, "part").select(F.col("p_partkey").alias("draft_id"), (size % 7).alias("cluster_id"), F.when(size % 2 == 0, "Ａz").otherwise("Ａ").alias("source"), F.when(size % 3 == 0, "B").when(size % 2 == 0, "Az").otherwise("A").alias("target"), F.when(size < 10, 0.5).otherwise(0.9).alias("confidence"))
    clusters = _many(spark, "cluster_id int, signature string", [(k, "Ａ") for k in range(1, 7)])
    return gates.draft_gate(drafts, clusters).select("draft_id", F.concat_ws(",", "reasons").alias("reasons"))


@register(
    "N5c_review_preconditions",
    """SELECT o_orderkey AS request_key, CASE WHEN reasons = '' THEN 'accepted' ELSE reasons END AS outcome FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'ALREADY_RECORDED' END,
    CASE WHEN o_orderstatus <> 'O' THEN 'NOT_PENDING' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN_DECISION' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 100000 THEN 'VALIDATION_FAILED' END,
    CASE WHEN o_orderpriority <> '1-URGENT' AND o_custkey % 2 = 0 THEN 'NOTE_MISSING' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 2 = 1 THEN 'DESCRIPTION_MISSING' END) AS reasons FROM orders)""",
)
def n5c(spark, sf):
    o = t(spark, sf, "orders")
    decision = F.when(F.col("o_orderpriority") == "1-URGENT", "approve").when(F.col("o_orderpriority") == "5-LOW", "maybe").otherwise("reject")
    odd = F.col("o_custkey") % 2 == 1
    reviews = o.select(F.col("o_orderkey").alias("request_key"), F.col("o_orderkey").alias("candidate_id"), decision.alias("decision"), F.when(odd, "n").alias("note"), F.when(~odd, "d").alias("description"))
    known = o.select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("review_state"), F.when(F.col("o_totalprice") < 100000, "fail").otherwise("pass").alias("validator_status"))
    judged = gates.judged_reviews(reviews, known, o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("request_key")))
    return judged.select("request_key", F.when(F.size("reasons") == 0, "accepted").otherwise(F.concat_ws(",", "reasons")).alias("outcome"))


@register("N6_release_cycle", "SELECT * FROM (VALUES (1, 'prepared', NULL), (2, 'refused', NULL), (3, 'activated', 'one'), (4, 'activated', 'two'), (5, 'rolled_back', 'one')) x(step, event, active)")
def n6(spark, sf):
    """Prepare, approve, activate and roll back two versions of nation; the data of each is in the ledger's folder."""
    v, out = Versions(spark, new_folder(spark, "releases")), []
    nation = t(spark, sf, "nation")
    none = _many(spark, "failure string", [])
    v.register("one", {"nation": nation})
    out.append((1, "prepared", v.active))
    try:
        v.activate("one", _many(spark, "failure string", [("SHAPE_VIOLATED",)]))
    except ValueError:
        out.append((2, "refused", v.active))
    v.activate("one", none)
    v.snapshot(nation)
    out.append((3, "activated", v.active))
    v.register("two", {"nation": nation.filter("n_regionkey <> 1")}, "one")
    v.activate("two", none)
    out.append((4, "activated", v.active))
    v.rollback("one")
    out.append((5, "rolled_back", v.active))
    return _many(spark, "step int, event string, active string", out)


@register("N6_release_rows", "SELECT 'activated' AS step, n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'rolled_back', n_nationkey, n_name FROM nation")
def n6_rows(spark, sf):
    """Two releases of nation, approved and activated one after the other; what is published then, and after the rollback."""
    r, nation = Releases(spark, new_folder(spark, "releases")), t(spark, sf, "nation")
    for rows in (nation, nation.filter("n_regionkey <> 1")):
        name = r.prepare(rows, {"table": "nation"})
        r.approve(name, "reviewer")
        r.activate(name)
    published = r.rows().select(F.lit("activated").alias("step"), "n_nationkey", "n_name")
    r.rollback()
    return published.unionByName(r.rows().select(F.lit("rolled_back").alias("step"), "n_nationkey", "n_name"))


@register("N7_version_diff", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0 UNION ALL SELECT -c_custkey, 'added' FROM customer WHERE c_custkey BETWEEN 1 AND 10")
def n7(spark, sf):
    """Two snapshots of versions of customer, read back and compared after the migration from one to the other."""
    v = Versions(spark, new_folder(spark, "versions"))
    old = t(spark, sf, "customer").select("c_custkey", "c_name")
    new = old.filter("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit("new")).otherwise(F.col("c_name"))).unionByName(old.filter("c_custkey BETWEEN 1 AND 10").withColumn("c_custkey", -F.col("c_custkey")))
    none = _many(spark, "failure string", [])
    v.register("1", {"customer": old})
    v.activate("1", none)
    before = v.snapshot(old)
    v.register("2", {"customer": new}, "1")
    v.prepare_migration("1", "2")
    v.migrate("1", "2", none)
    return diff(spark.read.parquet(before), spark.read.parquet(v.snapshot(new)), ["c_custkey"])


@register("N8_metrics", "SELECT 'rows' AS name, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'timed', 2")
def n8(spark, sf):
    m = gates.Metrics()
    for x in ("nation", "region"):
        m.count("rows", m.timed("scan", t(spark, sf, x).count))
    s = m.summary()
    return _many(spark, "name string, n long", [("rows", s["counts"]["rows"]), ("timed", s["times"]["scan"]["n"])])


@register("U7_given_and_inferred", f"SELECT concat('{EX}nation/', n_nationkey) AS subject, '{EX}Nation' AS class, false AS inferred FROM nation UNION ALL SELECT concat('{EX}nation/', n_nationkey), unnest(['{EX}Place', '{EX}BusinessObject']), true FROM nation")
def u7(spark, sf):
    q = quads(spark, sf)
    both = with_inferred(q, closure(q)[0])
    return both.filter((F.col("predicate") == TYPE) & F.col("subject").contains("/nation/")).select("subject", F.col("object").alias("class"), "inferred")


@register("O23_contracts", "SELECT 'customers' AS contract, 'passed' AS status UNION ALL SELECT 'many places', 'failed' UNION ALL SELECT 'names', 'passed' UNION ALL SELECT 'no update', 'failed'")
def o23(spark, sf):
    p = f"PREFIX ex: <{EX}> "
    wanted = [contracts.Contract("customers", p + "SELECT (COUNT(?c) AS ?n) WHERE { ?c a ex:Customer }", 1, 100), contracts.Contract("names", p + "SELECT ?n WHERE { ?x a ex:Nation ; ex:displayName ?n }", 25), contracts.Contract("many places", p + "SELECT ?x WHERE { ?x a ex:Region }", 6), contracts.Contract("no update", "DELETE WHERE { ?s ?p ?o }")]
    return contracts.run_contracts(quads(spark, sf), wanted).select("contract", "status")


@register("O23_standards_gate", f"SELECT 'GRAPH_MISSING' AS failure, 'provenance' AS detail UNION ALL SELECT 'SHAPE_MISSING', '{EX}Device' UNION ALL SELECT 'CONTEXT_TERM_MISSING', '{EX}balance' UNION ALL SELECT 'SHAPE_VIOLATED', concat('maxCount {EX}displayName ', count(*)) FROM nation UNION ALL SELECT 'CONTRACT_FAILED', 'devices'")
def o23_gate(spark, sf):
    declared = _many(spark, quads(spark, sf).schema.simpleString()[7:-1].replace(":", " "), [("ontology", f"{EX}{x}", TYPE, "iri", f"{OWL}DatatypeProperty", None, None) for x in ("displayName", "balance")])
    twice = quads(spark, sf).filter((F.col("predicate") == f"{EX}displayName") & F.col("subject").contains("/nation/")).withColumn("object", F.concat("object", F.lit(" again")))
    q = quads(spark, sf).unionByName(declared).unionByName(twice)
    shapes = [Shape(f"{EX}NationShape", f"{EX}Nation", properties=[Property(f"{EX}displayName", min_count=1, max_count=1)])]
    wanted = [contracts.Contract("devices", f"SELECT ?d WHERE {{ ?d a <{EX}Device> }}"), contracts.Contract("nations", f"ASK {{ ?n a <{EX}Nation> }}")]
    return contracts.standards_gate(q, shapes, wanted, ["source", "ontology", "provenance"], [f"{EX}Device", f"{EX}Nation"], {"displayName": f"{EX}displayName"})
