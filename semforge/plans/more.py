"""The rest of the catalogue over the driver's tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from semforge.functions import text
from semforge.functions.iri import EX, OWL, PROV, RDFS, SKOS, TYPE, XSD
from semforge.operators import cleaning, gates, identity, knowledge, metadata, reads, rules
from semforge.plans.semantics import _id_devices, quads
from semforge.plans.tables import CANDIDATES, DEVICES, candidates, devices, t
from semforge.rdf import project, sinks
from semforge.rdf.closure import close, closure, inference_run, maintain_closed, with_premises
from semforge.rdf.store import store
from semforge.registry import register
from semforge.sources import files
from semforge.sparql import select
from semforge.storage import new_folder


@register(
    "S1_site_snapshot",
    "SELECT o_orderpriority AS site, count(*) AS rows, coalesce(max(d), 0)::BIGINT AS duplicates, 0::BIGINT AS invalid FROM orders LEFT JOIN (SELECT o_orderpriority AS s, count(*) AS d FROM (SELECT o_orderpriority, o_custkey FROM orders GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) ON s = o_orderpriority GROUP BY 1",
)
def s1(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("site"), F.col("o_custkey").alias("k"), "o_orderkey")
    return files.snapshot(o, "site", "k").drop("digest")


@register("S4_column_subset", "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, CAST(NULL AS VARCHAR) AS MISSING FROM customer")
def s4(spark, sf):
    return files.read_columns(t(spark, sf, "customer"), ["C_CUSTKEY", "C_NAME", "MISSING"])


@register("S12_nquads", f"SELECT count(*) AS n, count(*) FILTER (value LIKE '%\"NATION_3\"%') AS hits FROM (SELECT concat('<{EX}nation/', n_nationkey, '> \"', n_name, '\"') AS value FROM nation)")
def s12(spark, sf):
    from semforge.rdf.sinks import nquads

    q = quads(spark, sf).filter((F.col("predicate") == f"{EX}displayName") & F.col("subject").contains("/nation/"))
    return nquads(q).agg(F.count("*").alias("n"), F.count_if(F.col("value").contains('"NATION_3"')).alias("hits"))


_NODES = f"""n AS (SELECT concat('{EX}region/', r_regionkey) AS s, 'Region' AS c, r_name AS name, NULL AS balance, NULL AS p, NULL AS o FROM region
  UNION ALL SELECT concat('{EX}nation/', n_nationkey), 'Nation', n_name, NULL, 'partOf', concat('{EX}region/', n_regionkey) FROM nation
  UNION ALL SELECT concat('{EX}customer/', c_custkey), 'Customer', c_name, CAST(c_acctbal AS VARCHAR), 'inNation', concat('{EX}nation/', c_nationkey) FROM customer),
  l AS (SELECT s, list_filter([concat('<{TYPE}> <{EX}', c, '>'), CASE WHEN balance IS NOT NULL THEN concat('<{EX}balance> "', balance, '"^^<{XSD}decimal>') END, concat('<{EX}displayName> "', name, '"'), CASE WHEN p IS NOT NULL THEN concat('<{EX}', p, '> <', o, '>') END], lambda x: x IS NOT NULL) AS lines FROM n)"""


def _source_quads(spark, sf):
    return quads(spark, sf).filter("graph = 'source'")


@register("S12_nquads_rows", f"WITH {_NODES} SELECT concat('<', s, '> ', unnest(lines), ' <source> .') AS value FROM l")
def s12_nquads(spark, sf):
    return sinks.nquads(_source_quads(spark, sf))


@register("S12_trig_rows", f"WITH {_NODES} SELECT concat('<source> {{', chr(10), '  <', s, '> ', array_to_string(lines, concat(' ;', chr(10), '    ')), ' .', chr(10), '}}') AS value FROM l")
def s12_trig(spark, sf):
    return sinks.trig(_source_quads(spark, sf))


@register(
    "S12_jsonld_rows",
    f"""WITH {_NODES} SELECT concat('{{"@id":"', s, '","@type":["{EX}', c, '"]', CASE WHEN balance IS NOT NULL THEN concat(',"{EX}balance":[{{"@value":"', balance, '","@type":"{XSD}decimal"}}]') ELSE '' END,
    ',"{EX}displayName":[{{"@value":"', name, '","@type":"{XSD}string"}}]', CASE WHEN p IS NOT NULL THEN concat(',"{EX}', p, '":[{{"@id":"', o, '"}}]') ELSE '' END, '}}') AS value FROM n""",
)
def s12_jsonld(spark, sf):
    return sinks.jsonld(_source_quads(spark, sf))


@register("J8_cascade_lookup", f"SELECT count(*) AS n FROM (SELECT site, location FROM {DEVICES} GROUP BY ALL HAVING count(*) = 1)")
def j8(spark, sf):
    return identity._unique(_id_devices(spark, sf), ("site", "location"), "d").filter("d IS NOT NULL").agg(F.count("*").alias("n"))


@register("J14_json_pointer_join", "SELECT e.event_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = CAST(json_extract_string(try_cast(e.props AS JSON), '$.k') AS BIGINT) WHERE e.event_type = 'error'")
def j14(spark, sf):
    e = t(spark, sf, "events").filter("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    return e.join(t(spark, sf, "customer"), F.col("k") == F.col("c_custkey")).select("event_id", "c_name")


@register("J16_state_risk_join", "SELECT subject, fact_id, value FROM (SELECT o_custkey AS subject, event_id AS fact_id, value, row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') JOIN events ON user_id = o_custkey AND value >= 150) WHERE rn = 1")
def j16(spark, sf):
    """Subjects in the state with the latest risk that reaches the threshold."""
    s = t(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("subject")).distinct()
    latest = t(spark, sf, "events").filter("value >= 150").groupBy(F.col("user_id").alias("subject")).agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    return s.join(latest, "subject").select("subject", F.col("r.event_id").alias("fact_id"), F.col("r.value").alias("value"))


@register("J21_relation_fill", "SELECT 'a' AS kind, c_custkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'b', s_suppkey FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT 'c', p_partkey FROM part WHERE p_size = 50")
def j21(spark, sf):
    a = t(spark, sf, "customer").filter("c_acctbal > 9000").select(F.lit("a").alias("kind"), F.col("c_custkey").alias("k"))
    b = t(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.lit("b").alias("kind"), F.col("s_suppkey").alias("k"))
    return a.unionByName(b).unionByName(t(spark, sf, "part").filter("p_size = 50").select(F.lit("c").alias("kind"), F.col("p_partkey").alias("k")))


@register("U3_closure_difference", f"SELECT count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region)")
def u3(spark, sf):
    inferred, _ = closure(quads(spark, sf))
    return inferred.filter((F.col("predicate") == TYPE) & (F.col("object") == f"{EX}Place")).agg(F.count("*").alias("n"))


@register("U4_key_compare", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'RIGHT_ONLY' WHEN b.k IS NULL THEN 'LEFT_ONLY' ELSE 'same' END AS status FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 20) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 5) b ON a.k = b.k) GROUP BY 1")
def u4(spark, sf):
    a = t(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_nationkey").alias("k"))
    b = t(spark, sf, "supplier").filter("s_nationkey > 5").select(F.col("s_nationkey").alias("k"))
    return metadata.compare_schemas(a, b, "k", []).groupBy("status").agg(F.count("*").alias("n"))


@register("X3_candidate_form", "SELECT p_partkey, p_name AS x FROM part")
def x3(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.normalize(F.concat(F.lit(" ,"), F.replace("p_name", F.lit(" "), F.lit("\t ")), F.lit("。-")), "candidate").alias("x"))


@register("X4_identity_form", "SELECT c_custkey, lower(regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g')) AS x FROM customer")
def x4(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", text.normalize(F.col("c_name"), "identity").alias("x"))


@register("X5_metadata_key", "SELECT p_partkey, upper(concat(p_name, '|', p_brand)) AS x FROM part")
def x5(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.metadata_key(F.concat(F.lit("  "), F.col("p_name")), F.col("p_brand")).alias("x"))


@register("X8_terms", "SELECT c_mktsegment AS s, 6 AS n FROM customer GROUP BY 1")
def x8(spark, sf):
    """The terms of a fixed text of four characters: three of two, two of three and one of four."""
    return t(spark, sf, "customer").select(F.col("c_mktsegment").alias("s")).distinct().select("s", F.size(text.terms(F.lit("给水泵房"))).alias("n"))


@register("X10_code_shape", "SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(upper(s_name), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[^9A]', 'X', 'g') AS x FROM supplier")
def x10(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", text.code_shape(F.col("s_name")).alias("x"))


@register("X13_rule_vocabulary", "SELECT p_partkey, starts_with(p_name, 'blue') AND ends_with(p_name, 'bolt') AS matched FROM part")
def x13(spark, sf):
    r = rules.Rule("R", "keep_original", {"prefix": "blue", "suffix": "bolt"})
    return t(spark, sf, "part").select("p_partkey", rules.transform(F.col("p_name"), r)["matched"].alias("matched"))


@register("X16_space_pattern", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'leading+multiple' ELSE '' END AS x FROM part")
def x16(spark, sf):
    wide = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   ")))
    return t(spark, sf, "part").select("p_partkey", text.space_pattern(F.when(F.col("p_size") % 2 == 0, wide).otherwise(F.col("p_name"))).alias("x"))


@register("X17_mapping_groups")
def x17(spark, sf):
    p = t(spark, sf, "part").select(F.translate("p_name", "abc", "ａⅢ①").alias("x"))
    return p.groupBy(text.mapping_group("x").alias("groups")).agg(F.count("*").alias("n"))


@register("X18_mapping_signature")
def x18(spark, sf):
    p = t(spark, sf, "part").select("p_name", F.translate("p_name", "ab", "ａｂ").alias("x")).distinct()
    return p.groupBy(text.mapping_signature("x", "p_name").alias("signature")).agg(F.count("*").alias("n"))


@register("X19_edit_script")
def x19(spark, sf):
    p = t(spark, sf, "part").select("p_name").distinct()
    return p.select("p_name", text.edit_script("p_name", F.upper("p_name")).alias("script"))


@register("X20_similarity_ratio")
def x20(spark, sf):
    a = t(spark, sf, "part").select("p_name", "p_type").distinct()
    return a.select("p_name", "p_type", text.similarity_ratio("p_name", F.lower("p_type")).alias("ratio"))


@register("X21_risk_flags", "SELECT doc_id, contains(text, '?') AS question FROM documents")
def x21(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_contains(text.risk_flags(F.col("text")), "question_mark").alias("question"))


@register("X22_question_position", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'boundary' WHEN 2 THEN 'interior_single' ELSE 'interior_multiple' END AS x FROM part")
def x22(spark, sf):
    k = F.col("p_size") % 4
    q = F.when(k == 0, F.lit("ab")).when(k == 1, "ab?").when(k == 2, "a?b").otherwise("a?b?c")
    return t(spark, sf, "part").select("p_partkey", text.question_position(q).alias("x"))


@register("X32_fact_form", "SELECT p_partkey, lower(p_name) AS x FROM part")
def x32(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.normalize(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\n")), "fact").alias("x"))


@register("I4_bridge_class", "SELECT CASE WHEN p_size % 5 = 0 THEN 'direct_asset_unique' WHEN p_size % 5 = 1 THEN 'itemnum_unique' WHEN p_size % 5 = 2 THEN 'blocked_itemnum_not_unique' WHEN p_size % 5 = 3 THEN 'location_scope_with_assets' ELSE 'kks_not_found' END AS class, count(*) AS n FROM part GROUP BY 1")
def i4(spark, sf):
    k = F.col("p_size") % 5
    c = identity.bridge_class({"direct": (k == 0).cast("int"), "item": F.when(k == 1, 1).when(k == 2, 2).otherwise(0), "location": F.lit(0), "hierarchy": F.lit(False), "prefix_assets": F.when(k == 3, 4).otherwise(0), "code": F.lit("12ABCD34"), "has_record": F.lit(False)})
    return t(spark, sf, "part").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@register("I5_recommendation", "SELECT CASE WHEN p_size < 10 THEN 'accept' WHEN p_size < 20 THEN 'recommend_confirm' WHEN p_size < 40 THEN 'manual_review' ELSE 'isolate' END AS r, count(*) AS n FROM part GROUP BY 1")
def i5(spark, sf):
    s = F.col("p_size")
    r = identity.recommendation(F.when(s < 10, "exact_assetnum").otherwise("unique_location"), F.when(s < 10, 1.0).when(s < 20, 0.86).when(s < 40, 0.78).otherwise(0.0), F.lit(0.95))
    return t(spark, sf, "part").groupBy(r.alias("r")).agg(F.count("*").alias("n"))


@register("I6_bridge_reasons", "SELECT CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'ASSET_NOT_UNIQUE' ELSE 'KKS_NOT_FOUND' END AS reasons, count(*) AS n FROM part GROUP BY 1")
def i6(spark, sf):
    k = F.col("p_size") % 3
    r = identity.bridge_reasons(F.when(k == 1, 2).otherwise(1), F.when(k == 2, 0).otherwise(1), F.lit("d"), F.lit("d"))
    return t(spark, sf, "part").groupBy(F.concat_ws(",", r).alias("reasons")).agg(F.count("*").alias("n"))


@register("I7_acceptance", "SELECT accepted, count(*) AS n FROM (SELECT p_size % 2 = 0 AND p_type <> 'SMALL' AS accepted FROM part) GROUP BY 1")
def i7(spark, sf):
    p = t(spark, sf, "part").select(F.lit("d").alias("candidate_id"), F.lit("d").alias("replayed_id"), F.lit("m").alias("method"), F.lit("m").alias("replayed_method"), F.when(F.col("p_size") % 2 == 0, 0.95).otherwise(0.5).alias("score"), F.lit("S").alias("site"), F.lit(1).alias("n_records"), (F.col("p_type") == "SMALL").alias("isolated"))
    return identity.acceptance_reasons(p).groupBy("accepted").agg(F.count("*").alias("n"))


@register("I12_lifecycle", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id = 7 THEN 'revoked' ELSE 'accepted' END AS status FROM events) GROUP BY 1")
def i12(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("assertion_id"), F.lit("accepted").alias("status"))
    return identity.set_lifecycle(e, "7", "revoke", "me")[0].groupBy("status").agg(F.count("*").alias("n"))


@register("C2_context_candidates", "SELECT context_status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 AND o_custkey IS NOT NULL THEN 'complete' ELSE 'needs_review' END AS context_status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey) GROUP BY 1")
def c2(spark, sf):
    n = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("device")).agg(F.count("*").alias("n_specs"))
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(n, F.col("device") == F.col("c_custkey"), "left")
    rows = c.select(F.col("c_nationkey").cast("string").alias("location"), F.col("n_name").alias("location_name"), F.col("r_name").alias("hierarchy"), F.when(F.col("c_custkey") % 2 == 0, "k").alias("class_id"), F.lit("cl").alias("classification"), "n_specs")
    return cleaning.context_candidates(rows).groupBy("context_status").agg(F.count("*").alias("n"))


@register("C8_terminology", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'attribute' AS kind, p_name FROM part UNION ALL SELECT DISTINCT 'classification', p_type FROM part UNION ALL SELECT DISTINCT 'domain', p_brand FROM part) GROUP BY 1")
def c8(spark, sf):
    p = t(spark, sf, "part")

    def of(c):
        return p.select(F.lit("part").alias("table_name"), F.lit(c).alias("key"), F.lit(" ").alias("title"), F.col(c).alias("alias"))

    return cleaning.mine_terms(of("p_name"), of("p_type"), of("p_brand")).groupBy("kind").agg(F.count("*").alias("n"))


@register("C10_judge_deferred", "SELECT CASE p_size % 4 WHEN 0 THEN 'keep_original_sign_deleted' WHEN 1 THEN 'approve_terminal_punctuation' WHEN 2 THEN 'review_question' ELSE 'review_other' END AS verdict, count(*) AS n FROM part GROUP BY 1")
def c10(spark, sf):
    k = F.col("p_size") % 4
    a = F.when(k == 0, "-5m").when(k == 1, "pump.").when(k == 2, "a?b").otherwise("abc")
    b = F.when(k == 0, "5m").when(k == 1, "pump").when(k == 2, "ab").otherwise("xyz")
    return t(spark, sf, "part").groupBy(cleaning.judge_deferred(a, b).alias("verdict")).agg(F.count("*").alias("n"))


@register("C11_preview_risk", "SELECT CASE WHEN p_size > 25 THEN 'semantic' ELSE 'whitespace_only' END AS risk, count(*) AS n FROM part GROUP BY 1")
def c11(spark, sf):
    b = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("")))
    return t(spark, sf, "part").groupBy(cleaning.preview_risk(F.col("p_name"), b).alias("risk")).agg(F.count("*").alias("n"))


@register("C12_full_preview", f"SELECT asset, upper(name) AS proposed FROM {DEVICES} WHERE site <> 'SMALL'")
def c12(spark, sf):
    d = reads.active_only(devices(spark, sf), "name", "site", ["SMALL"])
    return cleaning.preview(d, "name", F.upper, ["site"], ["asset"]).select("asset", "proposed")


@register("C14_meaning_dictionary", "SELECT code, meaning, n, variants FROM (SELECT concat('L', p_size) AS code, p_name AS meaning, count(*) AS n, count(*) OVER (PARTITION BY p_size) AS variants, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_name) AS rn FROM part GROUP BY p_size, p_name) WHERE rn = 1")
def c14(spark, sf):
    d = devices(spark, sf).select(F.col("location").alias("code"), F.col("name").alias("meaning"))
    return reads.mode_of(d, "code", "meaning")


@register("R2_rule_scope", f"SELECT asset FROM {DEVICES} WHERE site IN ('ECONOMY') AND starts_with(location, 'L1')")
def r2(spark, sf):
    r = rules.Rule("R", "trim", scope={"sites": ["ECONOMY"], "prefixes": ["L1"]})
    return devices(spark, sf).filter(rules.in_scope(r)).select("asset")


@register("R6b_recheck", "SELECT CASE WHEN o_orderstatus <> 'F' THEN 'STATE' WHEN o_orderkey % 2 = 1 THEN 'RECEIPT' ELSE '' END AS failed, count(*) AS n FROM orders GROUP BY 1")
def r6b(spark, sf):
    o = t(spark, sf, "orders")
    odd = (F.col("o_orderkey") % 2 == 1) & (F.col("o_orderstatus") == "F")
    q = o.select(F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("state"), F.lit("approve").alias("decision"), F.when(~odd, "r").alias("receipt"), F.lit("a").alias("original"), F.lit("a").alias("current_original"), F.lit("b").alias("proposed"), F.lit("b").alias("current_proposed"))
    return rules.recheck_approved(q).groupBy(F.concat_ws(",", "failed").alias("failed")).agg(F.count("*").alias("n"))


@register("R6c_queue_import", "SELECT p_name AS identity, CASE WHEN count(DISTINCT p_type) = 1 THEN 'accepted' ELSE 'rejected' END AS side, count(DISTINCT p_type) AS n FROM part GROUP BY 1")
def r6c(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_name").alias("identity"), F.col("p_type").alias("original"), F.lit("x").alias("proposed"))
    new, refused = rules.import_queue(p, spark.createDataFrame([], "content_hash string"))
    both = new.select("identity", F.lit("accepted").alias("side")).unionByName(refused.select("identity", F.lit("rejected").alias("side")))
    return both.groupBy("identity", "side").agg(F.count("*").alias("n"))


@register("M4_formal_only", "SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'kept' ELSE 'audited' END AS side FROM part")
def m4(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size")
    kept, audit = metadata.formal_only(p, p.select("key", F.when(F.col("p_size") % 2 == 0, "FORMAL_READY").otherwise("UNCERTAIN").alias("verdict")))
    return kept.select("key", F.lit("kept").alias("side")).unionByName(audit.select("key", F.lit("audited").alias("side")))


@register("K2_machine_contracts", "SELECT count(*) AS n, count(*) FILTER (p_type = 'SMALL') AS rules FROM part")
def k2(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), F.lit(1).alias("version"), F.when(F.col("p_type") == "SMALL", "rule").otherwise("term").alias("kind"), F.col("p_name").alias("title"), F.lit("trim").alias("operation"))
    return knowledge.machine_contracts(p).agg(F.count("*").alias("n"), F.count_if(F.get_json_object("action", "$.action") == "propose").alias("rules"))


@register("O2_identity_triples", f"SELECT predicate, count(*) AS n FROM (SELECT unnest(['{TYPE}', '{EX}assertsIdentity', '{EX}confidence', '{EX}sourceSystem']) AS predicate FROM customer) GROUP BY 1")
def o2(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("assertion_id"), F.concat(F.lit(EX), "c_custkey").alias("object_iri"), F.lit(0.99).alias("confidence"), F.lit("S").alias("source_system"))
    return project.identities(c, "source").groupBy("predicate").agg(F.count("*").alias("n"))


@register("O5_fact_triples", f"SELECT predicate, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 2 = 0 THEN ['{TYPE}', '{EX}factType', '{EX}hasFact', '{PROV}wasDerivedFrom'] ELSE ['{TYPE}', '{EX}factType', '{EX}hasFact'] END) AS predicate FROM events) GROUP BY 1")
def o5(spark, sf):
    even = F.col("event_id") % 2 == 0
    iri = F.concat(F.lit(f"{EX}fact/"), "event_id")
    e = t(spark, sf, "events").select(iri.alias("fact_iri"), F.when(even, "derived").otherwise("observed").alias("status"), F.col("event_type").alias("fact_type"), F.concat(F.lit(f"{EX}user/"), "user_id").alias("subject_iri"), F.when(even, F.array(F.concat(iri, F.lit("-in")))).otherwise(F.array().cast("array<string>")).alias("input_iris"))
    return project.facts(e, "derived").groupBy("predicate").agg(F.count("*").alias("n"))


@register("O6_concepts", f"SELECT predicate, count(*) AS n FROM (SELECT unnest(['{TYPE}', '{SKOS}inScheme', '{SKOS}prefLabel']) AS predicate FROM (SELECT DISTINCT p_type FROM part)) GROUP BY 1")
def o6(spark, sf):
    p = t(spark, sf, "part").select(F.concat(F.lit(f"{EX}type/"), "p_type").alias("concept_iri"), F.lit(f"{EX}types").alias("scheme_iri"), F.col("p_type").alias("label"), F.lit(None).cast("string").alias("match_iri"))
    return project.concepts(p, "ontology").groupBy("predicate").agg(F.count("*").alias("n"))


@register("O7_identity_projection", "SELECT count(*) * 6 AS statements, count(*) AS resources FROM part")
def o7(spark, sf):
    d = _id_devices(spark, sf).withColumn("status", F.lit("seed"))
    q = project.objects(d, "source", F.concat(F.lit(f"{EX}device/"), "device_id"), "Device", {"sourceSchema": "source_schema", "site": "site", "assetNumber": "asset", "displayName": "text", "status": "status"})
    return project.graph_counts(q).select("statements", "resources")


_EDGES = f"""b(s, o) AS (SELECT concat('{EX}nation/', n_nationkey), concat('{EX}region/', n_regionkey) FROM nation), c(s, o) AS (SELECT concat('{EX}customer/', c_custkey), concat('{EX}nation/', c_nationkey) FROM customer),
  d(s, o) AS (SELECT c.s, b.o FROM c JOIN b ON c.o = b.s)"""


@register(
    "O11_inference_support",
    f"""WITH {_EDGES}, y(s, c) AS (SELECT concat('{EX}region/', r_regionkey), 'Region' FROM region UNION ALL SELECT concat('{EX}nation/', n_nationkey), 'Nation' FROM nation UNION ALL SELECT concat('{EX}customer/', c_custkey), 'Customer' FROM customer)
    SELECT s AS subject, '{TYPE}' AS predicate, '{EX}Place' AS object, 'class' AS rule, 1 AS iteration, concat(s, ' {TYPE} {EX}', c, '; {EX}', c, ' {RDFS}subClassOf {EX}Place') AS because FROM y WHERE c <> 'Customer'
    UNION ALL SELECT s, '{TYPE}', '{EX}BusinessObject', 'class', CASE c WHEN 'Customer' THEN 1 ELSE 2 END, concat(s, ' {TYPE} {EX}', CASE c WHEN 'Customer' THEN c ELSE 'Place' END, '; {EX}', CASE c WHEN 'Customer' THEN c ELSE 'Place' END, ' {RDFS}subClassOf {EX}BusinessObject') FROM y
    UNION ALL SELECT s, '{EX}partOf', o, 'property', 1, concat(s, ' {EX}inNation ', o, '; {EX}inNation {RDFS}subPropertyOf {EX}partOf') FROM c
    UNION ALL SELECT c.s, '{EX}partOf', b.o, 'transitive', 2, concat(c.s, ' {EX}partOf ', c.o, '; ', b.s, ' {EX}partOf ', b.o, '; {EX}partOf {TYPE} {OWL}TransitiveProperty') FROM c JOIN b ON c.o = b.s
    UNION ALL SELECT o, '{EX}hasPart', s, 'inverse', n, concat(s, ' {EX}partOf ', o, '; {EX}partOf {OWL}inverseOf {EX}hasPart') FROM (SELECT *, 1 AS n FROM b UNION ALL SELECT *, 2 FROM c UNION ALL SELECT *, 3 FROM d)""",
)
def o11(spark, sf):
    """Every inferred statement with its rule, and its premises as text: the ids of the support are looked up among all statements."""
    q = quads(spark, sf)
    inferred, _ = closure(q)
    return with_premises(inferred, q).select("subject", "predicate", "object", "rule", "iteration", "because")


_MOVED = f"""b(s, o) AS (SELECT concat('{EX}nation/', n_nationkey), concat('{EX}region/', n_regionkey) FROM nation UNION ALL SELECT concat('{EX}customer/', c_custkey), concat('{EX}nation/', CASE WHEN c_acctbal < 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END) FROM customer),
  tc(s, o) AS (SELECT s, o FROM b UNION SELECT tc.s, b.o FROM tc JOIN b ON tc.o = b.s)"""


@register("O10_incremental_closure", f"WITH RECURSIVE {_MOVED} SELECT s AS subject, '{EX}partOf' AS predicate, o AS object FROM tc WHERE s LIKE '{EX}customer/%' UNION ALL SELECT o, '{EX}hasPart', s FROM tc")
def o10_incremental(spark, sf):
    """The closure after the customers in debt have moved to the next nation: what rested on where they were goes, the rest stays."""
    q, c = quads(spark, sf), t(spark, sf, "customer").filter("c_acctbal < 0")

    def at(shift: int):
        nation = F.concat(F.lit(f"{EX}nation/"), (F.col("c_nationkey") + shift) % 25)
        return project.to_quads(c, "source", F.concat(F.lit(f"{EX}customer/"), "c_custkey"), [project.iri(f"{EX}inNation", nation)])

    return maintain_closed(close(q), at(1), at(0)).inferred.filter(F.col("predicate") != TYPE).select("subject", "predicate", "object")


@register("O10_inference_run", f"WITH {_EDGES}, e AS (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d) SELECT o AS subject, '{EX}hasPart' AS predicate, s AS object, n AS reused FROM e, (VALUES (false), (true)) r(n)")
def o10_run(spark, sf):
    """The closure of a run, and of the next one over the same statements, which finds the first one's rows."""
    folder = new_folder(spark, "inference")
    runs = [inference_run(quads(spark, sf), folder) for _ in range(2)]
    both = runs[0][0].withColumn("reused", F.lit(runs[0][1])).unionByName(runs[1][0].withColumn("reused", F.lit(runs[1][1])))
    return both.filter(F.col("predicate") == f"{EX}hasPart").select("subject", "predicate", "object", "reused")


@register("O13_sparql_star", f"SELECT concat('{EX}customer/', c_custkey) AS c, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def o13_star(spark, sf):
    """Over stored quads: what the query asks of one customer lies together."""
    kept = store(quads(spark, sf))
    return select(kept, f"PREFIX ex: <{EX}> SELECT ?c ?name ?nation WHERE {{ ?c a ex:Customer ; ex:displayName ?name ; ex:balance ?b ; ex:inNation ?n . ?n ex:displayName ?nation . FILTER(?b > 9000) }}", cap=None)


@register("O13_sparql_paths", f"SELECT concat('{EX}customer/', c_custkey) AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def o13_paths(spark, sf):
    return select(quads(spark, sf), f"PREFIX ex: <{EX}> SELECT ?c ?region WHERE {{ ?c ex:inNation/ex:partOf ?r . ?r ex:displayName ?region . FILTER(?region = 'ASIA') }}", cap=None)


@register("O20_timeline", "SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id FROM events WHERE user_id = 3 UNION ALL SELECT 'transition', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey = 3")
def o20(spark, sf):
    e = t(spark, sf, "events").filter("user_id = 3").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("at"))
    o = t(spark, sf, "orders").filter("o_custkey = 3").select(F.lit("transition").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("at"))
    return e.unionByName(o).orderBy(F.col("at").desc_nulls_last(), "kind", "id").select("kind", "id")


@register("N4d_verdict_gate", f"SELECT candidate_id, CASE WHEN device_id % 2 = 0 AND status = 'candidate' AND confidence = 'high' AND evidence_level <> 'weak' AND amount <= 400000 THEN 'approve' WHEN device_id % 2 = 1 THEN 'reject' ELSE 'needs_review' END AS decision FROM {CANDIDATES}")
def n4d(spark, sf):
    c = candidates(spark, sf).withColumn("reason_codes", F.concat("reason_codes", F.array(F.lit("replay_passed"), F.lit("source_identity_verified"))))
    v = c.select("candidate_id", F.when(F.col("device_id") % 2 == 0, "Approved").otherwise("reject").alias("verdict"), F.lit(0.9).alias("confidence"), F.lit(1).alias("position"))
    return gates.verdict_gate(c, v).select("candidate_id", "decision")


@register("N4e_catalog_gate", "SELECT p_name AS pattern_key, 'bound' AS outcome, 'high' AS risk FROM part WHERE p_size = 3 GROUP BY 1 UNION ALL SELECT p_name, 'duplicate', 'high' FROM (SELECT p_name, row_number() OVER (PARTITION BY p_name) AS rn FROM part WHERE p_size = 3) WHERE rn > 1")
def n4e(spark, sf):
    p = t(spark, sf, "part")
    v = p.filter("p_size = 3").select(F.col("p_name").alias("pattern_key"), F.lit("low").alias("risk"), F.lit(0.9).alias("confidence"))
    c = p.select(F.col("p_name").alias("pattern_key")).distinct().select("pattern_key", F.lit("r").alias("rule_id"), F.lit("high").alias("risk"), F.lit(0.7).alias("confidence"))
    return gates.catalog_gate(v, c).select("pattern_key", "outcome", "risk")


@register("N5_publish_once", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def n5(spark, sf):
    q = t(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("state"), F.lit("passed").alias("replay_status"), F.col("o_orderkey").alias("candidate_id"), F.lit("a").alias("original"), F.lit("b").alias("proposed"))
    first = gates.publish(q.filter("candidate_id % 2 = 1"), spark.createDataFrame([], "publication_id string"))
    return gates.publish(q, first).agg(F.count("*").alias("n"))


@register("N5b_auto_approve", f"SELECT count(*) AS n FROM {CANDIDATES} WHERE review_state = 'pending' AND amount <= 400000")
def n5b(spark, sf):
    c = candidates(spark, sf)
    samples = c.select((F.col("candidate_id") % 5).alias("sample_id"), "candidate_id")
    return gates.auto_approve(c, reads.auto_approvable, samples, "run-1")[0].agg(F.count("*").alias("n"))


@register("L1_late_rows_batch", "SELECT count(*) AS late FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_shipdate > a.l_shipdate AND b.l_linenumber < a.l_linenumber)")
def l1(spark, sf):
    from semforge.operators.states import late_flags

    x = t(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("effective_at"), F.col("l_linenumber").alias("recorded_at"))
    return late_flags(x, ["l_orderkey"]).filter("late").agg(F.count("*").alias("late"))


@register("L3_tumbling_windows", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def l3(spark, sf):
    from semforge.streaming.replay import windowed

    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(e, "ts", ["event_type"], "1 day").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@register("E6_older_decisions", "SELECT o_orderstatus AS s, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def e6_older(spark, sf):
    """The latest of each status, as the mapping keeps only the latest version of each key."""
    return reads.latest_by(t(spark, sf, "orders"), ["o_orderstatus"], [F.desc("o_orderkey")]).select(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("latest"))


@register("L3_session_windows", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, session""")
def l3_sessions(spark, sf):
    from semforge.streaming.replay import sessions

    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", ["user_id"], "6 hours").select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), F.col("session.end").cast("timestamp_ntz").alias("end"), "n")


@register("L3_sliding_windows", "SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts) + (CASE WHEN hour(ts) < 12 THEN INTERVAL 0 HOUR ELSE INTERVAL 12 HOUR END) - k * INTERVAL 12 HOUR FOR k IN [0, 1]]) AS start FROM events) GROUP BY ALL")
def l3_sliding(spark, sf):
    from semforge.streaming.replay import windowed

    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(e, "ts", ["event_type"], "1 day", "12 hours").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
