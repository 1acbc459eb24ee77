"""X, I, C, R, M, V, K and O operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semforge.functions import ids, text
from semforge.functions.iri import EX, OWL, RDFS, TYPE, XSD
from semforge.operators import cleaning, identity, knowledge, metadata, reads, rules, validation
from semforge.plans.tables import CANDIDATES, DEVICES, candidates, devices, t
from semforge.rdf import project
from semforge.rdf.closure import closure
from semforge.rdf.shapes import Property, Shape, validate_shapes
from semforge.rdf.turtle import QUAD
from semforge.registry import register
from semforge.sparql import select
from semforge.storage import spread

# Text functions


@register("X1_nfkc")
def x1(spark, sf):
    """NFKC of full-width forms made from part names; DuckDB has no NFKC, so a unit test compares with Python's."""
    p = t(spark, sf, "part").select("p_partkey", F.translate("p_name", "abcde", "ａｂｃｄｅ").alias("x"))
    return p.select("p_partkey", text.nfkc(F.col("x")).alias("nfkc"))


@register("X2_collapse", "SELECT doc_id, sha256(trim(regexp_replace(text, '[\\s　]+', ' ', 'g'))) AS h FROM documents")
def x2(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("h"))


@register("X6_comparison_form", "SELECT p_partkey, lower(regexp_replace(concat(p_name, '-', p_brand), '[^0-9A-Za-z一-鿿]', '', 'g')) AS x FROM part")
def x6(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.normalize(F.concat_ws("-", "p_name", "p_brand"), "comparison").alias("x"))


@register(
    "X7_ngram_jaccard",
    """WITH g AS (SELECT DISTINCT p_name, list_distinct([substr(p_name, i, 2) FOR i IN range(1, length(p_name))]) AS s FROM part)
    SELECT * FROM (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS score FROM g a JOIN g b ON a.p_name < b.p_name) WHERE score >= 0.5""",
)
def x7(spark, sf):
    return reads.similar_pairs(t(spark, sf, "part").select("p_name").distinct(), "p_name", 0.5)


@register("X9_number_skeleton", "SELECT regexp_replace(c_name, '[0-9]+(\\.[0-9]+)?', '<NUM>', 'g') AS skeleton, count(*) AS n FROM customer GROUP BY 1")
def x9(spark, sf):
    return t(spark, sf, "customer").groupBy(text.number_skeleton(F.col("c_name")).alias("skeleton")).agg(F.count("*").alias("n"))


@register(
    "X11_alpha_tokens",
    """WITH c AS (SELECT p_partkey, upper(p_name) AS u, unnest(range(1, length(p_name) + 1)) AS i FROM part)
    SELECT p_partkey, regexp_extract(substr(u, i), '^[A-Z]+') AS token, (i - 1)::INTEGER AS "offset", length(regexp_extract(substr(u, i), '^[A-Z]+'))::INTEGER AS length FROM c
    WHERE regexp_matches(substr(u, i, 1), '[A-Z]') AND (i = 1 OR NOT regexp_matches(substr(u, i - 1, 1), '[A-Z]'))""",
)
def x11(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.inline(text.alpha_tokens(F.upper("p_name"))))


@register("X12_kks_like", "SELECT c_custkey, regexp_matches(c_name, '[0-9][0-9A-Z]{10,16}') AS strict, regexp_matches(c_name, '^[0-9]{2}[A-Za-z0-9]+$') AS prefixed, length(c_name) >= 6 AND regexp_matches(c_name, '[A-Za-z]') AND regexp_matches(c_name, '[0-9]') AS mixed FROM customer")
def x12(spark, sf):
    n = F.col("c_name")
    return t(spark, sf, "customer").select("c_custkey", *[text.kks_like(n, k).alias(k) for k in ("strict", "prefixed", "mixed")])


@register("X14_char_map", "SELECT s_suppkey, translate(s_name, '#S', '＃Ｓ') AS x FROM supplier")
def x14(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", text.map_chars(F.col("s_name"), "#S", "＃Ｓ").alias("x"))


@register("X15_format", "SELECT p_partkey, trim(regexp_replace(replace(translate(concat(' （', p_name, '）   ', p_brand), '（），／－＋：；', '(),/-+:;'), '　', ' '), ' {2,}', ' ', 'g')) AS x FROM part")
def x15(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.format_text(F.concat(F.lit(" （"), "p_name", F.lit("）   "), "p_brand")).alias("x"))


@register("X23_parse", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v, CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(greatest(value / 100, 0.0), 1.0) END AS c FROM events")
def x23(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.col("value").cast("string"))
    x = text.safe_float(raw)
    return t(spark, sf, "events").select("event_id", x.alias("v"), F.when(x.isNotNull(), text.clamp(x / 100)).alias("c"))


@register("X24_stable_ids", f"SELECT asset, concat('UD-', substr(sha256(concat(source_schema, '|', site, '|', asset)), 1, 24)) AS id FROM {DEVICES}")
def x24(spark, sf):
    return devices(spark, sf).select("asset", identity.device_id(F.col("source_schema"), F.col("site"), F.col("asset")).alias("id"))


@register("X26_iri_segment", "SELECT DISTINCT p_name, url_encode(p_name) AS x FROM part")
def x26(spark, sf):
    return t(spark, sf, "part").select("p_name", ids.iri_segment(F.col("p_name")).alias("x")).distinct()


@register("X27_snake_case", "SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS x FROM customer")
def x27(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", ids.snake_case(F.col("c_name")).alias("x"))


@register("X29_unit_form", "SELECT p_partkey, replace(concat(p_size, 'KV ', p_name), 'KV', 'kV') AS x FROM part")
def x29(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.unit_form(F.concat(F.col("p_size"), F.lit("KV "), F.col("p_name"))).alias("x"))


@register("X30_text_tests", "SELECT doc_id, regexp_full_match(text, '[A-Za-z0-9_.:/-]+') AS code_only, length(text) > 500 AS long FROM documents")
def x30(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.is_code_only(F.col("text")).alias("code_only"), (F.length("text") > 500).alias("long"))


@register("X31_derived_snapshot", "SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE concat('derived:', substr(sha256(string_agg(DISTINCT event_type, '|' ORDER BY event_type)), 1, 24)) END AS s FROM events GROUP BY 1")
def x31(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(ids.derived_snapshot(F.collect_set("event_type")).alias("s"))


# Identity


def _id_devices(spark, sf):
    return devices(spark, sf).select(identity.device_id(F.col("source_schema"), F.col("site"), F.col("asset")).alias("device_id"), "source_schema", "site", "asset", "location", F.col("name").alias("text"))


def _id_records(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    p = t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("site"), F.col("p_name").alias("text"), F.concat(F.lit("L"), F.col("p_size")).alias("location"))
    out = o.join(p, (k % 2100) == F.col("p_partkey"), "left")
    return out.select(k.alias("record_id"), F.coalesce("site", F.lit("ECONOMY")).alias("site"), F.when(k % 3 == 0, (k % 2100).cast("string")).alias("asset"), F.when(k % 3 == 1, F.col("location")).alias("location"), F.col("text"))


_D = f"(SELECT *, lower(regexp_replace(name, '[^0-9a-zA-Z]', '', 'g')) AS tx FROM {DEVICES})"
_R = "(SELECT o_orderkey AS record_id, coalesce(p_type, 'ECONOMY') AS site, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 2100 AS VARCHAR) END AS asset, CASE WHEN o_orderkey % 3 = 1 THEN concat('L', p_size) END AS location, lower(regexp_replace(coalesce(p_name, ''), '[^0-9a-zA-Z]', '', 'g')) AS tx FROM orders LEFT JOIN part ON o_orderkey % 2100 = p_partkey)"


@register(
    "I1_match_cascade",
    f"""WITH a AS (SELECT site, asset, count(*) AS n FROM {_D} GROUP BY ALL), l AS (SELECT site, location, count(*) AS n, min(asset) AS d FROM {_D} GROUP BY ALL), x AS (SELECT site, tx, count(*) AS n, min(asset) AS d FROM {_D} GROUP BY ALL)
    SELECT record_id, CASE WHEN r.asset IS NOT NULL AND a.n = 1 THEN 1.0 WHEN r.asset IS NOT NULL THEN 0.0 WHEN l.n = 1 AND x.n = 1 AND l.d = x.d THEN 0.95 WHEN l.n = 1 THEN 0.86 WHEN x.n = 1 THEN 0.78 ELSE 0.0 END::DOUBLE AS score,
    CASE WHEN r.asset IS NOT NULL AND a.n = 1 THEN 'accepted' WHEN r.asset IS NOT NULL OR l.n = 1 OR x.n = 1 THEN 'needs_review' ELSE 'blocked' END AS decision
    FROM {_R} r LEFT JOIN a ON a.site = r.site AND a.asset = r.asset LEFT JOIN l ON l.site = r.site AND l.location = r.location LEFT JOIN x ON x.site = r.site AND x.tx = r.tx AND r.tx <> ''""",
)
def i1(spark, sf):
    return identity.match_identity(_id_records(spark, sf), _id_devices(spark, sf)).select("record_id", "score", "decision")


@register("I2_identity_map", f"SELECT count(*) AS n, count(*) FILTER (r.asset IS NOT NULL AND d.asset IS NOT NULL) AS mapped FROM {_R} r LEFT JOIN {DEVICES} d ON d.site = r.site AND d.asset = r.asset")
def i2(spark, sf):
    return identity.identity_map(identity.match_identity(_id_records(spark, sf), _id_devices(spark, sf))).agg(F.count("*").alias("n"), F.count("device_id").alias("mapped"))


@register("I3_cross_system", "SELECT a.p_brand AS left_schema, b.p_brand AS right_schema, a.p_type AS site, CAST(a.p_partkey AS VARCHAR) AS left_id, CAST(b.p_partkey AS VARCHAR) AS right_id, 0.98 AS score FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand < b.p_brand")
def i3(spark, sf):
    d = devices(spark, sf).select("source_schema", "site", F.col("location").alias("asset"), F.col("asset").alias("device_id"))
    return identity.cross_system(d).select("left_schema", "right_schema", "site", "left_id", "right_id", "score")


@register("I9_decision_mode", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'manual' WHEN o_orderkey % 7 = 0 THEN 'conflict' WHEN o_totalprice > 250000 AND o_orderkey % 2 = 0 THEN 'auto' WHEN o_totalprice <= 250000 THEN 'manual_review' ELSE 'derived' END AS mode, count(*) AS n FROM orders GROUP BY 1")
def i9(spark, sf):
    k = F.col("o_orderkey")
    mode = identity.decision_mode(F.when(F.col("o_orderstatus") == "F", "x"), k % 7 == 0, F.when(F.col("o_totalprice") > 250000, 0.99).otherwise(0.5), F.when(k % 2 == 0, "ASSETNUM").otherwise("LOCATION"))
    return t(spark, sf, "orders").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@register("I10_identity_conflicts", "SELECT kind, count(*) AS n FROM (SELECT 'record' AS kind FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1 UNION ALL SELECT 'key' FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1) GROUP BY 1")
def i10(spark, sf):
    a = t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_record_id"), F.col("l_partkey").cast("string").alias("source_key"), F.col("l_suppkey").alias("object_key"), F.lit("accepted").alias("status"), F.lit(True).alias("active"))
    return identity.identity_conflicts(a).groupBy("kind").agg(F.count("*").alias("n"))


@register("I11_assertions", "SELECT status, validity, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'needs_review' ELSE 'accepted' END AS status, CASE WHEN event_id % 2 = 0 THEN 'temporal' ELSE 'permanent' END AS validity FROM events) GROUP BY ALL")
def i11(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("link_id"), F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(0.9).alias("confidence"), F.when(F.col("event_id") % 2 == 0, '{"valid_from": "2024"}').otherwise("bad").alias("evidence"))
    return identity.assertions(e).groupBy("status", "validity").agg(F.count("*").alias("n"))


@register("I8_exclusion_audit", f"SELECT count(*) FILTER (r.asset IS NOT NULL AND d.asset IS NOT NULL) AS kept, count(*) FILTER (r.asset IS NULL OR d.asset IS NULL) AS audited FROM {_R} r LEFT JOIN {DEVICES} d ON d.site = r.site AND d.asset = r.asset")
def i8(spark, sf):
    kept, audit = identity.exclude_unbridged(identity.match_identity(_id_records(spark, sf), _id_devices(spark, sf)))
    return kept.select(F.lit(1).alias("k")).unionByName(audit.select(F.lit(0).alias("k"))).agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("audited"))


# Cleaning and rules


@register("C1_base_candidates", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'blocked' WHEN p_size % 5 = 0 OR p_type = 'SMALL' THEN 'needs_review' ELSE 'candidate' END AS state FROM part) GROUP BY 1")
def c1(spark, sf):
    s = F.col("p_size")
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.when(s % 7 != 0, F.col("p_brand")).alias("site"), F.col("p_partkey").cast("string").alias("asset"), F.when(s % 5 == 0, " ").otherwise(F.col("p_name")).alias("description"), F.when(F.col("p_type") == "SMALL", "INACTIVE").alias("status"))
    return cleaning.base_candidates(p).groupBy("state").agg(F.count("*").alias("n"))


@register("C3_exclusion_chain", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN site = 'SMALL' THEN 'NON_OPERATIONAL' WHEN length(location) = 2 THEN 'LOCATION_MISSING' WHEN price < 950 THEN 'LOW_OVERLAP' END AS reason FROM {DEVICES}) GROUP BY 1")
def c3(spark, sf):
    kept, out = cleaning.exclusion_chain(devices(spark, sf), [("NON_OPERATIONAL", F.col("site") == "SMALL"), ("LOCATION_MISSING", F.length("location") == 2), ("LOW_OVERLAP", F.col("price") < 950)])
    return out.groupBy(F.col("exclusion_reason").alias("reason")).agg(F.count("*").alias("n")).unionByName(kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


@register("C4_semantic_candidates", "SELECT candidate_id, proposed, status FROM (SELECT p_partkey AS candidate_id, replace(p_name, 'bolt', 'screw') AS proposed, CASE WHEN p_size % 4 = 0 THEN 'needs_review' ELSE 'candidate' END AS status FROM part)")
def c4(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("site"), F.col("p_brand").alias("asset"), F.col("p_name").alias("original"), F.lit(None).cast("string").alias("candidate"), (F.col("p_size") % 4 != 0).alias("context_valid"), F.lit("x").alias("location_name"), F.lit("y").alias("classification"))
    p = p.withColumn("candidate_id", F.col("candidate_id").cast("string"))
    return cleaning.semantic_candidates(p, [("bolt", "screw", "T1")]).select(F.col("candidate_id").cast("long").alias("candidate_id"), "proposed", "status")


@register(
    "C5_difference_class",
    """WITH g AS (SELECT DISTINCT replace(p_name, ' ', '') AS a, lower(replace(p_type, ' ', '')) AS b FROM part), s AS (SELECT a, b, list_distinct([substr(a, i, 2) FOR i IN range(1, length(a))]) AS x, list_distinct([substr(b, i, 2) FOR i IN range(1, length(b))]) AS y FROM g),
    j AS (SELECT a, b, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS score FROM s)
    SELECT CASE WHEN contains(a, b) THEN 'DEVICE_DESCRIPTION_CONTAINS_LOCATION' WHEN contains(b, a) THEN 'LOCATION_DESCRIPTION_CONTAINS_DEVICE' WHEN score >= 0.5 THEN 'HIGH_TEXT_OVERLAP' WHEN score >= 0.2 THEN 'PARTIAL_TEXT_OVERLAP' ELSE 'LOW_TEXT_OVERLAP' END AS difference, count(*) AS n FROM j GROUP BY 1""",
)
def c5(spark, sf):
    p = t(spark, sf, "part").select("p_name", "p_type").distinct()
    return p.select(cleaning.difference_class(F.col("p_name"), F.col("p_type"))["difference"].alias("difference")).groupBy("difference").agg(F.count("*").alias("n"))


@register("C6_relationship_class", "SELECT CASE WHEN c_name = s_name THEN 'EXACT_NORMALIZED' WHEN s_name IS NULL THEN 'NOT_COMPARABLE' ELSE 'DIFFERENT_DESCRIPTIONS' END AS relation, count(*) AS n FROM (SELECT replace(c_name, 'Customer', 'Supplier') AS c_name, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 150) GROUP BY 1")
def c6(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "supplier"), F.col("s_suppkey") == F.col("c_custkey") % 150, "left")
    x = cleaning.relationship_class(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.col("s_name"))
    return c.groupBy(x.alias("relation")).agg(F.count("*").alias("n"))


@register("C7_quality_flags", "SELECT flag AS value, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_full_match(trim(text), '[A-Za-z0-9_.:/-]+') THEN 'CODE_ONLY' END, CASE WHEN length(trim(text)) > 100 THEN 'TOO_LONG' END, CASE WHEN length(trim(text)) < 3 AND trim(text) <> '' THEN 'TOO_SHORT' END], lambda x: x IS NOT NULL)) AS flag FROM documents) GROUP BY 1")
def c7(spark, sf):
    return reads.exploded_counts(t(spark, sf, "documents").select(cleaning.quality_flags(F.col("text")).alias("f")), "f")


@register("C9_cluster_class", "SELECT CASE WHEN contains(text, '?') THEN 'question_context' WHEN regexp_matches(text, '^\\s*-[0-9]') THEN 'leading_minus' ELSE 'other' END AS cluster, count(*) AS n FROM documents GROUP BY 1")
def c9(spark, sf):
    return t(spark, sf, "documents").select(cleaning.cluster_class(F.col("text"), F.col("text"))["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"))


@register("C13_format_preview", "SELECT p_partkey, concat(p_name, '(', p_size, ')') AS proposed FROM part WHERE p_size > 40")
def c13(spark, sf):
    wide = F.concat("p_name", F.lit("（"), F.col("p_size"), F.lit("）"))
    p = t(spark, sf, "part").withColumn("x", F.when(F.col("p_size") > 40, wide).otherwise(F.col("p_name")))
    return cleaning.preview(p, "x", text.format_text, ["p_type"], ["p_partkey"]).select("p_partkey", "proposed")


_RULE = rules.Rule("R-1", "replace", {"contains": "bolt"}, {"from": "blue", "to": "navy"}, {"sites": ["ECONOMY", "SMALL"]})


@register("R1_apply_rule", f"SELECT asset, CASE WHEN site NOT IN ('ECONOMY', 'SMALL') THEN 'out_of_scope' WHEN NOT contains(name, 'bolt') THEN 'condition_not_matched' WHEN NOT contains(name, 'blue') THEN 'source_not_matched' ELSE 'replace' END AS reason, CASE WHEN site IN ('ECONOMY', 'SMALL') AND contains(name, 'bolt') THEN replace(name, 'blue', 'navy') ELSE name END AS text FROM {DEVICES}")
def r1(spark, sf):
    return rules.apply_rule(devices(spark, sf), "name", _RULE).select("asset", "result.reason", "result.text")


@register("R3_rule_impact", f"SELECT 'R-1' AS rule_id, count(*) FILTER (site IN ('ECONOMY','SMALL')) AS targets, count(*) FILTER (site IN ('ECONOMY','SMALL') AND name LIKE '%blue%bolt%') AS matched, count(*) FILTER (site IN ('ECONOMY','SMALL') AND name LIKE '%blue%bolt%') AS changed FROM {DEVICES}")
def r3(spark, sf):
    return rules.impact(devices(spark, sf), "name", _RULE)


@register("R5_replay_cases", "SELECT p_partkey AS case_id, CASE WHEN p_name = 'blue bolt' AND p_size % 2 = 1 THEN 'fail' ELSE 'pass' END AS outcome FROM part")
def r5(spark, sf):
    c = t(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("input"), F.when(F.col("p_size") % 2 == 1, F.lit("wrong")).otherwise(F.replace("p_name", F.lit("blue"), F.lit("navy"))).alias("expected"))
    return rules.replay_rule(c, rules.Rule("R", "replace", {"contains": "blue bolt"}, {"from": "blue", "to": "navy"})).select("case_id", "outcome")


@register("R4_rule_mining", "SELECT 'R-blue' AS rule_id, count(*) AS n FROM part WHERE contains(p_name, 'blue') UNION ALL SELECT 'R-bolt', count(*) FROM part WHERE contains(p_name, 'bolt')")
def r4(spark, sf):
    catalog = [rules.Rule("R-blue", "replace", {}, {"from": "blue", "to": "navy"}), rules.Rule("R-bolt", "replace", {}, {"from": "bolt", "to": "screw"}), rules.Rule("R-none", "replace", {}, {"from": "zzz", "to": ""})]
    return rules.mine_rules(t(spark, sf, "part"), "p_name", catalog).select("rule_id", "n")


@register("R6_cleaning_replay", "SELECT p_partkey AS row_id, p_size % 4 = 0 AND p_size % 3 <> 0 AS passed FROM part")
def r6(spark, sf):
    p = t(spark, sf, "part")
    s = F.col("p_size")
    a = p.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("original"), F.when(s % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("proposed"), F.col("p_brand").alias("identity"))
    b = p.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("current"), F.when(s % 3 == 0, "moved").otherwise(F.col("p_brand")).alias("current_identity"))
    return rules.replay_cleaning(a, b, F.upper("current")).select("row_id", "passed")


@register("R7_replayable", "SELECT p_partkey, true AS reproduced, true AS idempotent, count(*) OVER (PARTITION BY p_name, p_size, p_brand) = 1 AS \"unique\" FROM part")
def r7(spark, sf):
    p = t(spark, sf, "part").withColumn("k", F.concat_ws("|", "p_name", "p_size", "p_brand"))
    return rules.replayable(p, "p_name", "p_name", "k").select("p_partkey", "reproduced", "idempotent", "unique")


@register("R8_cluster_previews", "SELECT p_type AS cluster, count(*) AS members, 'pass' AS outcome FROM part GROUP BY 1")
def r8(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_type").alias("cluster"), F.concat("p_name", F.lit("）")).alias("original"), F.concat("p_name", F.lit(")")).alias("proposed"))
    return rules.cluster_previews(p, "cluster", "original", "proposed").select("cluster", "members", "outcome")


# Metadata, validation and knowledge


@register("M1_catalog", "SELECT upper(concat(p_brand, '|', p_name)) AS key, CASE WHEN p_size = 7 THEN 'mapped' ELSE 'mapped' END AS mapping_status, count(*) AS n FROM part GROUP BY ALL")
def m1(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_brand").alias("object_name"), F.col("p_name").alias("attribute_name"))
    return metadata.catalog("attribute", p, "S1").groupBy("key", "mapping_status").agg(F.count("*").alias("n"))


@register(
    "M2_compare_schemas",
    """WITH l AS (SELECT p_name AS k, count(*) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS f FROM part WHERE p_partkey % 2 = 0 AND p_size < 45 GROUP BY 1), r AS (SELECT p_name AS k, count(*) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS f FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(l.k, r.k) AS key, CASE WHEN l.k IS NULL THEN 'RIGHT_ONLY' WHEN r.k IS NULL THEN 'LEFT_ONLY' WHEN l.f = r.f THEN 'same' ELSE 'needs_review' END AS status, coalesce(l.n, 0) AS left_count, coalesce(r.n, 0) AS right_count FROM l FULL JOIN r ON l.k = r.k""",
)
def m2(spark, sf):
    p = t(spark, sf, "part")
    return metadata.compare_schemas(p.filter("p_partkey % 2 = 0 AND p_size < 45"), p.filter("p_partkey % 2 = 1"), "p_name", ["p_type"]).select("key", "status", "left_count", "right_count")


@register("M3_findings", "SELECT 'DUPLICATE_OBJECT' AS finding, p_brand AS key FROM part GROUP BY p_brand HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'UNMATCHED_TABLE', p_brand FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
def m3(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_brand").alias("object_name"))
    a = p.distinct().select("object_name", F.lit("x").alias("attribute_name"))
    r = p.distinct().select(F.col("object_name").alias("parent"), F.col("object_name").alias("child"), F.lit("self").alias("relationship_name"))
    return metadata.findings(p, a, r, p.filter("object_name LIKE 'Brand#1%'").select(F.col("object_name").alias("table_name")))


@register("M5_dictionary_validation", "SELECT 'DUPLICATE_KEY' AS finding, p_name AS key FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'REVIEW_REQUIRED', p_name FROM part WHERE p_size = 3 UNION ALL SELECT 'NON_FORMAL_CATEGORY', p_name FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 'MISSING_PARENT', p_name FROM part WHERE p_brand = 'Brand#9'")
def m5(spark, sf):
    p = t(spark, sf, "part")
    none = F.lit(None).cast("string")
    e = p.select(F.col("p_name").alias("key"), F.when(F.col("p_type") == "SMALL", "draft").otherwise("formal").alias("category"), (F.col("p_size") == 3).alias("review_required"), F.col("p_brand").alias("parent"), none.alias("table_name"), F.lit("attribute").alias("kind"), none.alias("endpoint"), none.alias("index_name"))
    return metadata.validate_dictionary(e, p.filter("p_brand <> 'Brand#9'").select(F.col("p_brand").alias("object_name")), p.select(F.col("p_name").alias("index_name")))


@register("M6_dictionary_page", "SELECT row_id, name FROM (SELECT p_partkey AS row_id, p_name AS name, p_type AS kind, p_brand AS key FROM part) WHERE kind = 'SMALL' AND name ILIKE '%bolt%' ORDER BY kind, key, row_id LIMIT 20 OFFSET 20")
def m6(spark, sf):
    e = t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("key"))
    return metadata.read_dictionary(e, {"kind": "SMALL", "category": "all"}, "BOLT", 2, 20, ("name",)).select("row_id", "name")


@register("V1_validators", f"SELECT \"check\", outcome, count(*) AS n FROM (SELECT unnest([{{'check': 'contract', 'ok': true}}, {{'check': 'identity', 'ok': device_id IS NOT NULL}}, {{'check': 'evidence', 'ok': evidence_level <> 'weak'}}, {{'check': 'semantic', 'ok': true}}, {{'check': 'consistency', 'ok': NOT list_contains(reason_codes, 'IDENTITY_CONFLICT')}}], recursive := true), FROM {CANDIDATES}) x, (SELECT CASE WHEN ok THEN 'pass' ELSE 'fail' END AS outcome) GROUP BY ALL")
def v1(spark, sf):
    return validation.candidate_validators(candidates(spark, sf)).groupBy("check", "outcome").agg(F.count("*").alias("n"))


@register("V2_constraints", "SELECT 'EVENT_PROVENANCE' AS \"constraint\", CAST(event_id AS VARCHAR) AS entity FROM events WHERE event_id % 100 = 0 UNION ALL SELECT 'SOURCE_READ_ONLY', 'S2' UNION ALL SELECT 'PREDICATE_REGISTERED', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'")
def v2(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.lit("S1").alias("source_schema"), F.when(F.col("event_id") % 100 != 0, "r").alias("source_record_id"), F.lit("s").alias("source_snapshot_id"))
    f = e.filter("event_id % 100 <> 0").withColumnRenamed("event_id", "fact_id")
    s = spark.createDataFrame([("S1", True), ("S2", False)], "source_system string, read_only boolean")
    o = t(spark, sf, "orders")
    r = o.select(F.col("o_orderkey").alias("relation_id"), F.col("o_orderpriority").alias("predicate"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("draft").alias("status"))
    return validation.constraint_violations(e, f, s, r, o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("predicate")))


@register("V3_governance", "SELECT issue, count(*) AS n FROM (SELECT 'LOCATION_GAP' AS issue FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'CAUSAL_GAP' FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'RELATION_CONTRACT' FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def v3(spark, sf):
    o, e = t(spark, sf, "orders"), t(spark, sf, "events").select("event_id")
    a = o.select(F.col("o_orderkey").alias("assertion_id"), F.col("o_orderstatus").alias("relation"), F.lit("device").alias("subject_type"), F.lit("defect").alias("object_type"))
    c = spark.createDataFrame([("F", "device", "defect", "approved"), ("O", "device", "defect", "approved"), ("P", "device", "defect", "draft")], "relation string, subject_type string, object_type string, status string")
    d = t(spark, sf, "customer").select(F.col("c_custkey").alias("device_id"))
    return validation.governance(a, c, d, o.select(F.col("o_custkey").alias("device_id")), e, e.filter("event_id % 2 = 0")).groupBy("issue").agg(F.count("*").alias("n"))


@register("V4_coverage_gaps", "SELECT * FROM (SELECT 'event_time_missing' AS gap, count(*) AS n FROM events WHERE value < 1 UNION ALL SELECT 'approval_backlog', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'none', count(*) FROM orders WHERE o_orderstatus = 'X') WHERE n > 0")
def v4(spark, sf):
    o = t(spark, sf, "orders")
    return validation.coverage_gaps({"event_time_missing": t(spark, sf, "events").filter("value < 1"), "approval_backlog": o.filter("o_orderstatus = 'P'"), "none": o.filter("o_orderstatus = 'X'")})


@register("K1_assets", "SELECT kind, count(DISTINCT key) AS n FROM (SELECT 'rule' AS kind, p_name AS key FROM part UNION ALL SELECT 'term', p_type FROM part) GROUP BY 1")
def k1(spark, sf):
    p = t(spark, sf, "part")

    def of(c):
        return p.select(F.col(c).alias("key"), F.col(c).alias("title"), F.lit("candidate").alias("status"), F.col("p_brand").alias("source"))

    return knowledge.assets({"rule": of("p_name"), "term": of("p_type")})[0].groupBy("kind").agg(F.count("*").alias("n"))


@register("K3_discovery", "SELECT event_type AS name, count(*) AS n, 'needs_review' AS status FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def k3(spark, sf):
    return knowledge.discover(t(spark, sf, "events"), "event_type", spark.createDataFrame([("click",), ("view",)], "k string"), "k")


@register("K4_relation_aliases", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'device_has_inspection' ELSE 'device_has_defect' END AS relation_key FROM orders")
def k4(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "hasInspection").when(F.col("o_orderstatus") == "O", "device_has_defect").otherwise("HasDefect").alias("r"))
    return knowledge.normalize_relations(o, "r").select("o_orderkey", "relation_key")


@register("K5_link_assertions", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'device_has_inspection' ELSE 'device_has_defect' END AS relation, o_custkey AS subject_key, o_orderkey AS object_key FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 2 = 0")
def k5(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("link_id"), F.when(F.col("o_orderstatus") == "F", "inspection").when(F.col("o_orderstatus") == "O", "defect").otherwise("other").alias("kind"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("device_id"), F.col("o_orderkey").alias("record_id"))
    return knowledge.link_assertions(o).select("relation", "subject_key", "object_key")


# Quads


def quads(spark, sf):
    """region, nation and customer as resources; the schema makes nations and regions places, and inNation a part of partOf."""

    def node(kind, key):
        return F.concat(F.lit(f"{EX}{kind}/"), F.col(key))

    r, n, c = t(spark, sf, "region"), t(spark, sf, "nation"), spread(t(spark, sf, "customer"), "c_custkey")
    rows = project.objects(r, "source", node("region", "r_regionkey"), "Region", {"displayName": "r_name"})
    rows = rows.unionByName(project.to_quads(n, "source", node("nation", "n_nationkey"), [project.iri(TYPE, F.lit(f"{EX}Nation")), project.literal(f"{EX}displayName", F.col("n_name")), project.iri(f"{EX}partOf", node("region", "n_regionkey"))]))
    rows = rows.unionByName(project.to_quads(c, "source", node("customer", "c_custkey"), [project.iri(TYPE, F.lit(f"{EX}Customer")), project.literal(f"{EX}displayName", F.col("c_name")), project.literal(f"{EX}balance", F.col("c_acctbal"), "decimal"), project.iri(f"{EX}inNation", node("nation", "c_nationkey"))]))
    schema = [(f"{EX}Nation", f"{RDFS}subClassOf", f"{EX}Place"), (f"{EX}Region", f"{RDFS}subClassOf", f"{EX}Place"), (f"{EX}Place", f"{RDFS}subClassOf", f"{EX}BusinessObject"), (f"{EX}Customer", f"{RDFS}subClassOf", f"{EX}BusinessObject"), (f"{EX}inNation", f"{RDFS}subPropertyOf", f"{EX}partOf"), (f"{EX}partOf", TYPE, f"{OWL}TransitiveProperty"), (f"{EX}partOf", f"{OWL}inverseOf", f"{EX}hasPart")]
    tbox = spark.createDataFrame([("ontology", s, p, "iri", o, None, None) for s, p, o in schema], QUAD)
    return rows.unionByName(tbox)


@register("O1_objects", f"SELECT subject, predicate, object FROM (SELECT concat('{EX}region/', r_regionkey) AS subject, unnest([{{'predicate': '{TYPE}', 'object': '{EX}Region'}}, {{'predicate': '{EX}displayName', 'object': r_name}}], recursive := true) FROM region)")
def o1(spark, sf):
    return project.objects(t(spark, sf, "region"), "source", F.concat(F.lit(f"{EX}region/"), F.col("r_regionkey")), "Region", {"displayName": "r_name"}).select("subject", "predicate", "object")


@register(
    "O3_relations",
    f"""SELECT concat('{EX}', o_custkey) AS subject, '{EX}has' AS predicate, concat('{EX}', o_orderkey) AS object FROM orders UNION ALL
    SELECT concat('{EX}relation/', o_orderkey), unnest(['{TYPE}', '{EX}relationSubject', '{EX}relationPredicate', '{EX}relationObject']), unnest(['{EX}RelationAssertion', concat('{EX}', o_custkey), '{EX}has', concat('{EX}', o_orderkey)]) FROM orders WHERE o_orderstatus = 'F'""",
)
def o3(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("relation_id"), F.concat(F.lit(EX), "o_custkey").alias("subject_iri"), F.lit(f"{EX}has").alias("predicate_iri"), F.concat(F.lit(EX), "o_orderkey").alias("object_iri"), (F.col("o_orderstatus") == "F").alias("temporal"), F.lit(False).alias("object_is_location"))
    return project.relations(o, "source").select("subject", "predicate", "object")


@register("O4_events", f"SELECT concat('{EX}event/', event_id) AS subject, unnest(['{TYPE}', '{TYPE}', '{EX}hasSubject', '{EX}occurredAt']) AS predicate FROM events")
def o4(spark, sf):
    e = t(spark, sf, "events").select(F.concat(F.lit(f"{EX}event/"), "event_id").alias("event_iri"), F.initcap("event_type").alias("class_name"), F.concat(F.lit(f"{EX}user/"), "user_id").alias("subject_iri"), F.col("ts").cast("string").alias("occurred_at"))
    return project.events(e, "source").select("subject", "predicate")


@register("O8_preflight", "SELECT count(*) AS rows, count(*) FILTER (p_size > 40) AS blank_site, 0::BIGINT AS blank_asset FROM part")
def o8(spark, sf):
    p = t(spark, sf, "part").select(F.when(F.col("p_size") <= 40, F.col("p_type")).alias("site"), F.col("p_partkey").alias("asset"))
    return project.preflight(p, ["site", "asset"])


@register("O9_provenance_coverage", "SELECT 'source' AS graph, (SELECT count(*) * 2 FROM region) + (SELECT count(*) * 3 FROM nation) + (SELECT count(*) * 4 FROM customer) AS eligible, (SELECT count(*) * 4 FROM customer WHERE c_custkey % 2 = 0) AS covered")
def o9(spark, sf):
    q = quads(spark, sf)
    s = t(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit(f"{EX}customer/"), "c_custkey").alias("subject"))
    return project.coverage(q, q.limit(0).select(F.lit("").alias("statement_id")), s).select("graph", "eligible", "covered")


_CL = f"""WITH RECURSIVE b(s, p, o) AS (SELECT concat('{EX}nation/', n_nationkey), '{EX}partOf', concat('{EX}region/', n_regionkey) FROM nation UNION SELECT concat('{EX}customer/', c_custkey), '{EX}partOf', concat('{EX}nation/', c_nationkey) FROM customer),
  tc(s, o) AS (SELECT s, o FROM b UNION SELECT tc.s, b.o FROM tc JOIN b ON tc.o = b.s),
  ty(s, c) AS (SELECT concat('{EX}region/', r_regionkey), '{EX}Region' FROM region UNION SELECT concat('{EX}nation/', n_nationkey), '{EX}Nation' FROM nation UNION SELECT concat('{EX}customer/', c_custkey), '{EX}Customer' FROM customer),
  sup(a, b) AS (VALUES ('{EX}Nation', '{EX}Place'), ('{EX}Region', '{EX}Place'), ('{EX}Nation', '{EX}BusinessObject'), ('{EX}Region', '{EX}BusinessObject'), ('{EX}Customer', '{EX}BusinessObject')),
  inf AS (SELECT s, '{TYPE}' AS p, b AS o FROM ty JOIN sup ON c = a UNION SELECT s, '{EX}partOf', o FROM tc WHERE NOT (s LIKE '{EX}nation/%' AND o LIKE '{EX}region/%') UNION SELECT o, '{EX}hasPart', s FROM tc)"""


@register("O10_closure", f"{_CL} SELECT s AS subject, p AS predicate, o AS object FROM inf")
def o10(spark, sf):
    return closure(quads(spark, sf))[0].select("subject", "predicate", "object")


@register("O12_shapes", f"SELECT concat('{EX}customer/', c_custkey) AS focus, '{EX}displayName' AS path, 'minCount' AS code FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT concat('{EX}customer/', c_custkey), '{EX}inNation', 'class' FROM customer WHERE c_nationkey = 3")
def o12(spark, sf):
    q = quads(spark, sf)
    q = q.filter(~((F.col("predicate") == f"{EX}displayName") & F.col("subject").rlike("customer/([0-9]*0)$")))
    q = q.filter(~((F.col("predicate") == TYPE) & (F.col("subject") == f"{EX}nation/3")))
    shape = Shape(f"{EX}CustomerShape", f"{EX}Customer", properties=[Property(f"{EX}displayName", min_count=1, datatype=f"{XSD}string"), Property(f"{EX}inNation", min_count=1, max_count=1, node_kind="IRI", class_=f"{EX}Place")])
    return validate_shapes(q, [shape]).select("focus", "path", "code")


@register("O13_sparql_join", f"SELECT concat('{EX}customer/', c_custkey) AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 5000")
def o13_join(spark, sf):
    return select(quads(spark, sf), f"PREFIX ex: <{EX}> SELECT ?c ?name WHERE {{ ?c ex:inNation ?n ; ex:balance ?b . ?n ex:displayName ?name ; ex:partOf <{EX}region/2> . FILTER(?b > 5000) }}", cap=None)


@register("O13_sparql_group", "SELECT n_name AS name, CAST(count(*) AS VARCHAR) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 55")
def o13_group(spark, sf):
    return select(quads(spark, sf), f"PREFIX ex: <{EX}> SELECT ?name (COUNT(?c) AS ?n) WHERE {{ ?c ex:inNation ?x . ?x ex:displayName ?name }} GROUP BY ?name HAVING (COUNT(?c) > 55)", cap=None)


@register("O13_sparql_minus_union", f"SELECT concat('{EX}nation/', n_nationkey) AS x FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) UNION ALL SELECT concat('{EX}region/', r_regionkey) FROM region")
def o13_minus(spark, sf):
    return select(quads(spark, sf), f"PREFIX ex: <{EX}> SELECT ?x WHERE {{ {{ ?x a ex:Nation MINUS {{ ?c ex:inNation ?x ; ex:balance ?b FILTER(?b > 9900) }} }} UNION {{ ?x a ex:Region }} }}", cap=None)


@register("O15_contract_count", "SELECT CAST(count(*) AS VARCHAR) AS count FROM customer")
def o15_count(spark, sf):
    return select(quads(spark, sf), f"PREFIX ex: <{EX}> SELECT (COUNT(?device) AS ?count) WHERE {{ ?device a ex:Customer . }}")


@register("O15_contract_context", f"SELECT concat('{EX}nation/', n_nationkey) AS device, n_name AS name, CASE WHEN n_regionkey = 1 THEN concat('{EX}region/', n_regionkey) END AS location FROM nation")
def o15_context(spark, sf):
    return select(quads(spark, sf), f"PREFIX ex: <{EX}> SELECT ?device ?name ?location WHERE {{ ?device a ex:Nation ; ex:displayName ?name . OPTIONAL {{ ?device ex:partOf ?location . FILTER(?location = <{EX}region/1>) }} }} LIMIT 100")


@register("O15_contract_subclass", "SELECT CAST((SELECT count(*) FROM customer) + 0 AS VARCHAR) AS count")
def o15_subclass(spark, sf):
    q = f"PREFIX ex: <{EX}> PREFIX rdfs: <{RDFS}> SELECT (COUNT(?r) AS ?count) WHERE {{ ?r a ?c . ?c rdfs:subClassOf ex:BusinessObject . }}"
    return select(quads(spark, sf), q)


@register("O16_statements", f"SELECT concat('{EX}nation/', n_nationkey) AS subject, n_name AS object FROM nation ORDER BY 1, 2 LIMIT 10")
def o16(spark, sf):
    return project.statements(quads(spark, sf).filter(F.col("subject").contains("nation/")), predicate=f"{EX}displayName", limit=10).select("subject", "object")


@register("O17_document", f"SELECT '{EX}nation/3' AS subject, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS name, 3 AS n_properties")
def o17(spark, sf):
    d = project.document(quads(spark, sf), f"{EX}nation/3")
    return d.select("subject", F.element_at("properties", F.lit(f"{EX}displayName"))[0].alias("name"), F.size("properties").alias("n_properties"))


@register("O18_device_context", f"SELECT 'event' AS section, concat('{EX}event/', event_id) AS id FROM events WHERE user_id = 8 AND ts <= TIMESTAMP '2024-01-20'")
def o18(spark, sf):
    e = t(spark, sf, "events").select(F.concat(F.lit(f"{EX}event/"), "event_id").alias("event_iri"), F.initcap("event_type").alias("class_name"), F.concat(F.lit(f"{EX}user/"), "user_id").alias("subject_iri"), F.col("ts").cast("string").alias("occurred_at"))
    return project.device_context(project.events(e, "source"), f"{EX}user/8", "2024-01-20T00:00:00", 500).select("section", "id")


@register("O19_fallback", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'canonical' ELSE 'pending' END AS origin FROM customer")
def o19(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return project.with_fallback(c.filter("k % 3 = 0"), c, "k")


@register("O21_explain", "SELECT 'fact' AS role, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id = 7 UNION ALL SELECT 'input', CAST(event_id // 2 AS VARCHAR) FROM events WHERE event_id = 7 UNION ALL SELECT 'derived', CAST(event_id AS VARCHAR) FROM events WHERE event_id // 2 = 7")
def o21(spark, sf):
    """Each event is derived from that of half its number."""
    k = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("fact_id"), F.col("event_id").cast("string").alias("output_fact_id"), F.expr("CAST(event_id div 2 AS string)").alias("input_fact_id"))
    none = k.limit(0).select(F.array("fact_id").alias("input_fact_ids"), F.col("fact_id").alias("decision_id"))
    return project.explain(k.select("fact_id"), k, none, "7")


@register("O22_truth_coverage", "SELECT o_orderstatus AS kind, count(*) AS relational, count(*) FILTER (o_orderkey % 4 = 0) AS canonical, count(*) - count(*) FILTER (o_orderkey % 4 = 0) AS missing FROM orders GROUP BY 1")
def o22(spark, sf):
    o = t(spark, sf, "orders").withColumnRenamed("o_orderstatus", "kind")
    return project.truth_coverage(o.filter("o_orderkey % 4 = 0"), o, "kind")


@register("A24_graph_counts", "SELECT 'source' AS graph, (SELECT count(*) * 2 FROM region) + (SELECT count(*) * 3 FROM nation) + (SELECT count(*) * 4 FROM customer) AS statements, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS resources UNION ALL SELECT 'ontology', 7, 6")
def a24(spark, sf):
    return project.graph_counts(quads(spark, sf))


@register("U2_union_graph", "SELECT (SELECT count(*) * 2 FROM region) + (SELECT count(*) * 3 FROM nation) + (SELECT count(*) * 4 FROM customer) + 7 AS n")
def u2(spark, sf):
    q = quads(spark, sf)
    return project.union_graph(q, q.withColumn("graph", F.lit("copy"))).agg(F.count("*").alias("n"))


@register("J18_triple_self_join", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def j18(spark, sf):
    q = quads(spark, sf)
    a = q.filter(F.col("predicate") == f"{EX}partOf").select(F.col("subject").alias("s"), F.col("object").alias("r"))
    n = q.filter(F.col("predicate") == f"{EX}displayName").select("subject", "object")
    return a.join(n.select(F.col("subject").alias("s"), F.col("object").alias("name")), "s").join(n.select(F.col("subject").alias("r"), F.col("object").alias("region")), "r").select("name", "region")
