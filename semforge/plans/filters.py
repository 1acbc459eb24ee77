"""F, J and U operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semforge.functions.text import default_label, first_non_blank, jaccard
from semforge.operators import reads
from semforge.plans.tables import CANDIDATES, DEVICES, candidates, devices, t
from semforge.registry import register


@register("F1_eligible_rows", f"SELECT candidate_id, device_id FROM {CANDIDATES} WHERE confidence = 'high' AND evidence_level IN ('strong','source_preview_and_replay') AND status = 'candidate' AND review_state = 'pending' AND NOT published AND trim(proposed) <> ''")
def f1(spark, sf):
    return reads.eligible(candidates(spark, sf)).select("candidate_id", "device_id")


@register("F2_search", f"SELECT source_schema, site, asset, name FROM {DEVICES} WHERE name ILIKE '%BOLT%' OR site ILIKE '%BOLT%' OR source_schema ILIKE '%BOLT%' OR asset ILIKE '%BOLT%'")
def f2(spark, sf):
    return reads.search(devices(spark, sf), "BOLT", ["name", "site", "source_schema", "asset"]).select("source_schema", "site", "asset", "name")


@register("F2_indexed_search", f"SELECT source_schema, site, asset, name FROM {DEVICES} WHERE name ILIKE '%BOLT%' OR site ILIKE '%BOLT%' OR source_schema ILIKE '%BOLT%' OR asset ILIKE '%BOLT%'")
def f2_indexed(spark, sf):
    d, columns = devices(spark, sf), ["name", "site", "source_schema", "asset"]
    return reads.indexed_search(d, reads.search_index(d, columns, columns), columns, "BOLT", columns).select(*columns)


@register("F3_facet_filter", f"SELECT asset, name FROM {DEVICES} WHERE site = 'ECONOMY' AND source_schema = 'Brand#4'")
def f3(spark, sf):
    return reads.facet_filter(devices(spark, sf), {"site": "ECONOMY", "source_schema": "Brand#4", "location": "all", "name": None}).select("asset", "name")


@register("F4_quick_filter", f"SELECT candidate_id FROM {CANDIDATES} WHERE len(list_filter(reason_codes, lambda x: contains(x, 'LOW_'))) > 0")
def f4(spark, sf):
    return reads.quick_filter(candidates(spark, sf), "low").select("candidate_id")


@register("F5_auto_approvable", f"SELECT candidate_id FROM {CANDIDATES} WHERE trim(proposed) = trim(original) AND len(list_filter(reason_codes, lambda x: contains(x, 'CONFLICT') OR contains(x, 'BLOCK'))) = 0")
def f5(spark, sf):
    return reads.auto_approvable(candidates(spark, sf)).select("candidate_id")


@register(
    "F5b_assist_eligible",
    f"""SELECT c.candidate_id FROM {CANDIDATES} c WHERE confidence = 'high' AND evidence_level IN ('strong','source_preview_and_replay') AND status = 'candidate'
    AND review_state = 'pending' AND NOT published AND len(list_filter(reason_codes, lambda x: contains(x, 'CONFLICT') OR contains(x, 'BLOCK'))) = 0
    AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.candidate_id AND l.l_returnflag = 'R')""",
)
def f5b(spark, sf):
    audits = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.when(F.col("l_returnflag") == "R", "isolate").otherwise("keep").alias("decision"))
    return reads.assist_eligible(candidates(spark, sf), audits).select("candidate_id")


@register("F6_active_only", f"SELECT asset FROM {DEVICES} WHERE trim(name) <> '' AND site NOT IN ('SMALL')")
def f6(spark, sf):
    return reads.active_only(devices(spark, sf), "name", "site", ["SMALL"]).select("asset")


@register("F7_published_rule", f"SELECT candidate_id FROM {CANDIDATES} WHERE list_contains(reason_codes, 'DEFERRED')")
def f7(spark, sf):
    return reads.published_filter(candidates(spark, sf).withColumnRenamed("reason_codes", "rule_ids"), "DEFERRED", {"digits": "[0-9]"}).select("candidate_id")


@register("F8_as_of", "SELECT event_id, user_id FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00'")
def f8(spark, sf):
    return reads.as_of(t(spark, sf, "events"), "ts", "2024-01-10 00:00:00").select("event_id", "user_id")


@register("F9_no_backups", f"SELECT asset, concat(name, CASE WHEN CAST(asset AS BIGINT) % 3 = 0 THEN '_back' WHEN CAST(asset AS BIGINT) % 3 = 1 THEN '20240101' ELSE '' END) AS table_name FROM {DEVICES} WHERE CAST(asset AS BIGINT) % 3 = 2")
def f9(spark, sf):
    k = F.col("asset").cast("long") % 3
    d = devices(spark, sf).withColumn("table_name", F.concat("name", F.when(k == 0, "_back").when(k == 1, "20240101").otherwise("")))
    return reads.no_backups(d, "table_name").select("asset", "table_name")


@register("F10_default_label", "SELECT coalesce(nullif(trim(CASE WHEN p_size > 25 THEN ' ' ELSE p_type END), ''), '未分类') AS label, count(*) AS n FROM part GROUP BY 1")
def f10(spark, sf):
    p = t(spark, sf, "part").withColumn("x", F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_type")))
    return p.groupBy(default_label(F.col("x")).alias("label")).agg(F.count("*").alias("n"))


@register("F11_first_non_blank", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN '  ' END), ''), nullif(trim(CASE WHEN p_size % 3 = 0 THEN p_type END), ''), p_name) AS label FROM part")
def f11(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", first_non_blank(F.when(F.col("p_size") % 2 == 0, "  "), F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.col("p_name")).alias("label"))


@register("F12_json_path", "SELECT event_id, CAST(json_extract_string(try_cast(props AS JSON), '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(try_cast(props AS JSON), '$.k') AS BIGINT) > 90")
def f12(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t(spark, sf, "events").select("event_id", k.alias("k")).filter("k > 90")


_IDENTITY = "c_custkey AS device_id, c_name AS device_name, c_nationkey AS site_key"


def _identity(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_name").alias("device_name"), F.col("c_nationkey").alias("site_key"))


@register("J1_review_queue", f"SELECT candidate_id, device_name, review_state FROM {CANDIDATES} c JOIN (SELECT {_IDENTITY} FROM customer) i USING (device_id) WHERE review_state = 'pending'")
def j1(spark, sf):
    return candidates(spark, sf).filter("review_state = 'pending'").join(_identity(spark, sf), "device_id").select("candidate_id", "device_name", "review_state")


@register("J2_publishable", f"SELECT candidate_id, device_name, n_name AS site FROM {CANDIDATES} c JOIN (SELECT {_IDENTITY} FROM customer) i USING (device_id) JOIN nation ON site_key = n_nationkey WHERE status = 'candidate' AND confidence = 'high'")
def j2(spark, sf):
    c = candidates(spark, sf).filter("status = 'candidate' AND confidence = 'high'")
    n = t(spark, sf, "nation")
    return c.join(_identity(spark, sf), "device_id").join(n, F.col("site_key") == F.col("n_nationkey")).select("candidate_id", "device_name", F.col("n_name").alias("site"))


@register("J3_published", f"SELECT candidate_id, device_name, n_name AS site, r_name AS area FROM {CANDIDATES} c JOIN (SELECT {_IDENTITY} FROM customer) i USING (device_id) JOIN nation ON site_key = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE published")
def j3(spark, sf):
    c = candidates(spark, sf).filter("published")
    out = c.join(_identity(spark, sf), "device_id").join(t(spark, sf, "nation"), F.col("site_key") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("candidate_id", "device_name", F.col("n_name").alias("site"), F.col("r_name").alias("area"))


@register("J4_approval_queue", f"SELECT candidate_id, device_name, r.receipt FROM {CANDIDATES} c JOIN (SELECT {_IDENTITY} FROM customer) i USING (device_id) LEFT JOIN (SELECT l_orderkey, count(*) AS receipt FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) r ON r.l_orderkey = candidate_id WHERE review_state = 'pending'")
def j4(spark, sf):
    r = t(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.count("*").alias("receipt"))
    c = candidates(spark, sf).filter("review_state = 'pending'").join(_identity(spark, sf), "device_id")
    return c.join(r, F.col("candidate_id") == F.col("l_orderkey"), "left").select("candidate_id", "device_name", "receipt")


@register(
    "J5_device_context",
    """SELECT c_custkey AS device_id, n_name AS location, e.event_id AS latest_event, o.o_orderkey AS latest_order FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e ON e.user_id = c_custkey AND e.rn = 1
    LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o.o_custkey = c_custkey AND o.rn = 1""",
)
def j5(spark, sf):
    e = reads.latest_by(t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    o = reads.latest_by(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = c.join(e, F.col("user_id") == F.col("c_custkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select(F.col("c_custkey").alias("device_id"), F.col("n_name").alias("location"), F.col("event_id").alias("latest_event"), F.col("o_orderkey").alias("latest_order"))


@register("J6_parent_pointer", "SELECT n.n_nationkey AS code, p.n_name AS parent_label, CASE WHEN p.n_nationkey IS NULL THEN 'needs_review' ELSE 'accepted' END AS decision, CASE WHEN p.n_nationkey IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM nation n LEFT JOIN nation p ON p.n_nationkey = n.n_nationkey - 5 AND p.n_regionkey = n.n_regionkey")
def j6(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("scope"), (F.col("n_nationkey") - 5).alias("parent"))
    return reads.with_parent(n, ["scope"], "code", "parent", "label").select("code", "parent_label", "decision", "score")


@register("J7_cross_schema", f"SELECT l.source_schema AS left_schema, r.source_schema AS right_schema, l.site, l.name, count(*) AS n FROM {DEVICES} l JOIN {DEVICES} r ON l.site = r.site AND l.name = r.name AND l.location = r.location AND l.source_schema < r.source_schema GROUP BY ALL")
def j7(spark, sf):
    d = devices(spark, sf)
    left, right = d.alias("l"), d.alias("r")
    on = (F.col("l.site") == F.col("r.site")) & (F.col("l.name") == F.col("r.name")) & (F.col("l.location") == F.col("r.location")) & (F.col("l.source_schema") < F.col("r.source_schema"))
    return left.join(right, on).groupBy(F.col("l.source_schema").alias("left_schema"), F.col("r.source_schema").alias("right_schema"), F.col("l.site").alias("site"), F.col("l.name").alias("name")).agg(F.count("*").alias("n"))


@register(
    "J9_context_enrichment",
    """SELECT c_custkey AS device_id, n_name AS location, r_name AS hierarchy, coalesce(o.n, 0) AS n_orders, o.keys AS order_keys FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def j9(spark, sf):
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))).alias("order_keys"))
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("device_id"), F.col("n_name").alias("location"), F.col("r_name").alias("hierarchy"), F.coalesce("n", F.lit(0)).alias("n_orders"), "order_keys")


@register("J10_semi", f"SELECT candidate_id FROM {CANDIDATES} c WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = candidate_id AND l_discount > 0.09)")
def j10(spark, sf):
    sample = t(spark, sf, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("candidate_id"))
    return candidates(spark, sf).select("candidate_id").join(sample, "candidate_id", "left_semi")


@register("J11_unbound", f"SELECT candidate_id FROM {CANDIDATES} c WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = candidate_id AND l_returnflag = 'R')")
def j11(spark, sf):
    bound = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return candidates(spark, sf).select("candidate_id").join(bound, F.col("candidate_id") == F.col("l_orderkey"), "left_anti")


@register("J12_exclusion_split", f"SELECT candidate_id, CASE WHEN device_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'LOCATION_MISSING' ELSE 'kept' END AS side FROM {CANDIDATES}")
def j12(spark, sf):
    ids = t(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("device_id"))
    kept, out = reads.split_by(candidates(spark, sf), ids, "device_id", "LOCATION_MISSING")
    return kept.select("candidate_id", F.lit("kept").alias("side")).unionByName(out.select("candidate_id", F.col("exclusion_reason").alias("side")))


@register("J13_prefix_join", f"SELECT a.site, e.location, count(*) AS n FROM (SELECT DISTINCT site, location FROM {DEVICES} WHERE length(location) = 2) e JOIN {DEVICES} a ON a.site = e.site AND starts_with(a.location, e.location) GROUP BY ALL")
def j13(spark, sf):
    d = devices(spark, sf)
    e = d.filter(F.length("location") == 2).select("site", "location").distinct()
    return reads.prefix_join(e, d.select("site", "location", "asset"), ["site"], "location").groupBy("site", "location").agg(F.count("*").alias("n"))


@register("J15_dictionary_join", "SELECT o_orderkey, d.canonical FROM orders o JOIN (VALUES ('F', '1-URGENT', 'CLOSED'), ('O', '1-URGENT', 'PENDING'), ('P', '2-HIGH', 'PROCESSING')) d(status, priority, canonical) ON o_orderstatus = status AND o_orderpriority = priority")
def j15(spark, sf):
    d = spark.createDataFrame([("F", "1-URGENT", "CLOSED"), ("O", "1-URGENT", "PENDING"), ("P", "2-HIGH", "PROCESSING")], "status string, priority string, canonical string")
    o = t(spark, sf, "orders")
    # The dictionary is a literal of three rows.
    return o.join(F.broadcast(d), (F.col("o_orderstatus") == F.col("status")) & (F.col("o_orderpriority") == F.col("priority"))).select("o_orderkey", "canonical")


@register(
    "J17_full_outer_compare",
    """SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS left_count, coalesce(b.n, 0) AS right_count, CASE WHEN a.k IS NULL THEN 'RIGHT_ONLY' WHEN b.k IS NULL THEN 'LEFT_ONLY' WHEN a.n = b.n THEN 'same' ELSE 'needs_review' END AS status
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k""",
)
def j17(spark, sf):
    a = t(spark, sf, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("ka")).agg(F.count("*").alias("na"))
    b = t(spark, sf, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("kb")).agg(F.count("*").alias("nb"))
    status = F.when(F.col("ka").isNull(), "RIGHT_ONLY").when(F.col("kb").isNull(), "LEFT_ONLY").when(F.col("na") == F.col("nb"), "same").otherwise("needs_review")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias("key"), F.coalesce("na", F.lit(0)).alias("left_count"), F.coalesce("nb", F.lit(0)).alias("right_count"), status.alias("status"))


@register("J19_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)")
def j19(spark, sf):
    c = t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").select("c_custkey")
    return t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@register("J20_scalar_lookup", "SELECT n_nationkey AS code, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS parent_label, (SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey) AS first_name FROM nation")
def j20(spark, sf):
    first = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("first_name"))
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.join(first, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_nationkey").alias("code"), F.col("r_name").alias("parent_label"), "first_name")


@register("J22_referential", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 1)")
def j22(spark, sf):
    return reads.unmatched(t(spark, sf, "lineitem"), t(spark, sf, "part").filter("p_size > 1"), [("l_partkey", "p_partkey")]).select("l_orderkey", "l_linenumber")


@register("U1_timeline", "SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts AS at FROM events WHERE user_id = 8 UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders WHERE o_custkey = 8)")
def u1(spark, sf):
    e = t(spark, sf, "events").filter("user_id = 8").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    o = t(spark, sf, "orders").filter("o_custkey = 8").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return e.unionByName(o).orderBy(F.desc("at"), "kind", "id")


@register("U5_state_diff", """SELECT coalesce(a.user_id, b.user_id) AS subject, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.event_type <> b.event_type THEN 'state_changed' ELSE 'effective_time_changed' END AS change
  FROM (SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE ts < TIMESTAMP '2024-01-02') WHERE rn = 1) a
  FULL JOIN (SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE ts >= TIMESTAMP '2024-01-29') WHERE rn = 1) b ON a.user_id = b.user_id
  WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.event_type <> b.event_type OR a.ts <> b.ts""")
def u5(spark, sf):
    from semforge.operators.states import diff_states

    e = t(spark, sf, "events")

    def last(rows):
        return reads.latest_by(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(F.col("user_id").alias("subject"), F.col("event_type").alias("state"), F.col("ts").alias("effective_at"))

    return diff_states(last(e.filter("ts < timestamp_ntz'2024-01-02'")), last(e.filter("ts >= timestamp_ntz'2024-01-29'")), "subject").select("subject", "change")


@register("U6_distinct_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u6(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, sf, "supplier").select("s_nationkey")).distinct()


@register("U8_set_overlap", """SELECT a.p_name AS a, b.p_name AS b, CAST(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) AS DOUBLE) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) AS score
  FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON string_split(a.p_name, ' ')[1] = string_split(b.p_name, ' ')[1] AND a.p_name < b.p_name""")
def u8(spark, sf):
    p = t(spark, sf, "part").select("p_name").distinct().select("p_name", F.split("p_name", " ").alias("w"))
    a, b = p.select(F.col("p_name").alias("a"), F.col("w").alias("wa")), p.select(F.col("p_name").alias("b"), F.col("w").alias("wb"))
    return a.join(b, (F.get("wa", 0) == F.get("wb", 0)) & (F.col("a") < F.col("b"))).select("a", "b", jaccard(F.col("wa"), F.col("wb")).alias("score"))


@register("S15_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def s15(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return reads.merge(c.filter("k % 2 = 0").withColumn("v", F.lit("old")), c.filter("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])
