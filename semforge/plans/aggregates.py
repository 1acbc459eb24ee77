"""A and W operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semforge.functions.text import code_shape, number_skeleton
from semforge.operators import profile, reads, sampling
from semforge.plans.tables import CANDIDATES, DEVICES, candidates, devices, t
from semforge.registry import register


@register(
    "A1_quality_by_site",
    f"""SELECT device_id % 25 AS site, count(*) AS total, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (status = 'candidate') AS waiting,
    count(*) FILTER (published) AS published, count(*) FILTER (evidence_level = 'strong') AS strong, count(*) FILTER (len(reason_codes) = 0) AS clean, count(*) FILTER (review_state = 'pending') AS pending,
    count(DISTINCT device_id) AS devices FROM {CANDIDATES} GROUP BY 1""",
)
def a1(spark, sf):
    def of(cond):
        return F.count(F.when(cond, 1))

    c = candidates(spark, sf)
    return c.groupBy((F.col("device_id") % 25).alias("site")).agg(F.count("*").alias("total"), of(F.col("confidence") == "high").alias("high"), of(F.col("confidence") == "low").alias("low"), of(F.col("status") == "candidate").alias("waiting"), of(F.col("published")).alias("published"), of(F.col("evidence_level") == "strong").alias("strong"), of(F.size("reason_codes") == 0).alias("clean"), of(F.col("review_state") == "pending").alias("pending"), F.countDistinct("device_id").alias("devices"))


@register("A2_reason_codes", f"SELECT code AS value, count(*) AS n FROM (SELECT unnest(list_distinct(reason_codes)) AS code FROM {CANDIDATES}) GROUP BY 1")
def a2(spark, sf):
    return reads.exploded_counts(candidates(spark, sf), "reason_codes")


@register("A3_context_coverage", "SELECT count(*) AS total, count(*) FILTER (TRY_CAST(json_extract_string(try_cast(props AS JSON), '$.k') AS BIGINT) > 0) AS with_context, count(*) FILTER (value > 50) AS with_value FROM events")
def a3(spark, sf):
    return t(spark, sf, "events").agg(F.count("*").alias("total"), F.count_if(F.get_json_object("props", "$.k").try_cast("long") > 0).alias("with_context"), F.count_if(F.col("value") > 50).alias("with_value"))


@register("A4_description_frequency", f"SELECT name, count(*) AS n FROM {DEVICES} GROUP BY 1")
def a4(spark, sf):
    return reads.counts_by(devices(spark, sf), "name")


@register("A5_dashboard", f"SELECT count(*) AS total, sum(CASE WHEN published THEN 1 ELSE 0 END)::BIGINT AS published, sum(CASE WHEN review_state = 'pending' THEN 1 ELSE 0 END)::BIGINT AS pending, sum(CASE WHEN confidence = 'high' AND NOT published THEN 1 ELSE 0 END)::BIGINT AS ready FROM {CANDIDATES}")
def a5(spark, sf):
    return candidates(spark, sf).agg(F.count("*").alias("total"), F.sum(F.when(F.col("published"), 1).otherwise(0)).alias("published"), F.sum(F.when(F.col("review_state") == "pending", 1).otherwise(0)).alias("pending"), F.sum(F.when((F.col("confidence") == "high") & ~F.col("published"), 1).otherwise(0)).alias("ready"))


@register("A6_top_sites_share", "SELECT c_nationkey AS site, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM customer GROUP BY 1 ORDER BY n DESC, site LIMIT 10")
def a6(spark, sf):
    return reads.share_of_total(t(spark, sf, "customer").withColumnRenamed("c_nationkey", "site"), "site", most=10)


@register("A7_facets", f"SELECT location AS value, count(*) AS n FROM {DEVICES} GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a7(spark, sf):
    return reads.facets(devices(spark, sf), "location", 20)


@register("A8_metadata_summary", f"SELECT 'site' AS facet, site AS value, count(*) AS n FROM {DEVICES} GROUP BY 2 UNION ALL SELECT 'source_schema', source_schema, count(*) FROM {DEVICES} GROUP BY 2 UNION ALL SELECT 'location', location, count(*) FROM {DEVICES} GROUP BY 2 UNION ALL SELECT 'name', name, count(*) FROM {DEVICES} GROUP BY 2")
def a8(spark, sf):
    return reads.metadata_summary(devices(spark, sf), ["site", "source_schema", "location", "name"])


@register("A9_two_level_counts", "SELECT o_orderpriority AS type, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def a9(spark, sf):
    return reads.counts_by(t(spark, sf, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status")), "type", "status")


@register("A10_conflicts", "SELECT l_partkey, l_suppkey % 10 AS bucket, count(DISTINCT l_returnflag) AS n_values, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS \"values\" FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def a10(spark, sf):
    x = t(spark, sf, "lineitem").withColumn("bucket", F.col("l_suppkey") % 10)
    return reads.conflicts(x, ["l_partkey", "bucket"], "l_returnflag").withColumn("values", F.concat_ws(",", "values"))


@register("A11_duplicates", f"SELECT source_schema, site, name, count(*) AS n FROM {DEVICES} GROUP BY ALL HAVING count(*) > 1")
def a11(spark, sf):
    return reads.duplicates(devices(spark, sf), "source_schema", "site", "name")


@register("A12_status_examples", "SELECT o_orderstatus, max(c) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3) AS examples FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders) GROUP BY 1")
def a12(spark, sf):
    return reads.with_examples(t(spark, sf, "orders"), "o_orderstatus", [F.desc("o_orderdate"), F.col("o_orderkey")], "o_orderkey")


@register("A13_history_stats", "SELECT user_id, event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def a13(spark, sf):
    return t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@register(
    "A14_batch_profile",
    "SELECT count(*) AS total, count(DISTINCT p_name) AS names, count(*) FILTER (length(p_name) < 10) AS short, count(*) FILTER (length(p_name) >= 10 AND length(p_name) < 12) AS medium, count(*) FILTER (length(p_name) >= 12) AS long, count(*) FILTER (p_name LIKE 'blue%') AS blue, max(length(p_name))::INTEGER AS longest, min(length(p_name))::INTEGER AS shortest FROM part",
)
def a14(spark, sf):
    n = F.length("p_name")
    return t(spark, sf, "part").agg(F.count("*").alias("total"), F.countDistinct("p_name").alias("names"), F.count_if(n < 10).alias("short"), F.count_if((n >= 10) & (n < 12)).alias("medium"), F.count_if(n >= 12).alias("long"), F.count_if(F.col("p_name").startswith("blue")).alias("blue"), F.max(n).alias("longest"), F.min(n).alias("shortest"))


@register(
    "A14_batch_sketches",
    """SELECT p_brand AS batch, count(*) AS rows, min(p_name) AS least, max(p_name) AS greatest, min(p_size)::BIGINT AS smallest, max(p_size)::BIGINT AS largest, true AS distinct_within, true AS median_within FROM part GROUP BY 1
    UNION ALL SELECT 'all', count(*), min(p_name), max(p_name), min(p_size)::BIGINT, max(p_size)::BIGINT, true, true FROM part""",
)
def a14_sketches(spark, sf):
    """Counters of each batch and of their merged sketches, and whether the estimates are within their bounds of the exact figures."""
    p = t(spark, sf, "part").select(F.col("p_brand").alias("batch"), "p_name", F.col("p_size").cast("long").alias("p_size"))
    kept = profile.sketch(p, "batch", ["p_name"], ["p_size"])
    every = profile.estimates(kept, ["p_name"], ["p_size"], [0.5]).unionByName(profile.estimates(profile.merged(kept, ["p_name"], ["p_size"]), ["p_name"], ["p_size"], [0.5]).withColumn("batch", F.lit("all")))
    each = p.unionByName(p.withColumn("batch", F.lit("all")))
    found = each.join(every, "batch").groupBy("batch", "rows", "p_name_least", "p_name_greatest", "p_size_least", "p_size_greatest", "p_name_distinct", "p_size_quantiles")
    median = F.get("p_size_quantiles", 0)
    share = found.agg(F.countDistinct("p_name").alias("names"), (F.count_if(F.col("p_size") < median) / F.count("*")).alias("below"), (F.count_if(F.col("p_size") <= median) / F.count("*")).alias("upto"))
    distinct = F.abs(F.col("p_name_distinct") - F.col("names")) <= F.greatest(F.lit(1.0), profile.DISTINCT_ERROR * F.col("names"))
    within = (F.col("below") <= 0.5 + profile.RANK_ERROR) & (F.col("upto") >= 0.5 - profile.RANK_ERROR)
    return share.select("batch", "rows", F.col("p_name_least").alias("least"), F.col("p_name_greatest").alias("greatest"), F.col("p_size_least").alias("smallest"), F.col("p_size_greatest").alias("largest"), distinct.alias("distinct_within"), within.alias("median_within"))


@register("A15_code_shapes", "SELECT regexp_replace(regexp_replace(regexp_replace(upper(c_name), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[^9A]', 'X', 'g') AS shape, count(*) AS n FROM customer GROUP BY 1")
def a15(spark, sf):
    return t(spark, sf, "customer").groupBy(code_shape(F.col("c_name")).alias("shape")).agg(F.count("*").alias("n"))


@register("A16_mode", "SELECT site, name, n, variants FROM (SELECT p_type AS site, p_name AS name, count(*) AS n, count(*) OVER (PARTITION BY p_type) AS variants, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_name) AS rn FROM part GROUP BY 1, 2) WHERE rn = 1")
def a16(spark, sf):
    return reads.mode_of(devices(spark, sf).select("site", "name"), "site", "name")


@register("A17_description_conflicts", f"SELECT location, count(DISTINCT name) AS n_values FROM {DEVICES} GROUP BY 1 HAVING count(DISTINCT name) > 1")
def a17(spark, sf):
    return reads.conflicts(devices(spark, sf), ["location"], "name").select("location", "n_values")


@register("A18_cluster_summary", f"SELECT name AS cluster, count(*) AS members, count(DISTINCT site) AS sites, count(*) FILTER (price > 1000) AS reviewed FROM {DEVICES} GROUP BY 1")
def a18(spark, sf):
    return devices(spark, sf).groupBy(F.col("name").alias("cluster")).agg(F.count("*").alias("members"), F.countDistinct("site").alias("sites"), F.count_if(F.col("price") > 1000).alias("reviewed"))


@register("A19_context_clusters", "SELECT skeleton, priority, sum(c)::BIGINT AS members, count(*) AS distinct_texts, string_agg(x, ' | ' ORDER BY x) FILTER (rn <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY skeleton, priority ORDER BY x) AS rn FROM (SELECT regexp_replace(c_name, '[0-9]+(\\.[0-9]+)?', '<NUM>', 'g') AS skeleton, c_mktsegment AS priority, c_name AS x, count(*) AS c FROM customer GROUP BY ALL)) GROUP BY 1, 2 HAVING sum(c) >= 2")
def a19(spark, sf):
    c = t(spark, sf, "customer").select(number_skeleton(F.col("c_name")).alias("skeleton"), F.col("c_mktsegment").alias("priority"), F.col("c_name").alias("x"))
    return reads.context_clusters(c, ["skeleton", "priority"], "x")


@register("A20_rule_counts", "SELECT w AS value, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1")
def a20(spark, sf):
    return reads.exploded_counts(t(spark, sf, "part").select(F.split("p_name", " ").alias("w")), "w")


@register("A21_coverage", "SELECT r.event_type, count(e.event_id) AS n, CASE WHEN count(e.event_id) = 0 THEN 'not_observed' ELSE 'observed' END AS status FROM (VALUES ('click'), ('view'), ('refund')) r(event_type) LEFT JOIN events e ON e.event_type = r.event_type GROUP BY 1")
def a21(spark, sf):
    seen = t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("c"))
    r = spark.createDataFrame([("click",), ("view",), ("refund",)], "event_type string").join(seen, "event_type", "left")
    return r.select("event_type", F.coalesce("c", F.lit(0)).alias("n"), F.when(F.col("c").isNull(), "not_observed").otherwise("observed").alias("status"))


@register("A22_site_stats", f"SELECT site, count(*) AS n, count(DISTINCT asset) AS assets, min(asset) AS first_asset, max(asset) AS last_asset FROM {DEVICES} GROUP BY 1")
def a22(spark, sf):
    return devices(spark, sf).groupBy("site").agg(F.count("*").alias("n"), F.countDistinct("asset").alias("assets"), F.min("asset").alias("first_asset"), F.max("asset").alias("last_asset"))


@register("A23_distinct_concat", "SELECT count(DISTINCT concat(l_returnflag, '|', l_linestatus)) AS n FROM lineitem")
def a23(spark, sf):
    return t(spark, sf, "lineitem").agg(F.countDistinct(F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("n"))


@register(
    "A23b_task_rollup",
    f"""SELECT device_id AS task, total, pending, published, CASE WHEN published = total THEN 'published' WHEN pending = 0 THEN 'approved' WHEN pending = total THEN 'pending' ELSE 'in_progress' END AS status
    FROM (SELECT device_id, count(*) AS total, count(*) FILTER (review_state = 'pending') AS pending, count(*) FILTER (published) AS published FROM {CANDIDATES} GROUP BY 1)""",
)
def a23b(spark, sf):
    x = candidates(spark, sf).groupBy(F.col("device_id").alias("task")).agg(F.count("*").alias("total"), F.count_if(F.col("review_state") == "pending").alias("pending"), F.count_if(F.col("published")).alias("published"))
    return x.withColumn("status", F.when(F.col("published") == F.col("total"), "published").when(F.col("pending") == 0, "approved").when(F.col("pending") == F.col("total"), "pending").otherwise("in_progress"))


@register("A23c_eligible_top_sites", f"SELECT device_id AS value, count(*) AS n FROM {CANDIDATES} WHERE confidence = 'high' AND evidence_level IN ('strong','source_preview_and_replay') AND status = 'candidate' AND review_state = 'pending' AND NOT published GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def a23c(spark, sf):
    return reads.facets(reads.eligible(candidates(spark, sf)), "device_id", 12)


@register("W1_latest_row", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w1(spark, sf):
    return reads.latest_by(t(spark, sf, "events"), ["user_id"], [F.col("ts").desc_nulls_last(), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@register("W2_best_event", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def w2(spark, sf):
    return reads.latest_by(t(spark, sf, "events"), ["user_id"], [reads.status_order("event_type", ["purchase"]), F.desc("ts"), F.col("event_id")]).select("user_id", "event_id")


@register("W3_representatives", f"SELECT asset, site FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY price DESC, asset) AS rn FROM {DEVICES}) ORDER BY (rn = 1) DESC, price DESC, asset LIMIT 15")
def w3(spark, sf):
    return sampling.representatives(devices(spark, sf), "site", [F.desc("price"), F.col("asset")], "asset", 15).select("asset", "site")


@register("W4_lag_chain", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts NULLS LAST, event_id) AS previous_id FROM events")
def w4(spark, sf):
    return reads.lag_chain(t(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "previous_id")


@register(
    "W5_trend",
    """SELECT user_id, n, first_value, last_value, round(last_value - first_value, 6) AS delta, CASE WHEN last_value > first_value THEN 'up' WHEN last_value < first_value THEN 'down' ELSE 'flat' END AS direction FROM
    (SELECT user_id, count(*) AS n, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2)""",
)
def w5(spark, sf):
    return reads.trend(t(spark, sf, "events").filter("event_type = 'error'"), ["user_id"], "ts", "value", "event_id").withColumn("delta", F.round("delta", 6))


@register(
    "W6_rolling_window",
    """SELECT user_id, min(ts) AS start FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 12 HOUR FOLLOWING) AS c FROM events WHERE event_type = 'error') WHERE c >= 2 GROUP BY 1""",
)
def w6(spark, sf):
    from semforge.operators.facts import repeated_starts

    return repeated_starts(t(spark, sf, "events").filter("event_type = 'error'"), ["user_id"], "ts", "12 hours").select("user_id", F.col("start").alias("start"))


@register("W7_share_of_total", "SELECT c_mktsegment AS segment, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM customer GROUP BY 1")
def w7(spark, sf):
    return reads.share_of_total(t(spark, sf, "customer").withColumnRenamed("c_mktsegment", "segment"), "segment")


@register("W8_late_arrival", "SELECT a.l_orderkey, a.l_linenumber, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_shipdate > a.l_shipdate AND b.l_partkey < a.l_partkey) AS late FROM lineitem a")
def w8(spark, sf):
    from semforge.operators.states import late_flags

    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("effective_at"), F.col("l_partkey").alias("recorded_at"))
    return late_flags(x, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "late")


@register("W9_round_robin", f"SELECT asset FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY name, asset) AS rn FROM {DEVICES}) ORDER BY rn, site LIMIT 50")
def w9(spark, sf):
    return sampling.round_robin(devices(spark, sf), ["site"], ["name", "asset"], 50).select("asset")


@register(
    "W10_proportional",
    f"""WITH s AS (SELECT site, count(*) AS size FROM {DEVICES} GROUP BY 1), q AS (SELECT site, size, least(size, greatest(1, CAST(round_even(60.0 * size / sum(size) OVER (), 0) AS BIGINT))) AS quota FROM s),
    r AS (SELECT asset, site, row_number() OVER (PARTITION BY site ORDER BY name, asset) - 1 AS rn FROM {DEVICES}),
    p AS (SELECT q.site, CAST(CASE WHEN quota = 1 THEN 0 ELSE round_even(i * (size - 1)::DOUBLE / (quota - 1), 0) END AS BIGINT) AS at FROM q, range(0, 100) g(i) WHERE i < quota)
    SELECT r.asset, r.site FROM r JOIN p ON r.site = p.site AND r.rn = p.at""",
)
def w10(spark, sf):
    return sampling.proportional(devices(spark, sf), "site", ["name", "asset"], 60).select("asset", "site")


@register("W11_group_quota", f"SELECT asset FROM (SELECT *, row_number() OVER (PARTITION BY source_schema ORDER BY rnd, site, asset) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY source_schema, site ORDER BY asset) AS rnd FROM {DEVICES})) WHERE rn <= 4")
def w11(spark, sf):
    return sampling.group_quota(devices(spark, sf), "source_schema", "site", ["asset"], 4).select("asset")


@register("W12_quotas", f"SELECT asset FROM (SELECT *, row_number() OVER (PARTITION BY source_schema, site ORDER BY price, asset) AS rn FROM {DEVICES}) d JOIN (VALUES ('Brand#4', 'ECONOMY', 3), ('Brand#7', 'SMALL', 5)) q(source_schema, site, quota) USING (source_schema, site) WHERE rn <= quota")
def w12(spark, sf):
    q = spark.createDataFrame([("Brand#4", "ECONOMY", 3), ("Brand#7", "SMALL", 5)], "source_schema string, site string, quota int")
    return sampling.quotas(devices(spark, sf), ["source_schema", "site"], ["price", "asset"], q).select("asset")


@register("W13_hashed", f"SELECT asset FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sha256(concat(asset, '|', 's1')), asset) AS rn FROM {DEVICES}) WHERE rn <= 20")
def w13(spark, sf):
    return sampling.hashed(devices(spark, sf), ["site"], "asset", "s1", 20).select("asset")


@register("W14_context_groups", f"SELECT asset, context_group FROM (SELECT *, row_number() OVER (PARTITION BY context_group ORDER BY asset) AS rn FROM (SELECT *, CASE WHEN length(location) > 2 THEN 'with_context' ELSE 'without_context' END AS context_group FROM {DEVICES})) WHERE rn <= 25")
def w14(spark, sf):
    d = devices(spark, sf).withColumn("has", F.length("location") > 2)
    return sampling.context_groups(d, "has", ["asset"], 25).select("asset", "context_group")


@register("W15_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80")
def w15(spark, sf):
    return reads.page(t(spark, sf, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 40).select("o_orderkey", "o_totalprice")


@register("W16_top_k", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def w16(spark, sf):
    return reads.facets(t(spark, sf, "part"), "p_name", 5)


@register("W17_status_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 30")
def w17(spark, sf):
    return t(spark, sf, "orders").orderBy(reads.status_order("o_orderstatus", ["P", "O"]), F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey")


@register("W18_detail", "SELECT c_custkey, c_name, (SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) FROM (SELECT * FROM orders WHERE o_custkey = 8 ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)) AS orders FROM customer WHERE c_custkey = 8")
def w18(spark, sf):
    o = t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = reads.detail(t(spark, sf, "customer"), "c_custkey", 8, {"orders": (o, [F.desc("o_orderdate"), F.col("o_orderkey")], 5)})
    return out.select("c_custkey", "c_name", F.concat_ws(",", F.transform("orders", lambda x: x["o_orderkey"].cast("string"))).alias("orders"))
