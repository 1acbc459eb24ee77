"""Work that must not be one task's: common keys, small files that hold many rows, statements that compress well."""

import random

from pyspark.sql import functions as F

from semforge.functions.iri import EX, TYPE
from semforge.operators import gates, identity
from semforge.rdf import project, shapes
from semforge.rdf.turtle import QUAD


def statements_of(spark, n):
    """n typed and named nodes, read by one task."""
    k = spark.range(n, numPartitions=1).withColumn("k", F.col("id") % 50)
    return project.objects(k, "g", F.concat(F.lit(f"{EX}node/"), "k"), "Node", {"displayName": "k"})


def tasks_of(df):
    return len({r[0] for r in df.select(F.spark_partition_id()).collect()})


def test_common_key_is_compared_by_many_tasks(spark):
    """All pairs of a key, with copies and nulls, are those of a nested loop, and several tasks make them."""
    rng = random.Random(1)
    rows = [(rng.choice("ABC"), "S", "1", f"d{k}") for k in range(90)] + [("A", "T", "2", "x"), ("B", "T", "2", None), ("B", "T", "2", None), (None, "T", "2", "y"), ("A", None, "1", "z")]
    d = spark.createDataFrame(rows, "source_schema string, site string, asset string, device_id string").coalesce(1)
    want = sorted((a[0], b[0], a[1], a[2], a[3], str(b[3])) for a in rows for b in rows if a[0] and b[0] and a[0] < b[0] and a[1] and a[1:3] == b[1:3])
    got = identity.cross_system(d, block=20).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.left_schema, r.right_schema, r.site, r.asset, r.left_id, str(r.right_id)) for r in got) == want and len(want) > 2000
    assert len({r.task for r in got if r.site == "S"}) > 1
    assert identity.cross_system(d, left="A", right="C", block=20).count() == sum(x[:2] == ("A", "C") for x in want)


def rows_joined(df):
    """How many rows the last join of a plan gave when it ran."""
    df._jdf.queryExecution().toRdd().count()
    node = df._jdf.queryExecution().executedPlan()
    while "Join" not in node.nodeName():
        kind = node.getClass().getSimpleName()
        node = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else node.children().head()
    return node.metrics().get("numOutputRows").get().value()


def test_pairs_are_not_joined_one_by_one(spark):
    """A device meets a schema's ids at once; pairs come from there, and those whose schemas are out of order are never made."""
    d = spark.range(120).selectExpr("substr('ABC', int(id % 3) + 1, 1) AS source_schema", "'S' AS site", "'1' AS asset", "concat('d', id) AS device_id")
    pairs = identity.cross_system(d, block=60)
    assert pairs.count() == pairs.distinct().count() == 3 * 40 * 40
    assert rows_joined(pairs) <= 3 * 40 * 2


def test_copies_of_a_device_are_compared_by_many_tasks(spark):
    rows = [("A", "S", "1", "x")] * 95 + [("B", "S", "1", "y")] * 90 + [("B", "S", "1", None)] * 25
    pairs = identity.cross_system(spark.createDataFrame(rows, "source_schema string, site string, asset string, device_id string"), block=10)
    got = {(r.left_id, r.right_id): r["count"] for r in pairs.groupBy("left_id", "right_id").count().collect()}
    assert got == {("x", "y"): 95 * 90, ("x", None): 95 * 25} and tasks_of(pairs) > 1


def test_union_graph_is_told_apart_by_many_tasks(spark):
    q = statements_of(spark, 400)
    union = project.union_graph(q, q.withColumn("graph", F.lit("copy")))
    assert union.count() == 100 and tasks_of(union) > 1


def test_shapes_hold_no_statements_where_they_are_read(spark, monkeypatch):
    """Below the exchange by which statements are dealt nothing is aggregated."""
    plans, cut = [], shapes.cut_lineage

    def spy(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(shapes, "cut_lineage", spy)
    bad = spark.createDataFrame([("g", f"{EX}node/51", TYPE, "iri", f"{EX}Node", None, None)] * 2, QUAD)
    shape = shapes.Shape(f"{EX}S", f"{EX}Node", properties=[shapes.Property(f"{EX}displayName", min_count=1, max_count=1)])
    out = shapes.validate_shapes(statements_of(spark, 400).unionByName(bad), [shape]).collect()
    assert [(r.focus, r.code) for r in out] == [(f"{EX}node/51", "minCount")]
    lines = plans[0].splitlines()
    dealt = [k for k, x in enumerate(lines) if "REPARTITION_BY_NUM" in x]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    assert dealt
    for k in dealt:
        below = [x for j, x in enumerate(lines) if j > k and all(d > depth[k] for d in depth[k + 1 : j + 1])]
        assert below and not any("Aggregate" in x for x in below)


def test_reviews_are_judged_by_many_tasks(spark):
    row = "request_key long, candidate_id long, decision string, note string, description string"
    rows = [(k, k % 40, ("approve", "reject", "maybe")[k % 3], "n" if k % 2 else None, "d" if k % 5 else " ") for k in range(80)] + [(None, 1, "reject", "n", None), (90, None, "approve", "n", "d")]
    reviews = spark.createDataFrame(rows, row).coalesce(1)
    known = spark.range(39, numPartitions=1).selectExpr("id AS candidate_id", "IF(id % 7 = 0, 'done', 'pending') AS review_state", "IF(id % 4 = 0, 'fail', 'pass') AS validator_status")
    judged = gates.judged_reviews(reviews, known, spark.createDataFrame([(3,), (3,), (8,)], "request_key long"))
    got = {(r.request_key, r.candidate_id): r.reasons for r in judged.collect()}

    def reasons(key, candidate, decision, note, description):
        there, approve = candidate is not None and candidate < 39, decision == "approve"
        faults = ((key in (3, 8), "ALREADY_RECORDED"), (not there, "UNKNOWN_CANDIDATE"), (not there or candidate % 7 == 0, "NOT_PENDING"), (decision == "maybe", "UNKNOWN_DECISION"), (approve and (not there or candidate % 4 == 0), "VALIDATION_FAILED"), (not approve and note is None, "NOTE_MISSING"), (approve and (description or " ") == " ", "DESCRIPTION_MISSING"))
        return [name for fault, name in faults if fault]

    assert got == {x[:2]: reasons(*x) for x in rows} and tasks_of(judged) > 1
