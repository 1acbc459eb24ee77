"""What is read and what is kept: trees of digests, upserts of micro-batches, sketches, and rules as SQL."""

import random

import pytest
from pyspark.sql import functions as F

from semforge.operators import merkle, profile, rules
from semforge.operators.versions import diff
from semforge.storage import new_folder
from semforge.streaming import upsert

ROW = "k long, g string, v string"


@pytest.mark.parametrize("seed", [1, 2])
def test_published_diff(spark, seed):
    """Rows are those of a comparison of everything; only leaves that differ are read; equal snapshots read none."""
    rng = random.Random(seed)
    old = [(k, rng.choice(["a", "b", None]), rng.choice(["x", "", None])) for k in range(3000)] + [(None, "a", "n")]
    new = [(k, g, "new" if k is not None and k % 500 == 1 else v) for k, g, v in old if k is None or k % 700] + [(9000, "c", None)]
    a, b = (spark.createDataFrame(rng.sample(x, len(x)), ROW) for x in (old, new))
    at, to, same = (merkle.publish(df, ["k"], new_folder(spark, "merkle")) for df in (a, b, a.orderBy("v")))
    want = sorted(map(str, diff(a, b, ["k"]).collect()))
    found = merkle.diff_published(spark, at, to, ["k"])
    assert sorted(map(str, found.collect())) == want and len(want) > 10
    leaves = merkle.differing_leaves(spark, at, to)
    assert 0 < len(leaves) <= len(want) and merkle.differing_leaves(spark, at, same) == [] and merkle.diff_published(spark, at, same, ["k"]).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [_shelf" in plan and "PushedFilters: [In(_leaf" in plan
    empty = merkle.publish(a.limit(0), ["k"], new_folder(spark, "merkle")) if seed == 1 else None
    if empty:
        assert merkle.differing_leaves(spark, at, empty) and {r.change for r in merkle.diff_published(spark, at, empty, ["k"]).collect()} == {"removed"}


def test_upsert_batches(spark):
    """Any order of batches gives the newest row of each key; a batch that comes again changes and writes nothing."""
    folder = new_folder(spark, "upsert")
    merge = upsert.merge_batch(folder, ["k"], ["n"], parts=4)
    schema = "k string, n long, v string"
    batches = [[("a", 1, "x"), ("b", 5, "y"), (None, 1, "z")], [("a", 3, "w"), ("b", 4, "late")], [("c", 1, "q"), ("a", 3, "tie"), (None, 2, "zz")], []]
    for n, rows in enumerate(batches):
        merge(spark.createDataFrame(rows, schema), n)
    want = {("a", 3, "w"), ("b", 5, "y"), ("c", 1, "q"), (None, 2, "zz")}
    assert {tuple(r) for r in upsert.read_table(spark, folder).collect()} == want and upsert.done(spark, folder) == {0, 1, 2, 3}
    files = sorted(upsert.read_table(spark, folder).inputFiles())
    merge(spark.createDataFrame([("a", 99, "again")], schema), 1)
    assert sorted(upsert.read_table(spark, folder).inputFiles()) == files
    merge(spark.createDataFrame([("c", 9, "newer")], schema), 4)
    now = sorted(upsert.read_table(spark, folder).inputFiles())
    assert {tuple(r) for r in upsert.read_table(spark, folder).collect()} == want - {("c", 1, "q")} | {("c", 9, "newer")} and set(files) & set(now)


def test_upsert_stream_resumes(spark):
    source, folder, mark = (new_folder(spark, x) for x in ("in", "upsert", "mark"))
    schema = "k long, n long"
    spark.range(100).selectExpr("id % 10 AS k", "id AS n").repartition(3).write.parquet(source)
    upsert.upsert_files(spark, source, schema, folder, ["k"], ["n"], mark).awaitTermination()
    assert {tuple(r) for r in upsert.read_table(spark, folder).collect()} == {(k, 90 + k) for k in range(10)}
    first = upsert.done(spark, folder)
    spark.range(5).selectExpr("id AS k", "1000 + id AS n").coalesce(1).write.mode("append").parquet(source)
    upsert.upsert_files(spark, source, schema, folder, ["k"], ["n"], mark).awaitTermination()
    assert {tuple(r) for r in upsert.read_table(spark, folder).collect()} == {(k, 1000 + k if k < 5 else 90 + k) for k in range(10)} and upsert.done(spark, folder) > first


def test_sketches_add_up(spark):
    """Merged sketches of batches are within their bounds of the exact figures of all rows."""
    df = spark.range(60_000).selectExpr("id % 7 AS b", "IF(id % 11 = 0, NULL, concat('t', id % 9000)) AS t", "IF(id % 13 = 0, NULL, (id * 7919) % 60000) AS n")
    kept, path = profile.sketch(df, "b", ["t"], ["n"]), new_folder(spark, "sketches")
    kept.write.parquet(path)
    stored = spark.read.parquet(path)
    one = profile.estimates(profile.merged(stored, ["t"], ["n"]), ["t"], ["n"], [0.1, 0.5, 0.9]).first()
    exact = df.agg(F.countDistinct("t").alias("d"), F.count_if(F.col("t").isNull()).alias("nulls")).first()
    assert one["rows"] == 60_000 and one.t_nulls == exact.nulls and (one.n_least, one.n_greatest) == (df.agg(F.min("n")).first()[0], df.agg(F.max("n")).first()[0])
    assert abs(one.t_distinct - exact.d) <= profile.DISTINCT_ERROR * exact.d
    values = sorted(r.n for r in df.filter("n IS NOT NULL").collect())
    for rank, value in zip((0.1, 0.5, 0.9), one.n_quantiles):
        below = sum(v < value for v in values) / len(values)
        assert abs(below - rank) <= profile.RANK_ERROR + 1e-3
    assert profile.estimates(stored, ["t"], ["n"]).count() == 7


def test_rules_in_sql_need_no_python(spark):
    name = rules.register_sql(spark, [rules.Rule("it's", "replace", {"prefix": "a\\b'", "suffix": "z"}, {"from": "'\\", "to": "x"}), rules.Rule("trim", "trim")], "quoted_rules")
    df = spark.createDataFrame([("a\\b'\\z",), ("a\\b'z",), (" x",), (None,)], "t string")
    out = df.selectExpr("t", f"{name}(t, 'it\\'s') AS a", f"{name}(t, 'trim') AS b")
    assert [(r.a, r.b) for r in out.collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
