"""Snapshots, contracts, versions, similar pairs and the SQL function against brute force and their edge cases."""

import pytest
from pyspark.sql import functions as F

from semforge.operators import contracts, reads, rules, states
from semforge.operators.versions import VersionError, Versions, diff
from semforge.sources import files, snapshots


def test_similar_pairs(spark):
    texts = ["abcdef", "abcdeg", "abcxyz", "zzzz", "zzz", "ab", "a", "", None, "bcdefa", "abcdef"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    sets = {x: {x[i : i + 2] for i in range(max(1, len(x) - 1))} for x in texts if x}
    for least in (0.2, 0.5, 0.8, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
        want = {k: pytest.approx(v) for k, v in want.items() if v >= least}
        assert {(r.a, r.b): r.score for r in reads.similar_pairs(df, "t", least).collect()} == want
    assert reads.similar_pairs(df.limit(0), "t", 0.5).count() == 0


def test_prefix_join(spark):
    events = spark.createDataFrame([("s", "L1"), ("s", ""), ("s", None), ("r", "L1"), ("s", "L12")], "site string, loc string")
    assets = spark.createDataFrame([("s", "L1", 1), ("s", "L12", 2), ("s", "L2", 3), ("s", None, 4), ("s", "", 5)], "site string, loc string, asset int")
    assert sorted((r.loc, r.asset) for r in reads.prefix_join(events, assets, ["site"], "loc").collect()) == [("L1", 1), ("L1", 2), ("L12", 2)]


def test_snapshot_and_context(spark, tmp_path):
    a = spark.createDataFrame([(1, " x "), (2, None), (3, "y")], "k int, Name string")
    broken = a.withColumn("k", F.raise_error(F.lit("no")).cast("int"))
    m = {r.table: r for r in snapshots.snapshot_tables({"a": a, "b": broken}, str(tmp_path)).collect()}
    assert (m["a"].status, m["a"].rows, m["b"].status) == ("captured", 3, "failed") and m["b"].message
    assert snapshots.verified_table(spark, str(tmp_path), "a").count() == 3
    with pytest.raises(files.SourceError):
        snapshots.verified_table(spark, str(tmp_path), "b")
    c = snapshots.Context(("K", "NAME", "NONE"), {"k": (1, 2)}, ("name",))
    assert [tuple(r) for r in snapshots.context_scan(a, c).collect()] == [("1", "x", "")]
    with pytest.raises(files.SourceError):
        snapshots.context_scan(a, snapshots.Context(("K",), {"zz": ("1",)}))


def test_versions(spark, tmp_path):
    v, none = Versions(spark, str(tmp_path)), spark.createDataFrame([], "failure string")
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string"), spark.createDataFrame([(1, "z"), (3, None)], "k int, t string")
    with pytest.raises(VersionError):
        v.activate("1", none)
    v.register("1", {"d": a})
    v.register("1", {"d": a})
    assert v.ledger.count() == 1 and v.active is None
    v.activate("1", none)
    with pytest.raises(VersionError):
        v.prepare_migration("2", "1")
    v.register("2", {"d": b}, "1")
    with pytest.raises(VersionError):
        v.migrate("1", "2", none)
    assert v.prepare_migration("1", "2") == v.prepare_migration("1", "2")
    with pytest.raises(VersionError):
        v.migrate("1", "2", spark.createDataFrame([("X",)], "failure string"))
    v.migrate("1", "2", none)
    assert v.active == "2" and v.snapshot(b) == v.snapshot(b) and v.rollback("1") == "2" and v.active == "1"
    assert {r.version: (r.status, r.parent) for r in v.state().collect()} == {"1": ("active", None), "2": ("available", "1")}
    assert {(r.k, r.change) for r in diff(a, b, ["k"]).collect()} == {(1, "changed"), (2, "removed"), (3, "added")}


def test_contracts_refuse_updates(spark):
    from semforge.rdf.turtle import QUAD

    q = spark.createDataFrame([("g", "a:b", "a:p", "literal", "7", None, None)], QUAD)
    got = {r.contract: (r.rows, r.status) for r in contracts.run_contracts(q, [contracts.Contract("drop", "DROP GRAPH <a:g>"), contracts.Contract("ask", "ASK { ?s <a:p> ?o }"), contracts.Contract("none", "ASK { ?s <a:q> ?o }"), contracts.Contract("count", "SELECT (COUNT(?s) AS ?n) WHERE { ?s <a:p> ?o }", 1, 2)]).collect()}
    assert got == {"drop": (0, "failed"), "ask": (1, "passed"), "none": (0, "failed"), "count": (1, "failed")}


def test_sql_function_is_the_rule(spark):
    some = [rules.Rule("kv", "replace", {"contains": "K"}, {"from": "KV", "to": "kV"}), rules.Rule("trim", "trim"), rules.Rule("space", "normalize", {}, {"mode": "whitespace"}), rules.Rule("nfkc", "normalize", {"prefix": "A"}, {"mode": "nfkc"}), rules.Rule("keep", "keep_original"), rules.Rule("all", "normalize", {"suffix": "x"}, {})]
    texts = ["10KV", "kv", " a ", "a  b", "AＢ", "Ａ", None, "", "Ⅲ  x", "A", "x"]
    df = spark.createDataFrame([(t, r.rule_id) for t in texts for r in some] + [("a", "none"), ("a", None)], "t string, r string")
    cases = df.filter("r = 'kv'")
    name = rules.register_sql(spark, some)
    df.createOrReplaceTempView("texts_and_rules")
    got = {(r.t, r.r): r.m for r in spark.sql(f"SELECT t, r, {name}(t, r) AS m FROM texts_and_rules").collect()}
    want = {}
    for r in some:
        x = rules.transform(F.col("t"), r)
        want |= {(row.t, r.rule_id): int(row.m) for row in cases.select("t", (x["matched"] & (x["text"] != F.coalesce("t", F.lit("")))).alias("m")).distinct().collect()}
    assert got == want | {("a", "none"): 0, ("a", None): 0}


def test_recompute_scope(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "subject_key string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "subject_key string, v int")
    assert {tuple(r) for r in states.recompute_scope(old, new, ["b"]).collect()} == {("a", 1), (None, 1), ("b", 2)}
    assert {tuple(r) for r in states.recompute_scope(old, new.limit(0), ["b"]).collect()} == {("a", 1), (None, 1)}


def test_indexed_search(spark):
    """The index finds what the scan finds, reads only the buckets of the term's trigrams, and short terms scan."""
    rows = [(1, "Large BOLT 50%", "x"), (2, None, "bolts_"), (3, "bol", "olt"), (3, "thunderbolt", None), (None, "Bolt", ""), (5, "ÄÖÜ pump", "50% b")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    index = reads.search_index(df, ["k"], ["a", "b"])
    for term in ("bolt", "BOLT", "lt", "", None, "50%", "s_", "äöü", "bolt 5", "absent"):
        found = reads.indexed_search(df, index, ["k"], term, ["a", "b"])
        assert sorted(map(str, found.collect())) == sorted(map(str, reads.search(df, term, ["a", "b"]).collect())), term
    plan = reads.indexed_search(df, index, ["k"], "bolt", ["a", "b"])._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: 2 out of 4" in plan or "SelectedBucketsCount: 1 out of 4" in plan


def test_row_digests_tell_rows_apart(spark):
    def digest(names, *values):
        return snapshots.digest_of(spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))).first()["digest"]

    different = [digest("xy", "a|b", "c"), digest("xy", "a", "b|c"), digest("xy", None, "c"), digest("xy", "", "c"), digest("xz", "a|b", "c"), digest("xy", "c", None), digest("xy", 'a","y":"b', "c")]
    assert len(set(different)) == len(different) and digest("xy", "a", None) == digest("xy", "a", None)
