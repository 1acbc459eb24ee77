import pytest

from semforge.operators import metadata, reads, sampling, validation
from semforge.pipeline import PipelineError, ordered, run_dag
from semforge.sources import files
from semforge.streaming import replay


def test_dag(tmp_path):
    calls = []

    def step(parameters, inputs):
        calls.append(parameters["n"])
        return {"n": parameters["n"] + sum(x["n"] for x in inputs.values()), "run_id": len(calls)}

    spec = {"steps": [{"id": "c", "handler": "h", "depends_on": ["a", "b"], "parameters": {"n": 3}}, {"id": "b", "handler": "h", "parameters": {"n": 2}}, {"id": "a", "handler": "h", "parameters": {"n": 1}}]}
    path = str(tmp_path / "m.json")
    first = run_dag(spec, {"h": step}, path)
    assert first["steps"]["c"]["result"]["n"] == 6 and calls == [1, 2, 3]
    assert all(s["resumed"] for s in run_dag(spec, {"h": step}, path)["steps"].values()) and len(calls) == 3
    with pytest.raises(PipelineError):
        ordered([{"id": "a", "depends_on": ["b"]}, {"id": "b", "depends_on": ["a"]}])
    with pytest.raises(PipelineError):
        run_dag({"steps": [{"id": "x", "handler": "w"}]}, {"w": lambda p, i: {"source_write": True}})


def test_csv_and_manifest(spark, tmp_path):
    f = tmp_path / "s__g__t.csv"
    f.write_text("﻿Id,Name\n1,a\n2,\n", encoding="utf-8")
    df = files.read_csv(spark, str(f))
    assert df.columns == ["Id", "Name"] and [tuple(r) for r in df.collect()] == [("1", "a"), ("2", None)]
    named = files.read_named_csvs(spark, str(tmp_path / "*.csv")).orderBy("ROW_NUMBER").collect()
    assert [(r.SOURCE_SCHEMA, r.SOURCE_GROUP, r.SOURCE_TABLE, r.ROW_NUMBER, r.ID) for r in named] == [("s", "g", "t", 1, "1"), ("s", "g", "t", 2, "2")]
    files.write_manifest(str(f), 2)
    assert files.verify_manifest(str(f), f"{f}.manifest.json")["rows"] == 2
    f.write_text("changed")
    with pytest.raises(files.SourceError):
        files.verify_manifest(str(f), f"{f}.manifest.json")
    with pytest.raises(files.SourceError):
        files.guard_write(str(tmp_path / "out"), str(tmp_path))


def test_column_subset_and_snapshot(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None)], "site string, k string")
    assert files.read_columns(df, ["SITE", "missing"]).columns == ["SITE", "missing"]
    got = {r.site: (r.rows, r.duplicates, r.invalid) for r in files.snapshot(df, "site", "k").collect()}
    assert got == {"a": (2, 1, 0), "b": (1, 0, 1)}
    again = files.snapshot(df.repartition(3), "site", "k").collect()
    assert {r.site: r.digest for r in again} == {r.site: r.digest for r in files.snapshot(df, "site", "k").collect()}


def test_extract_resumes(spark, tmp_path):
    tables = {"a": lambda: spark.range(2), "b": lambda: spark.range(3)}
    assert files.checkpointed_extract(spark, tables, str(tmp_path)) == ["a", "b"] and files.checkpointed_extract(spark, tables, str(tmp_path)) == []


def test_search_is_literal(spark):
    df = spark.createDataFrame([("50%_x",), ("50 x",), (None,)], "c string")
    assert [r.c for r in reads.search(df, "%_X", ["c"]).collect()] == ["50%_x"] and reads.search(df, None, ["c"]).count() == 3


def test_merge_with_null_keys(spark):
    old = spark.createDataFrame([(None, "o"), (1, "o"), (2, "o")], "k int, v string")
    new = spark.createDataFrame([(None, "n"), (2, "n"), (3, "n")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in reads.merge(old, new, ["k"]).collect()) == [(0, "n"), (1, "o"), (2, "n"), (3, "n")]
    assert sorted((r.k or 0, r.v) for r in reads.merge(old, new, ["k"], ignore=True).collect()) == [(0, "o"), (1, "o"), (2, "o"), (3, "n")]


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 20 else "z") for i in range(21)], "i int, s string")
    assert [r.s for r in sampling.round_robin(df, ["s"], ["i"], 5).collect()] == ["a", "b", "c", "z", "a"]
    assert sampling.round_robin(df, ["s"], ["i"], 100).count() == 21
    p = sampling.proportional(df, "s", ["i"], 10).collect()
    assert {r.s for r in p} == set("abcz") and 9 <= len(p) <= 11
    with pytest.raises(ValueError):
        reads.page(df, ["i"], 0, 10)


def test_compare_and_registry(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "x"), ("l", "y"), (None, "n")], "key string, f string")
    b = spark.createDataFrame([("k", "x"), ("m", "y"), (None, "n")], "key string, f string")
    assert {r.key: (r.status, r.left_count) for r in metadata.compare_schemas(a, b, "key", ["f"]).collect()} == {"k": ("same", 2), "l": ("LEFT_ONLY", 1), "m": ("RIGHT_ONLY", 0), None: ("same", 1)}
    assert validation.registry_errors({"a": "b"}, ["c"], {"c": ("x", "y")}, ["x"], {"n": "http://n"}) == ["alias a has no target b", "relation c has unknown type y", "namespace n isn't an https address that ends in a slash"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 AS k, 1.0D AS value FROM range(0, 60, 10, 1)")
    e.write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = replay.windowed(stream, "ts", ["k"], "30 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.k, r.n) for r in spark.sql("SELECT k, n FROM w ORDER BY window.start").collect()] == [(0, 3), (0, 3)]
    batches = []
    q = replay.upsert_stream(stream, lambda df, n: batches.append((n, df.count())), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert batches == [(0, 6)]


def test_stream_replay(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "subject_key string, fact_id string, to_state string, event_type string, mapped boolean, effective_at timestamp, recorded_at timestamp, source_row_id string"
    rows = [("D", "1", "NEW", "DefectCreatedEvent", "2024-01-01"), ("D", "3", "PROCESSING", "DefectProcessingEvent", "2024-01-03"), ("D", "2", "PENDING", "DefectAcceptedEvent", "2024-01-02")]
    for k, r in enumerate(rows):
        spark.sql(f"SELECT '{r[0]}' subject_key, '{r[1]}' fact_id, '{r[2]}' to_state, '{r[3]}' event_type, false mapped, timestamp'{r[4]}' effective_at, timestamp'2024-02-0{k + 1}' recorded_at, '{r[1]}' source_row_id").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = replay.replay_stream(stream).writeStream.outputMode("update").format("memory").queryName("r").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("SELECT version, state, late FROM r").collect())
    assert got[-1] == (3, "PROCESSING", True)


def test_read_surface(spark):
    from semforge.operators import api

    d = spark.createDataFrame([("d1", "A", "ok", "1", "Pump", "L1"), ("d2", "A", "new", "2", "Fan", "L2"), ("d3", "B", "ok", "3", "pump x", None)], "device_id string, source_schema string, status string, asset string, name string, location string")
    e = spark.createDataFrame([("d1", "e1", "2024-01-01"), ("d1", "e2", None), ("d1", "e3", "2024-01-03")], "device_id string, event_id string, occurred_at string")
    tables = {"unified_device": d, "device_event": e}
    assert sorted((r.kind, r.status, r.n) for r in api.summary("unified-devices", tables).collect()) == [("A", "new", 1), ("A", "ok", 1), ("B", "ok", 1)]
    found = api.listing("unified-devices", tables, {"source_schema": "all"}, "PUMP").collect()
    assert sorted((r.device_id, r.n_events, r.source_write) for r in found) == [("d1", 3, False), ("d3", 0, False)]
    assert [x.event_id for x in api.detail("unified-devices", tables, "d1").first().events] == ["e3", "e1", "e2"]
    assert api.facets("unified-devices", tables).count() == 4 and all(callable(f) for f in api.COMMANDS.values())
