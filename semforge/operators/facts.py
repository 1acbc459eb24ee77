"""Derived facts: measurements, statistics, trends, severe and repeated defects, risk. Observed and derived facts never mix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semforge.functions.ids import derived_snapshot, stable_id
from semforge.functions.text import normalize, parse_time, safe_float

#: Keys that hold a measured number, severities that count as severe, and spellings of the Celsius unit.
MEASURE_KEYS = ("temperature", "temperature_value", "temperatureValue", "value", "measured_value", "measuredValue", "reading")
SEVERE = ("high", "severe", "urgent", "critical")
CELSIUS = ("c", "℃", "°c", "degc")
REPEAT_WINDOW = "30 days"
HOT = 80.0
RULE_VERSION = "fact-builders-1"

FACT = "fact_id string, fact_type string, subject_key string, value string, input_fact_ids array<string>, source_snapshot_id string, rule_version string, observed_at timestamp"


def _json(col: Column, *keys: str) -> Column:
    """The first of the keys that a JSON text has; null for malformed text."""
    return F.coalesce(*[F.nullif(F.get_json_object(col, f"$.{k}"), F.lit("")) for k in keys])


def measurements(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, review) measurements of observation facts (fact_id, subject_key, value as JSON text, source_snapshot_id, observed_at).

    A fact has scalar keys, or a list ``measurements`` of objects. The payload overrides the event. A value that isn't a finite
    number, or has no unit, is for review: nothing is made up. Malformed JSON holds no measurement.
    """
    # One parse of the text: its own keys, and those of the objects within it that override them.
    keys = (*MEASURE_KEYS, "metric", "parameter", "unit", "temperature_unit", "temperatureUnit")
    fields = ",".join(f"{k}:string" for k in keys) + ",measurements:array<struct<metric:string,value:string,unit:string>>"
    whole = ",".join(f"{k} string" for k in keys) + f", measurements array<struct<metric:string,value:string,unit:string>>, payload struct<{fields}>, source_event struct<{fields}>"
    parsed = facts.withColumn("_j", F.from_json("value", whole, {"mode": "PERMISSIVE"}))

    def of(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"_j.{at}{k}"), F.lit("")) for k in names for at in ("payload.", "source_event.", "")])

    none = F.array().cast("array<struct<metric:string,value:string,unit:string>>")
    listed = F.coalesce("_j.payload.measurements", "_j.source_event.measurements", "_j.measurements", none)
    scalar = F.array(*[F.struct(F.when(F.lit("temperature" in k.lower()), F.lit("temperature")).otherwise(F.coalesce(of("metric", "parameter"), F.lit("value"))).alias("metric"), of(k).alias("value"), of("unit", "temperature_unit", "temperatureUnit").alias("unit")) for k in MEASURE_KEYS])
    found = F.concat(F.filter(scalar, lambda m: m["value"].isNotNull()), listed)
    rows = parsed.select("fact_id", "subject_key", "source_snapshot_id", "observed_at", F.posexplode(found).alias("position", "m"))
    rows = rows.select("fact_id", "subject_key", "source_snapshot_id", "observed_at", "position", F.coalesce("m.metric", F.lit("value")).alias("metric"), safe_float(F.col("m.value")).alias("number"), F.nullif(F.trim("m.unit"), F.lit("")).alias("unit"))
    good = F.col("number").isNotNull() & F.col("unit").isNotNull() & F.col("source_snapshot_id").isNotNull()
    accepted = rows.filter(good).withColumn("measurement_id", stable_id("MEA", F.col("fact_id"), F.col("position"), F.col("metric")))
    return accepted, rows.filter(~good).withColumn("reason", F.when(F.col("number").isNull(), "not_a_finite_number").when(F.col("unit").isNull(), "missing_unit").otherwise("missing_snapshot"))


def history(measured: DataFrame) -> DataFrame:
    """Count, extremes and mean of each subject, metric and unit, with the inputs' ids."""
    keys = ("subject_key", "metric", "unit")
    out = measured.groupBy(*keys).agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.avg("number").alias("mean"), F.array_sort(F.collect_set("measurement_id")).alias("input_fact_ids"), F.collect_set("source_snapshot_id").alias("_s"))
    return out.withColumns({"fact_id": stable_id("HIS", *map(F.col, keys)), "source_snapshot_id": derived_snapshot(F.col("_s"))}).drop("_s")


def trends(measured: DataFrame) -> DataFrame:
    """First, last, delta and direction of two timed points or more."""
    point = F.struct(F.col("observed_at").alias("t"), F.col("measurement_id").alias("i"), F.col("number").alias("v"))
    keys = ("subject_key", "metric", "unit")
    out = measured.filter("observed_at IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.min(point)["v"].alias("first_value"), F.max(point)["v"].alias("last_value"), F.array_sort(F.collect_set("measurement_id")).alias("input_fact_ids")).filter("n >= 2")
    delta = F.col("last_value") - F.col("first_value")
    return out.withColumns({"delta": delta, "direction": F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat"), "fact_id": stable_id("TRD", *map(F.col, keys))})


def severe(defects: DataFrame) -> DataFrame:
    """Defect facts of a severe kind, each its own derivation."""
    return defects.filter(F.lower(F.trim(_json(F.col("value"), "severity", "source_event.severity"))).isin(*SEVERE)).withColumn("severe_id", stable_id("SEV", F.col("fact_id")))


def repeated_starts(rows: DataFrame, keys: Sequence[str], time: str, window: str = REPEAT_WINDOW) -> DataFrame:
    """(keys, start, n): the earliest time from which the window ahead, its end included, holds two rows or more."""
    timed = rows.filter(F.col(time).isNotNull())
    order = Window.partitionBy(*keys).orderBy(F.col(time).cast("timestamp").cast("double"))
    seconds = {"days": 86400, "hours": 3600, "minutes": 60}[window.split()[1]] * int(window.split()[0])
    counted = timed.withColumn("n", F.count("*").over(order.rangeBetween(0, seconds)))
    first = F.min(F.struct(F.col(time).alias("start"), F.col("n")))
    return counted.filter("n >= 2").groupBy(*keys).agg(first.alias("f")).select(*keys, "f.start", "f.n")


def repeated(defects: DataFrame) -> DataFrame:
    """Defects of one subject and description within 30 days, from the first start that has two; with the ids of those inside."""
    rows = defects.withColumns({"text": normalize(_json(F.col("value"), "description", "source_event.description", "text"), "fact"), "at": F.coalesce(F.col("observed_at"), parse_time(_json(F.col("value"), "event_time")))}).filter("text <> ''")
    # One exchange by subject and description serves both windows and the aggregate after them.
    group = Window.partitionBy("subject_key", "text")
    ahead = F.count("*").over(group.orderBy(F.col("at").cast("timestamp").cast("double")).rangeBetween(0, 30 * 86400))
    starts = rows.filter("at IS NOT NULL").withColumn("n", ahead).withColumn("start", F.min(F.when(F.col("n") >= 2, F.col("at"))).over(group))
    inside = starts.filter((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("start") + F.expr("INTERVAL 30 DAYS")))
    out = inside.groupBy("subject_key", "text", "start").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("fact_id")).alias("input_fact_ids"), F.max("at").alias("observed_at"))
    return out.withColumn("fact_id", stable_id("REP", F.col("subject_key"), F.col("text"), F.concat_ws(",", "input_fact_ids")))


def risk(measured: DataFrame, severe_: DataFrame, repeated_: DataFrame) -> DataFrame:
    """(subject_key, risk_score, n_evidence, input_fact_ids): hot temperatures, severe and repeated defects of a subject.

    Score = min(5, max(4 with a temperature of 80 °C or more else 3, evidence + 2)).
    """
    hot = measured.filter((F.col("metric") == "temperature") & F.lower("unit").isin(*CELSIUS) & (F.col("number") >= HOT)).select("subject_key", F.col("measurement_id").alias("id"), F.lit(1).alias("hot"))
    evidence = reduce(DataFrame.unionByName, [hot, severe_.select("subject_key", F.col("severe_id").alias("id"), F.lit(0).alias("hot")), repeated_.select("subject_key", F.col("fact_id").alias("id"), F.lit(0).alias("hot"))])
    out = evidence.groupBy("subject_key").agg(F.countDistinct("id").alias("n_evidence"), F.max("hot").alias("hot"), F.array_sort(F.collect_set("id")).alias("input_fact_ids"))
    score = F.least(F.lit(5), F.greatest(F.when(F.col("hot") == 1, 4).otherwise(3), F.col("n_evidence") + 2))
    return out.withColumns({"risk_score": score.cast("long"), "fact_id": stable_id("RSK", F.col("subject_key"))}).drop("hot")


def build(facts: DataFrame) -> dict[str, DataFrame]:
    """All builders over observed facts (fact_id, fact_type, subject_key, value, source_snapshot_id, observed_at)."""
    timed = facts.withColumn("observed_at", F.coalesce(F.col("observed_at"), parse_time(_json(F.col("value"), "event_time", "source_event.event_time"))))
    accepted, review = measurements(timed.filter("fact_type = 'observation_event'"))
    defects = timed.filter("fact_type = 'defect_event' AND source_snapshot_id IS NOT NULL")
    s, r = severe(defects), repeated(defects)
    return {"measurement": accepted, "review": review, "history_stat": history(accepted), "trend": trends(accepted), "severe_defect": s, "repeated_defect": r, "risk_assessment": risk(accepted, s, r)}
