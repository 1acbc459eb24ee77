"""The driver's tables in the roles of the domain's: SURVEY 7.3. SQL fragments of the same name serve the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as devices: schema, site, asset number, name, location."""
    return t(spark, sf_dir, "part").select(F.col("p_brand").alias("source_schema"), F.col("p_type").alias("site"), F.col("p_partkey").cast("string").alias("asset"), F.col("p_name").alias("name"), F.concat(F.lit("L"), F.col("p_size")).alias("location"), F.col("p_retailprice").alias("price"))


DEVICES = "(SELECT p_brand AS source_schema, p_type AS site, CAST(p_partkey AS VARCHAR) AS asset, p_name AS name, concat('L', p_size) AS location, p_retailprice AS price FROM part)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as description candidates with states, confidence and reason codes."""
    o = t(spark, sf_dir, "orders")
    codes = F.array_compact(F.array(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("CONTEXT_MISSING")), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("LOW_OVERLAP")), F.when(F.col("o_totalprice") > 400000, F.lit("IDENTITY_CONFLICT")), F.when(F.col("o_orderstatus") == "P", F.lit("DEFERRED"))))
    return o.select(
        F.col("o_orderkey").alias("candidate_id"),
        F.col("o_custkey").alias("device_id"),
        F.when(F.col("o_totalprice") > 100000, "high").otherwise("low").alias("confidence"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "strong").when(F.col("o_orderpriority") == "3-MEDIUM", "source_preview_and_replay").otherwise("weak").alias("evidence_level"),
        F.when(F.col("o_orderstatus") == "F", "published").otherwise("candidate").alias("status"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("reviewed").alias("review_state"),
        (F.col("o_orderstatus") == "F").alias("published"),
        F.col("o_orderpriority").alias("proposed"),
        F.concat(F.lit(" "), F.col("o_orderpriority")).alias("original"),
        codes.alias("reason_codes"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("amount"),
    )


CANDIDATES = """(SELECT o_orderkey AS candidate_id, o_custkey AS device_id, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'strong' WHEN o_orderpriority = '3-MEDIUM' THEN 'source_preview_and_replay' ELSE 'weak' END AS evidence_level,
  CASE WHEN o_orderstatus = 'F' THEN 'published' ELSE 'candidate' END AS status, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'reviewed' END AS review_state,
  o_orderstatus = 'F' AS published, o_orderpriority AS proposed, concat(' ', o_orderpriority) AS original,
  list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'CONTEXT_MISSING' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW_OVERLAP' END,
    CASE WHEN o_totalprice > 400000 THEN 'IDENTITY_CONFLICT' END, CASE WHEN o_orderstatus = 'P' THEN 'DEFERRED' END], lambda x: x IS NOT NULL) AS reason_codes,
  o_orderdate AS created_at, o_totalprice AS amount FROM orders)"""
