"""Shares of a total."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from semforge.registry import register


@register(
    "A6_segment_share",
    """
    SELECT c_mktsegment AS segment, count(*) AS n,
           CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS DOUBLE) AS share
    FROM customer GROUP BY c_mktsegment
    """,
)
def segment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each market segment and their share of all; the window runs over the few segment rows."""
    counts = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))
