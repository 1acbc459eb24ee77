"""Comparison of two large snapshots by trees of digests: rows lie in leaves by the hash of their key, leaves have digests that add up to
those of their parents, and a comparison descends only where two digests differ. Leaves that agree are never read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semforge.operators.versions import diff
from semforge.sources.files import row_digest

#: Leaves of a tree, and children of a node: three levels of 16 below the root. So many leaves share a folder, whose files are sorted by leaf.
LEAVES, FAN, LEVELS, SHELF = 4096, 16, 3, 64


def _sums(h: Column) -> list[Column]:
    """15 hex digits at a time fit into a long; four sums stand for a digest, whatever the order of rows."""
    return [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]


def publish(df: DataFrame, keys: Sequence[str], folder: str) -> str:
    """Writes a snapshot below ``folder``: its rows by leaf, and its tree. Equal rows give equal trees, in whatever order they come."""
    leaf = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(LEAVES)).cast("int")
    placed = df.withColumn("_leaf", leaf).withColumn("_shelf", (F.col("_leaf") / SHELF).cast("int"))
    placed.repartitionByRange("_leaf").sortWithinPartitions("_leaf").write.mode("overwrite").partitionBy("_shelf").parquet(f"{folder}/rows")
    stored = _rows(df.sparkSession, folder, placed.schema)
    df.sparkSession.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/schema")
    level = stored.groupBy(F.col("_leaf").alias("node")).agg(F.count("*").alias("rows"), *_sums(row_digest(sorted(df.columns))))
    tree = []
    for depth in range(LEVELS, -1, -1):
        tree.append(level.select(F.lit(depth).alias("depth"), "node", "rows", *[f"s{k}" for k in range(4)]))
        level = level.groupBy((F.col("node") / FAN).cast("int").alias("node")).agg(F.sum("rows").alias("rows"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    # At most LEAVES rows and their parents: one file.
    reduce(DataFrame.unionByName, tree).coalesce(1).write.mode("overwrite").parquet(f"{folder}/tree")
    return folder


def _rows(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    if schema is None:
        # A snapshot without rows has no file that tells its columns; the schema beside it does.
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{folder}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def differing_leaves(spark: SparkSession, old: str, new: str) -> list[int]:
    """Leaves whose digests differ: level by level, only children of nodes that differ are looked at. At most LEAVES numbers."""
    a, b = (spark.read.parquet(f"{x}/tree") for x in (old, new))
    nodes = [0]
    for depth in range(LEVELS + 1):
        if depth:
            nodes = [n * FAN + k for n in nodes for k in range(FAN)]
        x, y = (t.filter((F.col("depth") == depth) & F.col("node").isin(nodes)).drop("depth") for t in (a, b))
        nodes = sorted(r["node"] for r in x.exceptAll(y).union(y.exceptAll(x)).select("node").distinct().collect())
        if not nodes:
            return []
    return nodes


def diff_published(spark: SparkSession, old: str, new: str, keys: Sequence[str]) -> DataFrame:
    """``versions.diff`` of two published snapshots of the same columns: (keys, change), reading only the leaves that differ."""
    leaves = differing_leaves(spark, old, new)
    shelves = sorted({n // SHELF for n in leaves})
    # Shelves choose the folders, leaves the row groups of their files.
    wanted = F.col("_shelf").isin(shelves) & F.col("_leaf").isin(leaves) if leaves else F.lit(False)
    a, b = (_rows(spark, x).filter(wanted).drop("_leaf", "_shelf") for x in (old, new))
    return diff(a, b, list(keys))
