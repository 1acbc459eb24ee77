"""Snapshots of several tables at once: each written as it is, with a manifest that names its columns, rows and digest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semforge.sources.files import SourceError, read_columns, row_digest


def digest_of(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table. Row digests are added up, so neither order nor partitions matter."""
    h = row_digest(sorted(df.columns)) if df.columns else F.lit("")
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *sums), 256).alias("digest"))


def snapshot_tables(tables: Mapping[str, DataFrame], target: str) -> DataFrame:
    """Writes each table below ``target`` and returns its manifest: (table, status, columns, rows, digest, message), read back from there.

    A table that can't be read is a row with the reason; the others are written all the same.
    """
    rows, spark = [], None
    for name, df in sorted(tables.items()):
        spark = df.sparkSession
        try:
            df.write.mode("overwrite").parquet(f"{target}/{name}")
            found = digest_of(spark.read.parquet(f"{target}/{name}")).first()
            rows.append((name, "captured", df.columns, found["rows"], found["digest"], None))
        except (PySparkException, Py4JError) as e:
            rows.append((name, "failed", df.columns, None, None, f"{type(e).__name__}: {e}"[:500]))
    if spark is None:
        raise SourceError("a snapshot needs tables")
    spark.createDataFrame(rows, "table string, status string, columns array<string>, rows long, digest string, message string").write.mode("overwrite").parquet(f"{target}/_manifest")
    return spark.read.parquet(f"{target}/_manifest")


def verified_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of a snapshot, only if its rows still have the digest of the manifest."""
    said = spark.read.parquet(f"{target}/_manifest").filter(F.col("table") == name).first()
    if said is None or said["status"] != "captured":
        raise SourceError(f"{name} isn't in the snapshot")
    df = spark.read.parquet(f"{target}/{name}")
    if digest_of(df).first()["digest"] != said["digest"]:
        raise SourceError(f"{name} isn't what the manifest says")
    return df


@dataclass(frozen=True)
class Context:
    """What is read of a context table: its fields, the values that columns may have, and columns that mustn't be blank."""

    fields: Sequence[str]
    among: Mapping[str, Sequence[str]] = field(default_factory=dict)
    present: Sequence[str] = ()


def context_scan(df: DataFrame, context: Context) -> DataFrame:
    """The fields of the rows that the context asks for, as trimmed texts; null is empty. Filters and columns reach the scan."""
    have = {c.upper(): c for c in df.columns}
    rows = df
    for name, values in context.among.items():
        if name.upper() not in have:
            raise SourceError(f"no column {name}")
        rows = rows.filter(F.col(f"`{have[name.upper()]}`").isin(*values))
    for name in context.present:
        rows = rows.filter(F.trim(F.col(f"`{have[name.upper()]}`").cast("string")) != "")
    narrow = read_columns(rows, context.fields)
    return narrow.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in narrow.columns])


def context_tables(tables: Mapping[str, DataFrame], contexts: Mapping[str, Context]) -> DataFrame:
    """(table, row) of all context tables: each row as a map of its fields, in one read."""
    parts = []
    for name, context in sorted(contexts.items()):
        df = context_scan(tables[name], context)
        parts.append(df.select(F.lit(name).alias("table"), F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns)).alias("row")))
    return reduce(DataFrame.unionByName, parts)
