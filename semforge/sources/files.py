"""Scans and sinks: partitioned reads, column subsets, CSV as text, manifests that gate a read, digests of snapshots, safe writes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(RuntimeError):
    """A source that isn't what its manifest says, or that must not be written to."""


def read_jdbc(spark: SparkSession, url: str, table: str, sites: Iterable[str], column: str = "SITEID", properties: Mapping[str, str] | None = None) -> DataFrame:
    """One partition for each site: the predicate goes to the database, which alone sees other rows."""
    predicates = [f"{column} = '{s.replace(chr(39), chr(39) * 2)}'" for s in sites]
    return spark.read.jdbc(url, table, predicates=predicates, properties=dict(properties or {}))


def read_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that there are, whatever their case; others come as null, so that the schema is always the same."""
    have = {c.upper(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[w.upper()]}`") if w.upper() in have else F.lit(None).cast("string")).alias(w) for w in wanted])


def key_inventory(columns: Sequence[tuple[str, str]], spark: SparkSession) -> DataFrame:
    """(table, column) names to what they seem to identify."""
    name = F.upper("column")
    kind = F.when(name.rlike("ASSET(NUM|ID)|EQUIPMENT_?ID"), "identity").when(name.rlike("LOCATION|KKS"), "location").when(name.rlike("SITE|ORG"), "scope").when(name.rlike("DESC|NAME|TITLE"), "description").when(name.rlike("DATE|TIME"), "time").otherwise("other")
    return spark.createDataFrame(list(columns), "table string, column string").withColumn("kind", kind)


def read_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A CSV with a header, all columns text, a byte order mark dropped; a broken row fails the read where ``strict``."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_named_csvs(spark: SparkSession, path: str) -> DataFrame:
    """Files named schema__group__table.csv, with these three as columns, the row's number in its file, and names in upper case.

    A file that may span lines within quotes is read by one task, so its rows are numbered in its order.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿").upper()) for c in raw.columns], F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"), F.monotonically_increasing_id().alias("_id"))
    parts = F.split(F.regexp_replace("_file", r"\.csv$", ""), "__")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("_file").orderBy("_id"))
    return df.withColumns({"SOURCE_SCHEMA": F.get(parts, 0), "SOURCE_GROUP": F.get(parts, 1), "SOURCE_TABLE": F.get(parts, 2), "ROW_NUMBER": number}).drop("_file", "_id")


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; with a byte order mark before the first column's name, for spreadsheets."""
    out = df.toDF(*["﻿" + df.columns[0], *df.columns[1:]]) if bom and df.columns else df
    out.write.option("header", True).mode("overwrite").csv(path)


def verify_manifest(path: str, manifest: str) -> dict:
    """The manifest of a frozen file, only if the file's SHA-256 is the one that it names."""
    said = json.loads(Path(manifest).read_text(encoding="utf-8-sig"))
    if _file_digest(path) != said.get("sha256"):
        raise SourceError(f"{path} isn't the frozen file of {manifest}")
    return said


def _file_digest(path: str) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        for piece in iter(lambda: f.read(1 << 20), b""):
            digest.update(piece)
    return digest.hexdigest()


def write_manifest(path: str, rows: int, **more: object) -> dict:
    said = {"file": Path(path).name, "sha256": _file_digest(path), "rows": rows, "source_write": False} | more
    Path(f"{path}.manifest.json").write_text(json.dumps(said, sort_keys=True, indent=2), encoding="utf-8")
    return said


def row_digest(columns: Sequence[str]) -> Column:
    """The hash of a row as a JSON object: names count, nulls are not empty texts, and no value can run into the next."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def snapshot(df: DataFrame, site: str, key: str) -> DataFrame:
    """(site, rows, digest, duplicates, invalid) of each site. The digest adds up row digests, so it needs no order and no single task."""
    h = row_digest(sorted(df.columns))
    # 15 hex digits at a time fit into a long; four sums stand for a digest.
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    counted = df.groupBy(site).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *sums), 256).alias("digest"), F.count_if(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "").alias("invalid"))
    twice = df.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").groupBy(site, key).agg(F.count("*").alias("n")).filter("n > 1").groupBy(F.col(site).alias("_site")).agg(F.count("*").alias("duplicates"))
    return counted.join(twice, F.col(site).eqNullSafe(F.col("_site")), "left").select(site, "rows", "digest", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "invalid")


def checkpointed_extract(spark: SparkSession, tables: Mapping[str, object], target: str) -> list[str]:
    """Writes each table (name to a function that gives its DataFrame) unless its last write was whole; returns the names written now."""
    done = []
    for name, read in sorted(tables.items()):
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            read().write.mode("overwrite").parquet(f"{target}/{name}")
            done.append(name)
    return done


def guard_write(target: str, *sources: str) -> str:
    """The target, unless it lies in a source: inputs are never written to."""
    at = Path(target).resolve()
    for s in sources:
        if at == Path(s).resolve() or Path(s).resolve() in at.parents:
            raise SourceError(f"{target} is within the source {s}")
    return target
