"""Metadata catalogues of two schemas: rows with keys, comparison, findings, dictionary checks and reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semforge.functions.ids import stable_id
from semforge.functions.text import metadata_key
from semforge.operators.reads import facet_filter, page, search

#: What identifies a row of each kind of catalogue table.
KINDS = {
    "object": ("object_name",),
    "attribute": ("object_name", "attribute_name"),
    "table": ("table_name",),
    "relationship": ("parent", "child", "relationship_name"),
    "view": ("view_name",),
    "view_column": ("view_name", "column_name"),
    "index": ("index_name",),
    "index_column": ("index_name", "column_name"),
}


def catalog(kind: str, rows: DataFrame, schema: str) -> DataFrame:
    """One kind of catalogue rows with key, row id and mapping status; blank keys need review."""
    names = KINDS[kind]
    key = metadata_key(*[F.col(c) for c in names])
    out = rows.withColumns({"kind": F.lit(kind), "schema": F.lit(schema), "key": key})
    blank = reduce(Column.__or__, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in names])
    return out.withColumns({"row_id": stable_id("META", F.col("schema"), F.col("kind"), F.col("key")), "mapping_status": F.when(blank, "needs_review").otherwise("mapped")})


def compare_schemas(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, status, left_count, right_count, differences): full outer by key; fields compare by their sorted distinct values."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(F.col(key).alias(f"{p}_key")).agg(F.count("*").alias(f"{p}_count"), *[F.array_sort(F.collect_set(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias(f"{p}_{f}") for f in fields])

    both = side(left, "left").join(side(right, "right"), F.col("left_key").eqNullSafe(F.col("right_key")), "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"left_{f}").eqNullSafe(F.col(f"right_{f}")), F.lit(f)) for f in fields])) if fields else F.array().cast("array<string>")
    status = F.when(F.col("left_count").isNull(), "RIGHT_ONLY").when(F.col("right_count").isNull(), "LEFT_ONLY").when(F.size(differ) == 0, "same").otherwise("needs_review")
    one_side = F.col("left_count").isNull() | F.col("right_count").isNull()
    return both.select(F.coalesce("left_key", "right_key").alias("key"), status.alias("status"), F.coalesce("left_count", F.lit(0)).alias("left_count"), F.coalesce("right_count", F.lit(0)).alias("right_count"), F.when(one_side, F.array().cast("array<string>")).otherwise(differ).alias("differences"))


def findings(objects: DataFrame, attributes: DataFrame, relationships: DataFrame, tables: DataFrame) -> DataFrame:
    """(finding, key): duplicate objects, attributes of no object, relationships with a missing end, objects without a table."""
    known = objects.select(F.col("object_name").alias("_o")).distinct()
    duplicate = objects.groupBy("object_name").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("DUPLICATE_OBJECT").alias("finding"), F.col("object_name").alias("key"))
    unknown = attributes.join(known, F.col("object_name") == F.col("_o"), "left_anti").select(F.lit("UNKNOWN_OBJECT").alias("finding"), F.concat_ws(".", "object_name", "attribute_name").alias("key"))
    ends = relationships.select("relationship_name", F.explode(F.array("parent", "child")).alias("end"))
    missing = ends.join(known, F.col("end") == F.col("_o"), "left_anti").select(F.lit("MISSING_ENDPOINT").alias("finding"), F.col("relationship_name").alias("key")).distinct()
    loose = objects.join(tables.select(F.col("table_name").alias("_t")).distinct(), F.col("object_name") == F.col("_t"), "left_anti").select(F.lit("UNMATCHED_TABLE").alias("finding"), F.col("object_name").alias("key")).distinct()
    return reduce(DataFrame.unionByName, [duplicate, unknown, missing, loose])


def formal_only(dictionary: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, audit): entries with a verdict of FORMAL_READY stay; all others are audited."""
    joined = dictionary.join(verdicts.select("key", "verdict"), "key", "left")
    ok = F.col("verdict").eqNullSafe(F.lit("FORMAL_READY"))
    return joined.filter(ok), joined.filter(~ok).select("key", F.coalesce("verdict", F.lit("NO_VERDICT")).alias("reason"))


def validate_dictionary(entries: DataFrame, objects: DataFrame, indexes: DataFrame) -> DataFrame:
    """(finding, key) of entries (key, category, review_required, parent, table_name, kind, endpoint, index_name): nine kinds of fault."""

    def of(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("finding"), F.coalesce("key", F.lit("")).alias("key"))

    known = objects.select(F.col("object_name").alias("_o")).distinct()

    def loose(column: str, kinds: Sequence[str]) -> DataFrame:
        return entries.filter(F.col("kind").isin(*kinds) & F.col(column).isNotNull()).join(known, F.col(column) == F.col("_o"), "left_anti")

    parts = [
        of("EMPTY_KEY", entries.filter(F.coalesce(F.trim("key"), F.lit("")) == "")),
        of("NON_FORMAL_CATEGORY", entries.filter(~F.coalesce(F.col("category").isin("formal"), F.lit(False)))),
        of("REVIEW_REQUIRED", entries.filter("review_required")),
        of("DUPLICATE_KEY", entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")),
        of("UNMATCHED_TABLE", loose("table_name", ["table"])),
        of("MISSING_PARENT", loose("parent", ["attribute"])),
        of("MISSING_ENDPOINT", loose("endpoint", ["relationship"])),
        of("VIEW_COLUMN_WITHOUT_VIEW", loose("parent", ["view_column"])),
        of("INDEX_COLUMN_WITHOUT_INDEX", entries.filter("kind = 'index_column'").join(indexes.select("index_name").distinct(), "index_name", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, parts)


def read_dictionary(entries: DataFrame, filters: Mapping[str, object], term: str | None = None, number: int = 1, size: int = 50, searched: Sequence[str] = ("key", "name", "label", "description", "table_name", "category")) -> DataFrame:
    """A page of the dictionary in a total order."""
    found = search(facet_filter(entries, filters), term, [c for c in searched if c in entries.columns])
    return page(found, [F.col("kind"), F.col("key"), F.col("row_id")], number, size)


def related(entries: DataFrame, row_id: str, most: int = 50) -> DataFrame:
    """Other entries of the same name."""
    one = entries.filter(F.col("row_id") == row_id).select(F.upper("name").alias("_n"))
    return entries.filter(F.col("row_id") != row_id).join(one, F.upper("name") == F.col("_n"), "left_semi").orderBy("kind", "key", "row_id").limit(most)
