"""Upserts of micro-batches into a table: the newest row of each key stays, and a batch that comes again changes nothing.

The table lies in partitions by the hash of its key, of which a batch rewrites only those that it touches. A ledger beside it has one row
for each batch that is done. Writing is in two steps, the new partitions first beside the table and then in their place, so that a run
that breaks off is repeated whole with the same outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from semforge.storage import cut_lineage

PARTS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows").drop("_part")


def done(spark: SparkSession, folder: str) -> set[int]:
    """Batches of the ledger."""
    return {r["batch"] for r in spark.read.parquet(f"{folder}/ledger").collect()} if _exists(spark, f"{folder}/ledger") else set()


def merge_batch(folder: str, keys: Sequence[str], newest: Sequence[str], parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A function of a batch and its number for ``foreachBatch``. The row with the greatest ``newest`` columns stays; ties go to the one
    whose other columns are greatest, so the order of arrival never matters. Null keys are a key.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in done(spark, folder):
            return
        rest = [c for c in batch.columns if c not in (*keys, *newest)]
        order = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in (*newest, *rest)])
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r["_part"] for r in rows.select("_part").distinct().collect()]
        if touched:
            if _exists(spark, f"{folder}/rows"):
                rows = rows.unionByName(spark.read.parquet(f"{folder}/rows").filter(F.col("_part").isin(touched)))
            kept = cut_lineage(rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank"), "upsert")
            kept.repartition(len(touched), "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(f"{folder}/rows")
        spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{folder}/ledger")

    return merge


def upsert_files(spark: SparkSession, source: str, schema: str, folder: str, keys: Sequence[str], newest: Sequence[str], checkpoint: str, files: int = 1) -> StreamingQuery:
    """Merges the Parquet files of a folder, so many at a time, until all that are there have been taken."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(merge_batch(folder, keys, newest)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
