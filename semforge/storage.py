"""Tables that end a plan: written to the folder that driver and executors share, read back, and deleted when the driver ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only a local session may do without, and gets a temporary folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="semforge-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/semforge/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows of ``df`` without its plan; lost executors lose nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """In how many parts work is dealt: those that the session has for a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all tasks by keys, all columns unless named: what follows holds a task's share of them.

    Spark reads a small file in one task and joins small shuffles together, by their compressed bytes. Statements compress well, and what
    is sorted or hashed of them then has many times that size in one task.
    """
    return df.repartition(tasks(df.sparkSession), *(keys or df.columns))


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """The rows of ``df`` as a table in buckets of ``key``, sorted in each: joins and groups by it move only the other side."""
    spark = df.sparkSession
    number = buckets or tasks(spark)
    name = f"semforge_{uuid.uuid4().hex}"
    # Dealt by the buckets' own hash, so that each bucket is one file.
    df.repartition(number, key).write.bucketBy(number, key).sortBy(key).option("path", new_folder(spark, "buckets")).saveAsTable(name)
    return spark.table(name)
