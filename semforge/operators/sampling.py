"""Deterministic samples: each is a window, so strata are sampled side by side. None draws at random."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, strata: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))


def round_robin(df: DataFrame, strata: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first of every stratum, then the second of every stratum, and so on, up to n rows."""
    return _ranked(df, strata, order).orderBy("_rank", *strata).limit(n).drop("_rank")


def per_stratum(df: DataFrame, strata: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of every stratum."""
    return _ranked(df, strata, order).filter(F.col("_rank") <= n).drop("_rank")


def hashed(df: DataFrame, strata: Sequence[str], id_: str, salt: str, n: int) -> DataFrame:
    """n rows of every stratum by the SHA-256 of id and salt, then the id."""
    key = F.sha2(F.concat_ws("|", F.col(id_).cast("string"), F.lit(salt)), 256)
    return per_stratum(df, strata, [key, F.col(id_)], n)


def proportional(df: DataFrame, stratum: str, order: Sequence, n: int) -> DataFrame:
    """n rows shared among strata by size, at least one each, evenly spaced in the order within a stratum.

    Quotas are rounded half to even and bounded by the stratum's size; the counts stay on the executors.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_quota", F.least("_size", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.sum("_size").over(Window.partitionBy(F.lit(0)))).cast("long"))))
    ranked = _ranked(df, [stratum], order).join(sizes.withColumnRenamed(stratum, "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum")))
    last = F.col("_quota") - 1
    # Row r is taken if some i of 0 .. quota-1 rounds to it: the two nearest i are tried.
    guess = F.floor((F.col("_rank") - 1) * last / F.greatest(F.col("_size") - 1, F.lit(1)))
    hit = F.lit(False)
    for step in (-1, 0, 1):
        i = guess + step
        hit = hit | ((i >= 0) & (i <= last) & (F.bround(i * (F.col("_size") - 1) / F.greatest(last, F.lit(1))) == F.col("_rank") - 1))
    return ranked.filter(F.when(F.col("_quota") == 1, F.col("_rank") == 1).otherwise(hit)).drop("_rank", "_size", "_quota", "_stratum")


def group_quota(df: DataFrame, group: str, diverse: str, order: Sequence, n: int) -> DataFrame:
    """n rows of each group, from as many values of ``diverse`` as there are: the first of each, then the second of each."""
    ranked = df.withColumn("_round", F.row_number().over(Window.partitionBy(group, diverse).orderBy(*order)))
    return per_stratum(ranked, [group], [F.col("_round"), F.col(diverse), *order], n).drop("_round")


def quotas(df: DataFrame, keys: Sequence[str], order: Sequence, wanted: DataFrame) -> DataFrame:
    """As many rows of each combination of keys as ``wanted`` (keys, quota) says."""
    return _ranked(df, keys, order).join(wanted, list(keys)).filter(F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def representatives(df: DataFrame, site: str, order: Sequence, id_: str, n: int) -> DataFrame:
    """One row of each site, then filled up to n with the next in order over all sites."""
    ranked = _ranked(df, [site], order)
    return ranked.withColumn("_first", F.col("_rank") == 1).orderBy(F.desc("_first"), *order, F.col(id_)).limit(n).drop("_rank", "_first")


def context_groups(df: DataFrame, has_context: str, order: Sequence, n: int) -> DataFrame:
    """n rows each with and without context."""
    grouped = df.withColumn("context_group", F.when(F.col(has_context), "with_context").otherwise("without_context"))
    return per_stratum(grouped, ["context_group"], order, n)
