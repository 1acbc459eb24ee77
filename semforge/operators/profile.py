"""Profiles of batches that add up: sketches of distinct values and quantiles beside exact counters, stored for each batch and merged
without reading rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a HyperLogLog sketch, for a standard error of 1.04 / sqrt(2^12) = 1.6%; and the size of a KLL sketch, whose
#: ranks are within 1.65% of the rows with 99% certainty.
LG, K = 12, 200
DISTINCT_ERROR, RANK_ERROR = 3 * 0.0163, 0.0165


def sketch(df: DataFrame, batch: str, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """One row for each batch: rows, and by column nulls, least and greatest, a sketch of distinct texts or of quantiles. Sketches are
    built where rows are read; only they are shuffled.
    """
    out = [F.count("*").alias("rows")]
    for c in (*texts, *numbers):
        out += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_greatest")]
    out += [F.hll_sketch_agg(c, F.lit(LG)).alias(f"{c}_hll") for c in texts]
    out += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(K)).alias(f"{c}_kll") for c in numbers]
    return df.groupBy(F.col(batch).alias("batch")).agg(*out)


def merged(sketches: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """The profile of all batches together, as one row of the same columns but ``batch``."""
    out = [F.sum("rows").alias("rows")]
    for c in (*texts, *numbers):
        out += [F.sum(f"{c}_nulls").alias(f"{c}_nulls"), F.min(f"{c}_least").alias(f"{c}_least"), F.max(f"{c}_greatest").alias(f"{c}_greatest")]
    out += [F.hll_union_agg(f"{c}_hll").alias(f"{c}_hll") for c in texts]
    # Sketches of quantiles have no merging aggregate: one is merged into the next, batch by batch; there are few batches.
    for c in numbers:
        held = F.collect_list(f"{c}_kll")
        out.append(F.reduce(F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(1))), F.get(held, 0), F.kll_sketch_merge_double).alias(f"{c}_kll"))
    return sketches.agg(*out)


def estimates(sketches: DataFrame, texts: Sequence[str], numbers: Sequence[str], ranks: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """The counters with estimates instead of sketches: distinct texts, and the values at the given ranks as arrays."""
    counters = [c for c in sketches.columns if not c.endswith(("_hll", "_kll"))]
    distinct = [F.hll_sketch_estimate(f"{c}_hll").alias(f"{c}_distinct") for c in texts]
    quantiles = [F.array(*[F.kll_sketch_get_quantile_double(F.col(f"{c}_kll"), F.lit(float(r))) for r in ranks]).alias(f"{c}_quantiles") for c in numbers]
    return sketches.select(*counters, *distinct, *quantiles)
