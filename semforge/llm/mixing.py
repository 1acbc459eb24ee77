"""Mixing sources to target weights by hash-threshold histograms.

A source's target is a number of words, up to three times its size. The whole part of target / size is taken from every document;
the rest is a budget. Every document has a hash, and those below the source's threshold are taken once more. The threshold is found
without sorting: words are summed by source and hash bucket, the bucket in which the budget ends is found, and only that bucket is
divided again. Thresholds are nested: a larger budget takes the documents of a smaller one and more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semforge.llm.common import delete, materialize, partitions, unwrapped, wrapped

WEIGHTS = (1, 2, 3)
MOST = 3
#: Bits by which each pass divides the boundary bucket, and the bits of a document's hash.
BITS, HASH_BITS = 12, 60
WORDS = r"[^\x20\x09-\x0D]+"


def size_of() -> F.Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def hash_of() -> F.Column:
    """The hash that decides; equal rows have equal hashes."""
    return F.xxhash64(F.lit("mix"), F.col("doc_id"), F.xxhash64("text")).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def ranked(sources: DataFrame) -> tuple[DataFrame, str]:
    """Adds the rank of each source by code point, null last; and the table it reads. Ranges are dealt out, counted, and the counts added up: no global window."""
    width = partitions(sources)
    order = [F.col("source").isNull(), F.col("source")]
    placed, path = materialize(sources.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sources")
    part = F.shiftrightunsigned("_id", 33)
    before, at = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        before.append((int(r["p"]), at))
        at += r["n"]
    starts = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0))
    return placed.withColumn("rank", starts[part] + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), path


def targets(sources: DataFrame, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) to source, source_size and target.

    All words are shared by weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight,
    until none is above. The driver sees three sums a round, never the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    placed, path = ranked(sources)
    rows = placed.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    level, held = None, -1
    total = rows.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    while True:
        above = F.lit(False) if level is None else F.col("w") * level > F.col("cap")
        r = rows.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == held or not r["w"]:
            break
        held, level = r["n"], (total - r["cap"]) / r["w"]
    goal, _ = materialize(rows.select("source", "source_size", F.least(F.col("w") * (level or 0.0), F.col("cap")).alias("target")), "targets")
    delete(sources.sparkSession, path)
    return goal


def thresholds(words: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, h, size) and (source, copies, budget) to source, copies and the hash below which one copy more is taken."""
    low, shift, before = budgets.withColumns({"lo": F.lit(0).cast("long"), "left": F.col("budget")}), HASH_BITS, None
    while shift:
        bits = min(BITS, shift)
        shift -= bits
        bucket = F.shiftright(F.col("h") - F.col("lo"), shift)
        inside = (F.col("h") >= F.col("lo")) & (bucket < (1 << bits))
        narrow = low.filter("left > 0").select(F.col("source").alias("s"), "lo")
        # A few rows for each source; sources that are done drop out, and so do all documents outside the boundary bucket.
        sums = words.join(narrow, F.col("source").eqNullSafe(F.col("s"))).filter(inside).groupBy("s", bucket.alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        run = F.sum("n").over(Window.partitionBy("s").orderBy("b"))
        cut = sums.withColumn("upto", run).filter(F.col("n") > 0)
        joined = cut.join(low.select(F.col("source").alias("source_"), F.col("left").alias("left_")), F.col("s").eqNullSafe(F.col("source_")))
        edge = joined.groupBy("s").agg(F.min_by("b", F.when(F.col("upto") > F.col("left_"), F.col("b"))).alias("b"), F.max(F.when(F.col("upto") <= F.col("left_"), F.col("upto"))).alias("under"), F.min_by("n", F.when(F.col("upto") > F.col("left_"), F.col("b"))).alias("n"), F.min_by("rows", F.when(F.col("upto") > F.col("left_"), F.col("b"))).alias("rows"))
        step = low.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        rest = F.col("left") - F.coalesce(F.col("under"), F.lit(0))
        start = F.col("lo") + F.shiftleft(F.col("b"), shift)
        # With one document in the boundary bucket, the nearer side of it is taken and the source is done.
        single = (F.col("rows") == 1) | F.lit(shift == 0)
        whole = F.col("b").isNull()
        lo = F.when(F.col("left") <= 0, F.col("lo")).when(whole, F.lit(1 << HASH_BITS)).when(single & (rest * 2 >= F.col("n")), start + F.lit(1 << shift)).otherwise(start)
        left = F.when((F.col("left") <= 0) | whole | single, F.lit(0.0)).otherwise(rest)
        step = step.select("source", "copies", "budget", lo.cast("long").alias("lo"), left.alias("left"))
        low, path = materialize(step, "thresholds")
        if before:
            delete(words.sparkSession, before)
        before = path
        if not low.filter("left > 0").limit(1).count():
            break
    return low.select("source", "copies", F.col("lo").alias("threshold"))


def plan(docs: DataFrame, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """One row for each source: source_g, source_size, target, copies (of every document) and threshold (of those taken once more)."""
    words, words_at = materialize(docs.select("source", size_of().alias("size"), hash_of().alias("h")), "sizes")
    goal = targets(words.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights)
    ratio = F.col("target") / F.col("source_size")
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(ratio + 1e-12), F.lit(int(most)))).otherwise(F.lit(0)).cast("long")
    budgets = goal.withColumn("copies", copies).select("source", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))
    low = thresholds(words, budgets)
    delete(docs.sparkSession, words_at)
    both = goal.join(low.withColumnRenamed("source", "source_l"), F.col("source").eqNullSafe(F.col("source_l")))
    return materialize(both.select(F.col("source").alias("source_g"), "source_size", "target", "copies", "threshold"), "mix")[0]


def _planned(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Adds the source's plan and ``times``, how often the document is taken, to rows with source and h.

    The table of sources is small beside the documents: Spark broadcasts it below its own threshold, and splits hot sources otherwise.
    """
    joined = rows.join(per_source, F.col("source").eqNullSafe(F.col("source_g")), "left")
    return joined.withColumn("times", F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))


def mix(docs: DataFrame, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row.

    Null texts have size 0 and add nothing. Equal rows share a hash and are taken or left together. A source without words has
    target 0. An empty table gives no rows. Reruns agree: the hash depends on doc_id and text alone. Other columns play no part.
    """
    own = docs.select("doc_id", "text", "source")
    rows = own.select("doc_id", "source", size_of().alias("size"), hash_of().alias("h"))
    taken = F.col("size") * F.col("times")
    return _planned(rows, plan(own, most, weights)).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """Each row as often as the mix takes it, with all its columns, whatever they are called. Texts don't travel.

    A document without words is taken as often as its source's others of such a hash.
    """
    rows = wrapped(docs, source=F.col("source"), h=hash_of())
    times = _planned(rows, plan(docs.select("doc_id", "text", "source"), most, weights)).filter("times > 0")
    return unwrapped(times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))))
