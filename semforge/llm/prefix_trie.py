"""Conversation prefix trie: prefix-doubling naming.

Equal turns get one dense number. Blocks of 2, 4, 8, ... turns at aligned places are pairs of halves; each round groups the halves of a
block, numbers the distinct pairs and joins the numbers back. A prefix of d turns is the chain of blocks that d has in binary, the largest
first; each is the pair of a shorter prefix, whose length has one bit less, and one block, so rounds from the highest bit to the lowest
name every prefix once. After twice the logarithm of the longest conversation in rounds, equal prefixes have equal names: the nodes.

Sums over subtrees need no walk. The smallest member of a node is the smallest of every deeper node on its path too, so each conversation
owns a run of nodes at the end of its path, and a subtree is its top's own run from there on with all that its members own further down.
No group is ever held: long conversations are spread by place, common nodes are summed before they are sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semforge.llm.common import arrow_map, delete, materialize, partitions

#: Conversations of one group share the beginning of its first one; fixed by the contract, like the number of possible shared lengths.
GROUP, LENGTHS = 100, 6
#: Nodes of one conversation in a block of the sums.
RUN_BITS = 10
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, str, int]:
    """The rows with ``n``, a gapless number from 0 in the order of partitions, the path of their table and the row count."""
    stored, path = materialize(df.withColumn("id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("id", 33)
    counts = sorted((r["p"], r["c"]) for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    before = np.r_[0, np.cumsum([c for _, c in counts])].tolist()
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before[:-1], strict=True)], "p long, start long")
    # One row for each partition of the table.
    rows = stored.join(F.broadcast(starts), part == F.col("p")).withColumn("n", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1))
    return rows.drop("id", "p", "start"), path, before[-1]


class Names:
    """Dense numbers for distinct keys, one range after another, from 1 on."""

    def __init__(self) -> None:
        self.next = 1

    def give(self, rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, str]:
        """``rows`` with ``name`` instead of ``keys``, as a table, and its path."""
        numbers, path, count = _numbered(rows.select(*keys).distinct(), "names")
        first, self.next = self.next, self.next + count
        named = rows.join(numbers.withColumn(name, F.col("n") + first).drop("n"), keys).drop(*keys)
        found, at = materialize(named, "named")
        delete(rows.sparkSession, path)
        return found, at


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, at, digest, len) of every turn of the rebuilt conversations, and (conv, size) of every conversation.

    Turns go by turn, nulls first; several rows of one turn by digest. Rows without a conv_id are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("len"))
    order = ["conv", F.col("turn").asc_nulls_first(), "digest"]
    sorted_rows, _, _ = _numbered(rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).drop("turn"), "turns")
    sizes = sorted_rows.groupBy("conv").agg(F.min("n").alias("first"), F.count("*").alias("own"))
    placed = sorted_rows.join(sizes.select("conv", "first"), "conv").select("conv", (F.col("n") - F.col("first")).alias("at"), "digest", "len")
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % LENGTHS).cast("long")
    plans = sizes.select("conv", "own", shared.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    bases = sizes.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plans = plans.join(bases, "base", "left").select("conv", "own", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    plans, _ = materialize(plans.select("*", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "plans")
    heads = placed.where((F.col("conv") % GROUP == 0) & (F.col("at") < LENGTHS)).withColumnRenamed("conv", "base")
    head = heads.join(plans.select("conv", "base", "h"), "base").where(F.col("at") < F.col("h")).select("conv", "at", "digest", "len")
    rest = placed.join(plans.select("conv", "h", "taken"), "conv").where(F.col("at") >= F.col("h")).select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "len")
    return head.unionByName(rest), plans.select("conv", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, len): the name of each prefix of ``turns`` (conv, at, digest, len), and the length of its last text."""
    spark, names = turns.sparkSession, Names()
    level, path = names.give(turns, ["digest"], "name")
    longest = (level.agg(F.max("at")).first()[0] or 0) + 1
    blocks, paths = [level], [path]
    while 2 ** len(blocks) <= longest:
        half = 2 ** (len(blocks) - 1)
        first = F.shiftright("at", len(blocks) - 1) % 2 == 0
        pair = blocks[-1].groupBy("conv", (F.col("at") - F.col("at") % (2 * half)).alias("at")).agg(F.max(F.when(first, F.col("name"))).alias("a"), F.max(F.when(~first, F.col("name"))).alias("b"))
        level, path = names.give(pair.where(F.col("a").isNotNull() & F.col("b").isNotNull()), ["a", "b"], "name")
        blocks.append(level)
        paths.append(path)
    known = None
    for k in range(len(blocks) - 1, -1, -1):
        block = blocks[k].select("conv", "at", "name")
        # From an even multiple of the block's size: the prefix that ends there was named by a higher bit, or is empty.
        block = block.where(F.shiftright("at", k) % 2 == 0)
        start = block.where(F.col("at") == 0).select("conv", F.lit(2**k).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.col("name").alias("b"))
        if known is not None:
            longer = block.where(F.col("at") > 0).join(known.withColumnRenamed("depth", "at"), ["conv", "at"])
            start = start.unionByName(longer.select("conv", (F.col("at") + 2**k).alias("depth"), F.col("node").alias("a"), F.col("name").alias("b")))
        named, path = names.give(start, ["a", "b"], "node")
        paths.append(path)
        known = named if known is None else known.unionByName(named)
    if known is None:
        known = spark.createDataFrame([], "conv long, depth long, node long")
    lengths = blocks[0].select("conv", (F.col("at") + 1).alias("depth"), "len")
    found, _ = materialize(known.join(lengths, ["conv", "depth"]), "prefixes")
    for path in paths:
        delete(spark, path)
    return found


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each node in a row."""
    at = batch.column("node").to_numpy()
    cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)].tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(at[a]), batch.slice(a, b - a)


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of each node's conv ids in order.

    They are sorted over all tasks, so that a node with many is in many, and joined to pieces of a batch there. SHA-256 is sequential by
    its definition: the pieces of one node pass one task, of which none is held.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            pieces = [(node, ",".join(map(str, rows.column("conv").to_pylist()))) for node, rows in _runs(batch)]
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in pieces], pa.int64()), pa.array([batch.column("part")[0].as_py()] * len(pieces), pa.int32()), pa.array(range(number, number + len(pieces)), pa.int64()), pa.array([x for _, x in pieces], pa.string())], ["node", "part", "number", "piece"])
                number += len(pieces)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out: list[tuple[int, str]] = []
            for at, rows in _runs(batch):
                more = node is not None and at == node
                if not more:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(("," * more + ",".join(rows.column("piece").to_pylist())).encode())
            if out:
                yield _hashes(out)
        if node is not None:
            yield _hashes([(node, state.hexdigest())])

    def _hashes(out: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], ["node", "ends_sha256"])

    ordered = ends.repartitionByRange(partitions(ends), "node", "conv").sortWithinPartitions("node", "conv")
    pieces = arrow_map(ordered.select("node", "conv", F.spark_partition_id().alias("part")), joined, "node long, part int, number long, piece string")
    return arrow_map(pieces.repartition(partitions(ends), "node").sortWithinPartitions("node", "part", "number"), hashed, "node long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, as the contract has them.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null role or text is empty; rows without a
    conv_id are left out; several rows of one turn are ordered by a digest of role and text, repeated ones all stay. An empty table has
    no node, any other has a root. Columns of other names play no part.
    """
    spark = conversations.sparkSession
    turns, sizes = rebuilt(conversations)
    steps = prefixes(turns)
    nodes = steps.groupBy("node").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("len").alias("len"))
    above = steps.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes, _ = materialize(nodes.join(above, ["conv", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(0))), "nodes")
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    under_root = children.where(F.col("parent") == 0).select("n_children")
    nodes = nodes.join(children.where(F.col("parent") != 0).withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("len")
    nodes, _ = materialize(nodes.withColumns({"leaf": leaf, "saved": saved, "run": F.shiftright("depth", RUN_BITS)}), "nodes")

    # What a conversation owns from each of its nodes on: within runs of depths, then all of the runs below.
    below = Window.partitionBy("conv", "run").orderBy(F.desc("depth"))
    runs = nodes.groupBy("conv", "run").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("all_saved"), F.min("depth").alias("top"))
    later = Window.partitionBy("conv").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    after = runs.select("conv", "run", F.coalesce(F.sum("leaves").over(later), F.lit(0)).alias("more_leaves"), F.coalesce(F.sum("all_saved").over(later), F.lit(0)).alias("more_saved"))
    own = nodes.withColumns({"own_leaves": F.sum("leaf").over(below), "own_saved": F.sum("saved").over(below)}).join(after, ["conv", "run"])
    owned = runs.groupBy("conv").agg(F.min("top").alias("top"), F.sum("leaves").alias("leaves"), F.sum("all_saved").alias("all_saved"))
    passed = steps.join(owned, "conv").where(F.col("depth") < F.col("top")).groupBy("node").agg(F.sum("leaves").alias("deep_leaves"), F.sum("all_saved").alias("deep_saved"))

    ends = sizes.where(F.col("size") > 0).join(steps, (F.col("size") == F.col("depth")) & (sizes["conv"] == steps["conv"])).select("node", steps["conv"])
    ends = ends.unionByName(sizes.where(F.col("size") == 0).select(F.lit(0).cast("long").alias("node"), "conv"))
    hashes = _ends(ends)
    root = sizes.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).first()
    if not root["n_convs"]:
        return spark.createDataFrame([], NODE)
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    parent = F.when(F.col("parent") == 0, F.lit(root["conv_id"])).otherwise(F.col("parent_conv"))
    full = own.join(passed, "node", "left").join(hashes, "node", "left").join(parents, "parent", "left")
    zero = F.lit(0).cast("long")
    inner = full.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("own_leaves") + F.col("more_leaves") + F.coalesce("deep_leaves", zero)).alias("n_leaves"),
        (F.col("own_saved") + F.col("more_saved") + F.coalesce("deep_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    whole = nodes.agg(F.coalesce(F.sum("leaf"), zero).alias("leaves"), F.coalesce(F.sum("saved"), zero).alias("saved")).first()
    under = under_root.first()
    top = spark.createDataFrame([(0, root["conv_id"], root["n_convs"], under["n_children"] if under else 0, whole["leaves"] or 1, whole["saved"])], "node long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    top = top.join(hashes, "node", "left").select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return inner.unionByName(top)
