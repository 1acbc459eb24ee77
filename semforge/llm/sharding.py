"""Sharding: a Feistel permutation with cycle walking over global row numbers.

The row number is the rank of a row in the order (doc_id, CRC-32 of the text, hash of the text). The permutation of 0 .. rows-1 gives
a place; place modulo the shard count is the shard, the quotient the slot. Both can be computed from the row number and the row
count alone, and counts of shards differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semforge.llm.common import arrow_map, extended, materialize, mix, partitions, unwrapped, wrapped

SHARDS = 40
ROUNDS = 6
KEY = 0x5EED


def permute(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. n-1, applied to each of ``x``. A value that falls outside is permuted again until it is inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in range(rounds):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64))
            left, right = right, left ^ (mix(right + salt) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _text() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _crc() -> F.Column:
    return F.crc32(_text().cast("binary")).cast("long")


def _sharded(rows: DataFrame, shards: int, key: int) -> DataFrame:
    """(row, doc_id, crc, tie) to the columns of ``row`` with shard and slot.

    The order is made by a range partitioning whose result is written to the shared folder, so that the row counts of its partitions,
    all that the driver gets, hold for the rows read afterwards.
    """
    # Equal rows may fill more than one partition: the place in the input breaks ties.
    order = ["doc_id", "crc", "tie", "at"]
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    placed, _ = materialize(ranged.select("row", F.monotonically_increasing_id().alias("id")), "shard")
    part = F.shiftrightunsigned("id", 33)
    counts = {int(r["p"]): int(r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, before, at = sum(counts.values()), {}, 0
    for p in sorted(counts):
        before[p] = at
        at += counts[p]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            numbers = np.array([before[p] for p in (ids >> 33).tolist()], np.int64) + (ids & ((1 << 33) - 1)) if len(ids) else np.zeros(0, np.int64)
            to = permute(numbers, total, key)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array((to % shards).astype(np.int32)), pa.array(to // shards)], ["row", "shard", "slot"])

    schema = extended(placed.select("row").schema, shard=T.IntegerType(), slot=T.LongType())
    return unwrapped(arrow_map(placed, place, schema), shard=F.col("shard"), slot=F.col("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """All rows with their shard and slot, which replace columns of these names; other columns may have any name.

    Rows are numbered in the order of doc_id, nulls first, CRC-32 of the text and the hash of all columns; rows equal in these are
    interchangeable. A null text counts as an empty one. No row is dropped; an empty table stays empty.
    """
    # Maps and variants have no hash of their own.
    named = [(f, F.col("`" + f.name.replace("`", "``") + "`")) for f in docs.schema]
    every = [F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else c for f, c in named]
    return _sharded(wrapped(docs, doc_id=F.col("doc_id"), crc=_crc(), tie=F.xxhash64(*every)), shards, key)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; texts themselves don't travel.

    Null doc_ids and texts are kept as rows, a null text as an empty one; repeated rows get places of their own; columns of other names
    play no part; an empty table stays empty.
    """
    size = F.octet_length(_text()).cast("long") + 16
    row = F.struct(F.col("doc_id"), size.alias("size"), _crc().alias("text_crc32"))
    out = _sharded(docs.select(row.alias("row"), "doc_id", _crc().alias("crc"), F.xxhash64(_text()).alias("tie")), shards, KEY)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
