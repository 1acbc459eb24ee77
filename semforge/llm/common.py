"""What the operators share: tables in the shared folder, Arrow batches of bounded size, words and hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What `[^\x20\x09-\x0D]+` leaves out.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 4 << 20
#: Bytes that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only a local session may do without."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="semforge-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends."""
    path = f"{shared_dir(spark)}/semforge/{name}-{uuid.uuid4().hex}"
    at, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop_path(spark, path)
    fs.delete(at, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: the plan ends there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of a few MB, as texts can be long; one long text is a batch of its own."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def wrapped(docs: DataFrame, **columns: F.Column) -> DataFrame:
    """``row``, all columns of ``docs`` as one struct, and the given columns: whatever names ``docs`` has, none can clash."""
    return docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unwrapped(rows: DataFrame, **columns: F.Column) -> DataFrame:
    """The columns of ``row`` again, and the given ones, which replace those of the same name."""
    new = {n.lower() for n in columns}
    kept = [F.col("row")[n].alias(n) for n in rows.schema["row"].dataType.names if n.lower() not in new]
    return rows.select(*kept, *[c.alias(n) for n, c in columns.items()])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def extended(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in columns.items())])


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Runs of rows of about ``limit`` bytes of text; a longer single text is a chunk of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        column = batch.column(text)
        ends = np.frombuffer(column.buffers()[1], np.int32 if column.type in (pa.string(), pa.binary()) else np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        start = 0
        for k in range(len(column)):
            n = int(ends[k + 1] - ends[k])
            if size and size + n > limit:
                if k > start:
                    held.append(batch.slice(start, k - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, k
            size += n
        if len(column) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
    pa.default_memory_pool().release_unused()


def flat_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column in one byte array, and where each starts (one entry more than rows). Null is empty."""
    merged = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(merged, pa.ChunkedArray):
        merged = pa.concat_arrays(merged.chunks) if merged.num_chunks else pa.array([], column.type)
    merged = merged.cast(pa.large_binary()) if merged.type in (pa.binary(), pa.large_binary()) else merged.cast(pa.large_string()).cast(pa.large_binary())
    if not len(merged):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = merged.buffers()
    at = np.frombuffer(buffers[1], np.int64)[merged.offset : merged.offset + len(merged) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(SEPARATORS)] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the row that it belongs to. Words end where their row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ~_SEPARATOR[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inner[cuts]
    last[cuts - 1] = inner[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: An odd base, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value times power, one entry more than values, and the inverse powers: a range's hash is their product."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    return sums, powers(n + 1, pow(_BASE, -1, 1 << 64))


def range_hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each range; equal ranges have equal hashes wherever they lie."""
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... with counts[0] entries, then the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def text_key() -> F.Column:
    """Tells rows of one doc_id apart that have different texts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs, in order; spans that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]
