"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of at most 4 differing bits have a common variant at most 2 bits from each. So every distinct fingerprint emits all
its 2081 variants within 2 bits, variants are dealt to tasks by their hash, equal ones meet, and those that share a variant link.
A variant travels as the number of its bit flips, most often one byte: the fingerprint itself is sent once for each task and block.
All members of one variant's group are within 4 bits of each other, so a star to the smallest links them without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semforge.llm.common import arrow_map, chunks, delete, expand, extended, flat_bytes, materialize, mix, partitions, text_key, unwrapped, word_bounds, wrapped

SHINGLE, RADIUS, SEED = 4, 4, 42
#: A fingerprint that more than this share of all rows have doesn't travel by its hash; there are fewer of them than 1 / HOT.
HOT = 1 / 4096
_P = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P[1], 31) * _P[0]


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges at once: each step of the published algorithm is done for all ranges that need it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(padded) - 7
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    four = np.ndarray((n,), "<u4", padded, strides=(1,))
    seed64 = np.uint64(seed)
    at, left = starts.astype(np.int64).copy(), lengths.astype(np.int64).copy()
    h = np.full(len(starts), seed64 + _P[4], np.uint64)
    long = np.flatnonzero(left >= 32)
    if len(long):
        acc = [np.full(len(long), (seed + k) % (1 << 64), np.uint64) for k in (int(_P[0]) + int(_P[1]), int(_P[1]), 0, -int(_P[0]))]
        live = np.arange(len(long))
        while len(live):
            p = at[long[live]]
            for k in range(4):
                acc[k][live] = _round(acc[k][live], eight[p + 8 * k])
            at[long[live]] += 32
            left[long[live]] -= 32
            live = live[left[long[live]] >= 32]
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for k in range(4):
            x = (x ^ _round(np.zeros(len(long), np.uint64), acc[k])) * _P[0] + _P[3]
        h[long] = x
    h += lengths.astype(np.uint64)
    live = np.flatnonzero(left >= 8)
    while len(live):
        x = h[live] ^ _round(np.zeros(len(live), np.uint64), eight[at[live]])
        h[live] = _rotl(x, 27) * _P[0] + _P[3]
        at[live] += 8
        left[live] -= 8
        live = live[left[live] >= 8]
    live = np.flatnonzero(left >= 4)
    x = h[live] ^ four[at[live]].astype(np.uint64) * _P[0]
    h[live] = _rotl(x, 23) * _P[1] + _P[2]
    at[live] += 4
    left[live] -= 4
    live = np.flatnonzero(left > 0)
    while len(live):
        x = h[live] ^ padded[at[live]].astype(np.uint64) * _P[4]
        h[live] = _rotl(x, 11) * _P[0]
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    h ^= h >> np.uint64(33)
    h *= _P[1]
    h ^= h >> np.uint64(29)
    h *= _P[2]
    return h ^ h >> np.uint64(32)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(texts: pa.ChunkedArray) -> np.ndarray:
    """The 64-bit fingerprint of each text; zero for texts without words and for null."""
    data, offsets = flat_bytes(texts)
    starts, ends, rows = word_bounds(data, offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    # All words joined by one blank, so that a shingle is a range of bytes.
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(to[-1] + sizes[-1]), 32, np.uint8)
    joined[expand(to, sizes)] = _LOWER[data[expand(starts, sizes)]]
    words = np.bincount(rows, minlength=n)
    first = np.cumsum(words) - words
    have = np.flatnonzero(words)
    count = np.maximum(words[have] - SHINGLE + 1, 1)
    head = expand(first[have], count)
    last = head + np.repeat(np.minimum(words[have], SHINGLE), count) - 1
    at = to[head]
    length = to[last] + sizes[last] - at
    cut = np.cumsum(count) - count
    ones = np.zeros((len(have), 64), np.int64)
    block = 1 << 17
    for a in range(0, len(at), block):
        b = min(len(at), a + block)
        h = xxh64(joined, at[a:b], length[a:b])
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.searchsorted(cut, a, "right") - 1, np.searchsorted(cut, b, "left")
        ones[lo:hi] += np.add.reduceat(bits, np.maximum(cut[lo:hi], a) - a, axis=0, dtype=np.int32)
    set_ = (2 * ones > count[:, None]).astype(np.uint8)
    out[have] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Adds fp, the fingerprint as a signed long, in the place of the text."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, limit=1 << 20):
            yield from rows.select(names).append_column("fp", pa.array(fingerprints(rows.column("text")).view(np.int64))).combine_chunks().to_batches()

    return arrow_map(docs, run, extended(docs.select(*names).schema, fp=T.LongType()))


def flips(half: int = RADIUS // 2) -> np.ndarray:
    """The bit masks of all variants within ``half`` bits, the fingerprint itself first."""
    return np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)], np.uint64)


def _pack(fps: np.ndarray, mask: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """For each task the fingerprints, how many variants of each it gets, and which: as steps of a byte, 255 standing for that and more to come."""
    variants = fps[:, None] ^ mask[None, :]
    to = (mix(variants.ravel()) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(to.astype(np.uint16 if parts <= 65536 else np.uint32), kind="stable")
    owner, flip = (order // len(mask)).astype(np.int64), order % len(mask)
    bounds = np.searchsorted(to[order], np.arange(parts + 1, dtype=np.uint64))
    for p in range(parts):
        a, b = bounds[p], bounds[p + 1]
        if a == b:
            continue
        who, which = owner[a:b], flip[a:b]
        step = which.copy()
        same = np.r_[False, who[1:] == who[:-1]]
        step[1:] -= np.where(same[1:], which[:-1], 0)
        more = step // 255
        raw = np.zeros(len(step) + int(more.sum()), np.uint8)
        end = np.cumsum(more + 1) - 1
        raw[:] = 255
        raw[end] = step % 255
        ids, counts = np.unique(who, return_counts=True)
        yield p, b"".join([np.array([len(ids), len(step)], "<u4").tobytes(), fps[ids].astype("<u8").tobytes(), counts.astype("<u2").tobytes(), raw.tobytes()])


def _unpack(raw: bytes, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and variant of each entry."""
    n, m = np.frombuffer(raw, "<u4", 2)
    fps = np.frombuffer(raw, "<u8", n, 8)
    counts = np.frombuffer(raw, "<u2", n, 8 + 8 * n).astype(np.int64)
    steps = np.frombuffer(raw, np.uint8, offset=8 + 10 * int(n))
    run = np.cumsum(steps.astype(np.int64))
    ends = np.flatnonzero(steps != 255)
    at = run[ends]
    # Sums start anew at each fingerprint.
    first = np.cumsum(counts) - counts
    base = np.where(first > 0, at[np.maximum(first - 1, 0)], 0)
    flip = at - np.repeat(base, counts)
    who = np.repeat(fps, counts)
    return who, who ^ mask[flip]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to pairs (a, b) that connect all within ``radius`` bits; every pair is verified."""
    # Fewer than 65536 pieces of a million variants each: a task would need 64 billion of them.
    mask, parts, most = flips(radius // 2), 2 * partitions(fps), 512

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            all_ = np.concatenate(held) if held else np.zeros(0, np.uint64)
            for k in range(0, len(all_), most):
                found = list(_pack(all_[k : k + most], mask, parts))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in found], pa.int32()), "block": pa.array([x for _, x in found], pa.binary())})

        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [raw for batch in batches for raw in batch.column("block").to_pylist()]
        if not blocks:
            return
        # Sub-ranges of the variants keep the sorted arrays small.
        total = sum(int.from_bytes(raw[4:8], "little") for raw in blocks)
        pieces = max(1, total >> 20)
        a, v, which, at = np.empty(total, np.uint64), np.empty(total, np.uint64), np.empty(total, np.uint16), 0
        for k, raw in enumerate(blocks):
            who, what = _unpack(raw, mask)
            blocks[k] = b""
            to = at + len(who)
            a[at:to], v[at:to], which[at:to] = who, what, mix(what) % np.uint64(pieces)
            at = to
        found = []
        for k in range(pieces):
            own = np.flatnonzero(which == k)
            if len(own) < 2:
                continue
            x, y = a[own], v[own]
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
            new = np.r_[True, y[1:] != y[:-1]]
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            many = size[group] > 1
            if not many.any():
                continue
            least = np.minimum.reduceat(x, np.flatnonzero(new))[group]
            keep = many & (x != least)
            pair = np.stack([least[keep], x[keep]], 1)
            differ = np.bitwise_count(pair[:, 0] ^ pair[:, 1])
            found.append(pair[differ <= radius])
        if found:
            pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    # A table of fingerprints is small for the variants that it makes, so it is dealt out first.
    blocks = fps.select("fp").repartition(partitions(fps), "fp").mapInArrow(emit, "part int, block binary").repartitionById(parts, F.col("part"))
    return arrow_map(blocks, meet, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """(id, label) and (a, b) to (id, label): each node in an edge gets the least label that it reaches; and the table it reads.

    Each round, nodes take the least label of their neighbours, and edges are drawn anew between a node and the least node known to
    it, which halves distances. Pairs that agree drop out. Tables in the shared folder end each round's plan; nothing is collected.
    """
    star = edges
    state, path = None, None
    for _ in range(rounds):
        # Large star: larger neighbours are linked to the least; small star: smaller ones. A hot centre only appears in partial minima.
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(low, F.col("b") == F.col("n")).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new, new_path = materialize(small, "star")
        n, total = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = (n, total) == state
        state = (n, total)
        if path:
            delete(edges.sparkSession, path)
        star, path = new, new_path
        if done or n == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Stars: each node has one centre, the least node of its component.
    member = star.select(F.col("b").alias("id"), F.col("a").alias("centre")).union(star.select(F.col("a").alias("id"), F.col("a").alias("centre")).distinct())
    labelled = member.join(nodes, "id")
    low = labelled.groupBy("centre").agg(F.min("label").alias("label"))
    return member.join(low, "centre").select("id", "label"), path


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) to doc_id, fp and component_id for every row.

    Null and wordless texts have fingerprint zero and link like others. A null doc_id takes part in links but names no component;
    a component without any id has a null one. Repeated rows are in one component.
    """
    extra = [c for c in ("tie",) if c in docs.columns]
    marked, _ = materialize(fingerprinted(docs.select("doc_id", text_key().alias("key"), "text", *extra)), "fingerprints")
    nodes, nodes_at = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("label"), F.count("*").alias("n")).withColumnRenamed("fp", "id"), "nodes")
    edges, edges_at = materialize(links(nodes.select(F.col("id").alias("fp")), radius), "links")
    joined, star_at = components(nodes.select("id", "label"), edges)
    final = nodes.join(joined.withColumnRenamed("label", "joined"), "id", "left").select(F.col("id").alias("fp"), F.when(F.col("joined").isNotNull(), F.col("joined")).otherwise(F.col("label")).alias("component_id"), "n")
    final, _ = materialize(final, "classes")
    for path in (nodes_at, edges_at, star_at):
        delete(docs.sparkSession, path)
    # Rows of a hot fingerprint would all travel to one task. Those fingerprints are fewer than 1 / HOT, so they are broadcast instead.
    total = final.agg(F.sum("n")).first()[0] or 0
    hot = final.filter(F.col("n") > total * HOT).select(F.col("fp").alias("hot"), F.col("component_id").alias("hot_id"))
    placed = marked.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left")
    names = marked.columns
    rest = placed.filter("hot is null").select(*names).join(final.filter(F.col("n") <= total * HOT).select("fp", "component_id"), "fp", "left")
    return placed.filter("hot is not null").select(*names, F.col("hot_id").alias("component_id")).unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows get equal results; rows without a doc_id stay,
    and no component is named by them. Texts may be as long as Spark's strings; columns of other names play no part; an empty table stays
    empty.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id. Rows without a doc_id can't be named and stay.

    Of rows that share the doc_id that stays, that with the smallest hash of its text, then of all its columns, stays; rows that agree
    in all columns are one. Other columns may have any name.
    """
    columns = [F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in docs.schema]
    rows = wrapped(docs, doc_id=F.col("doc_id"), text=F.col("text"), tie=F.xxhash64(*columns))
    first = grouped(rows.select("doc_id", "text", "tie")).filter("doc_id = component_id").groupBy("doc_id").agg(F.min(F.struct("key", "tie")).alias("least"))
    keep = first.select(F.col("doc_id").alias("kept"), F.col("least.key").alias("kept_key"), F.col("least.tie").alias("kept_tie"))
    named = rows.join(keep, (F.col("doc_id") == F.col("kept")) & (F.col("tie") == F.col("kept_tie")) & (text_key() == F.col("kept_key")), "left_semi")
    return unwrapped(named.dropDuplicates(["doc_id"]).unionByName(rows.filter("doc_id is null")))
