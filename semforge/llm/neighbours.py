"""Approximate nearest neighbours: shifted space-filling curves.

Vectors are projected and put in the order of several Hilbert curves, each with a rotation and a shift of its own. Every ordering is cut
into cells of equally many vectors, by splitters from a bounded sample, and the vectors are range-partitioned into them. A query meets the
whole vectors of its own cell and of ``k`` cells on either side in every ordering; what the orderings find is merged and ranked by the
exact distance. ``k`` is not a guess: a bounded number of queries is answered exactly, by comparison with all vectors, and ``k`` is the
least number of cells that would have found the wanted share of their neighbours. Data with structure need few cells; vectors spread
evenly over a sphere of many dimensions have no near and far on any curve, and then the windows grow until the recall is there.

Equal vectors are one item with its smallest ids, so that copies fill no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semforge.llm.common import arrow_map, materialize, mix, partitions

#: Neighbours of each query.
TOP = 10
#: Rows whose id this divides are the queries.
EVERY = 100
#: Hilbert orderings.
CURVES = 4
#: Dimensions of a curve, and principal components that its rotation draws from.
AXES, COMPONENTS = 8, 32
#: Vectors in a cell, and the most cells of an ordering: beyond them, cells hold more.
CELL_ROWS, MOST_CELLS = 4096, 1 << 18
#: Vectors that the mean, the components and the scale are fitted on, at most about; keys that a cell's splitters are drawn from.
FIT_ROWS, CELL_KEYS = 8192, 8
#: Queries that are answered exactly to find the width, about, and the share of their neighbours that the windows must hold.
PROBES, SHARE = 160, 0.97
#: Products of a query and a vector that a task computes at once.
BLOCK = 1 << 21


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid points along the Hilbert curve, as 64-bit integers: each axis has ``bits`` bits, axes times bits are 64 at most.

    The curve is unrolled from the highest bit to the lowest: at each level the point is reflected and its axes exchanged as the curve's
    turn in that orthant says, and the Gray code of the axes is the place in it.
    """
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    if len(x) == 1:
        return x[0]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i in range(len(x)):
            high = (x[i] >> np.uint64(level)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    place = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = place << one | ((axis ^ turn) >> np.uint64(level)) & one
    return place


class Curves:
    """The orderings, fitted on a sample: projections, shifts and grid of each."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 11):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        axes = min(AXES, dims)
        self.bits = min(16, 64 // axes)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        values, vectors = np.linalg.eigh(centred.T @ centred / len(sample))
        main = vectors[:, ::-1][:, : min(COMPONENTS, dims)]
        self.maps, self.lows, self.steps = [], [], []
        for _ in range(curves):
            rotation = np.linalg.qr(rng.normal(size=(main.shape[1], main.shape[1])))[0][:, :axes]
            to = main @ rotation
            seen = centred @ to
            low, high = seen.min(axis=0), seen.max(axis=0)
            span = np.maximum(high - low, 1e-300) * 1.5
            self.maps.append(to)
            self.lows.append(low - rng.uniform(0, 1 / 3, axes) * span)
            self.steps.append((1 << self.bits) / span)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        """Places on one curve; what lies outside the sample's box counts as on its border."""
        at = ((vectors - self.mean) @ self.maps[curve] - self.lows[curve]) * self.steps[curve]
        return hilbert(np.clip(np.nan_to_num(at), 0, (1 << self.bits) - 1).astype(np.uint64), self.bits)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def nearest(queries: np.ndarray, vectors: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its row number, the rows of at least the ``top`` nearest vectors (with all ties) and their exact distances."""
    origin = vectors.mean(axis=0) if len(vectors) else 0
    q, v = queries - origin, vectors - origin
    sizes = (v * v).sum(axis=1)
    step = max(1, BLOCK // max(1, len(v)))
    for start in range(0, len(q), step):
        part = q[start : start + step]
        own = (part * part).sum(axis=1)
        squares = own[:, None] + sizes[None, :] - 2 * (part @ v.T)
        for i, row in enumerate(squares):
            # The product may be off by a rounding of the squares; all that could be among the nearest is measured exactly.
            slack = 1e-13 * (own[i] + sizes.max(initial=0))
            bound = np.partition(row, top - 1)[top - 1] if len(row) > top else np.inf
            rows = np.flatnonzero(row <= bound + 2 * slack)
            difference = vectors[rows] - queries[start + i]
            distances = np.sqrt((difference * difference).sum(axis=1))
            if len(rows) > top:
                near = distances <= np.partition(distances, top - 1)[top - 1]
                rows, distances = rows[near], distances[near]
            yield start + i, rows, distances


def items(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", top: int = TOP, every: int = EVERY) -> DataFrame:
    """(item, v, ids, query): each different vector once, with its ``top + 1`` smallest ids and whether one of its rows is a query.

    Rows without an id, and vectors that are null, zero, of another length than most, or hold null or non-finite components, are left out.
    """
    kind = vectors.schema[column].dataType.elementType.simpleString()
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").alias("v")).where(F.col("id").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = lengths[0]["n"] if lengths else 1
    # One zero: the negative one is the same component.
    rows = rows.where(F.size("v") == dims).select("id", F.transform("v", lambda x: x + F.lit(0).cast(kind)).alias("v"))
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.reverse("v"), F.lit(1))})
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("rank") <= top + 1)
    distinct = ranked.groupBy("h", "g").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids"))
    asked = rows.where(F.col("id") % every == 0).select("h", "g").distinct().withColumn("query", F.lit(True))
    found = distinct.join(asked, ["h", "g"], "left").select(F.monotonically_increasing_id().alias("item"), "h", "g", "v", "ids", F.coalesce("query", F.lit(False)).alias("query"))
    return materialize(found, "vectors")[0]


def _share(df: DataFrame, rows: int, of: int, salt: int) -> DataFrame:
    """About ``rows`` of ``of`` rows, by a hash of the item: the same ones in every run."""
    part = min(1.0, rows / max(1, of))
    return df if part >= 1 else df.where(F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(1 << 30)) < int(part * (1 << 30)))


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each key among the sample's: equal keys may lie anywhere between."""
    return np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")


def _collected(df: DataFrame, column: str, dims: int) -> np.ndarray:
    rows = [r[column] for r in df.select(column).collect()]
    return np.array(rows, np.float64).reshape(-1, dims)


def neighbours(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", top: int = TOP, every: int = EVERY, share: float = SHARE, cell_rows: int = CELL_ROWS, curves: int = CURVES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest of each query, nearest first, ties to the smaller id.

    Queries are the rows whose id ``every`` divides; candidates are all rows of other ids. Nearness is the Euclidean distance in double
    precision. An id that several rows have counts once, as near as its nearest row; repeated rows change nothing. Rows left out: see
    ``items``. Fewer candidates than ``top``: all of them. An empty table has an empty result; columns of other names play no part.
    """
    found = items(vectors, column, key, top, every)
    spark = found.sparkSession
    total = found.count()
    asked = vectors.select(F.col(f"`{key}`").cast("long").alias("query_id"), F.col(f"`{column}`").alias("v")).where(F.col("query_id") % every == 0)
    first = found.select(F.size("v")).head()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = first[0]
    fitted = Curves(_collected(_share(found, FIT_ROWS, total, 1), "v", dims) if total > FIT_ROWS else _collected(found, "v", dims), curves)
    cells = max(1, min(MOST_CELLS, -(-total // cell_rows)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = _matrix(batch.column("v"), dims)
                yield pa.RecordBatch.from_arrays([pa.array(fitted.keys(v, c).view(np.int64)) for c in range(curves)], [f"k{c}" for c in range(curves)])

    names = [f"k{c}" for c in range(curves)]
    schema = ", ".join(f"{n} long" for n in names)
    drawn = arrow_map(_share(found, cells * CELL_KEYS, total, 2).select("v"), keyed, schema).toArrow()
    sample = [np.sort(drawn.column(n).to_numpy().astype(np.int64).view(np.uint64)) for n in names]
    splitters = [s[(np.arange(1, cells) * len(s)) // cells] if len(s) else s for s in sample]

    queries = found.where("query")
    probes = _share(queries, PROBES, queries.count(), 3).select("item", "v").collect() if cells > 1 else []
    width = _width(found, probes, fitted, sample, cells, top, share, dims, curves)

    kind = found.schema["v"].dataType.simpleString()
    dealt_schema = f"cell long, asks boolean, item long, ids array<long>, v {kind}"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector once in each ordering, every query once in each cell of its windows."""
        for batch in batches:
            if not len(batch):
                continue
            v, item = _matrix(batch.column("v"), dims), batch.column("item").to_numpy()
            query = np.flatnonzero(batch.column("query").to_numpy(zero_copy_only=False))
            for c in range(curves):
                low, high = _places(splitters[c], fitted.keys(v, c))
                # Vectors of one key are dealt over all cells that have it.
                own = low + (mix(item.astype(np.uint64)) % (high - low + 1).astype(np.uint64)).astype(np.int64)
                yield _batch(batch, np.arange(len(batch)), own + c * cells, False)
                start, end = np.maximum(low[query] - width, 0), np.minimum(high[query] + width, cells - 1)
                spread = np.repeat(query, end - start + 1)
                at = np.arange(len(spread)) - np.repeat(np.cumsum(end - start + 1) - (end - start + 1), end - start + 1) + np.repeat(start, end - start + 1)
                for k in range(0, len(spread), 4096):
                    yield _batch(batch, spread[k : k + 4096], at[k : k + 4096] + c * cells, True)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of each cell for each query that came to it; a cell's vectors come before its queries."""
        cell, held, table = -1, [], None
        for batch in batches:
            at, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1, len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if at[a] != cell:
                    cell, held, table = int(at[a]), [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if table is None:
                    rows = pa.Table.from_batches(held)
                    ids = rows.column("ids").combine_chunks()
                    table = (_matrix(rows.column("v"), dims), rows.column("item").to_numpy(), ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())])
                yield from _answers(part, table, dims, top)

    spread = arrow_map(found.select("item", "ids", "v", "query"), dealt, dealt_schema)
    grouped = spread.repartition(partitions(found), "cell").sortWithinPartitions("cell", "asks")
    hits = arrow_map(grouped, searched, "item long, vec_id long, score double")
    # An own item's ids are all at distance zero; they and the nearest others are enough for every query of the item.
    best = hits.groupBy("item", "vec_id").agg(F.min("score").alias("score"))
    near = Window.partitionBy("item").orderBy("score", "vec_id")
    best = best.withColumn("n", F.row_number().over(near)).where(F.col("n") <= 2 * top + 1).drop("n")
    asked = asked.where(F.col("v").isNotNull()).select("query_id", F.transform("v", lambda x: x + F.lit(0).cast(found.schema["v"].dataType.elementType)).alias("v"))
    asked = asked.select("query_id", F.xxhash64("v").alias("h"), F.xxhash64(F.reverse("v"), F.lit(1)).alias("g")).distinct()
    asked = asked.join(queries.select("h", "g", "item"), ["h", "g"]).select("query_id", "item")
    pairs = asked.join(best, "item").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _batch(batch: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, asks: bool) -> pa.RecordBatch:
    part = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(np.full(len(rows), asks)), part.column("item"), part.column("ids"), part.column("v")], ["cell", "asks", "item", "ids", "v"])


def _answers(part: pa.RecordBatch, table: tuple, dims: int, top: int) -> Iterator[pa.RecordBatch]:
    vectors, items_, ids, ends = table
    asked, out = part.column("item").to_numpy(), ([], [], [])
    for i, rows, distances in nearest(_matrix(part.column("v"), dims), vectors, top + 1):
        counts = ends[rows + 1] - ends[rows]
        at = np.repeat(ends[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        found, far = ids[at], np.repeat(distances, counts)
        own = np.repeat(items_[rows] == asked[i], counts)
        order = np.lexsort([found, far])
        # Others than the own copies, which every query may leave out but one of, fill the rest.
        others = order[~own[order]][: top + 1]
        keep = np.r_[order[own[order]], others]
        out[0].append(np.full(len(keep), asked[i]))
        out[1].append(found[keep])
        out[2].append(far[keep])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["item", "vec_id", "score"])


def _width(found: DataFrame, probes: list, fitted: Curves, sample: list[np.ndarray], cells: int, top: int, share: float, dims: int, curves: int) -> int:
    """Cells on either side with which the windows hold ``share`` of the probes' true neighbours."""
    if not probes:
        return 0
    asked = np.array([r["v"] for r in probes], np.float64).reshape(-1, dims)
    own = np.array([r["item"] for r in probes])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, curves), np.int64))] * len(asked)
        for batch in batches:
            if not len(batch):
                continue
            v, item = _matrix(batch.column("v"), dims), batch.column("item").to_numpy()
            keys = np.stack([fitted.keys(v, c).view(np.int64) for c in range(curves)], axis=1)
            for i, rows, distances in nearest(asked, v, top + 1):
                other = item[rows] != own[i]
                d, k = np.r_[best[i][0], distances[other]], np.r_[best[i][1], keys[rows[other]]]
                order = np.argsort(d, kind="stable")[:top]
                best[i] = d[order], k[order]
        counts = [len(d) for d, _ in best]
        if sum(counts):
            columns = [np.repeat(np.arange(len(asked)), counts), np.concatenate([d for d, _ in best]), *np.concatenate([k for _, k in best]).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["probe", "d", *(f"k{c}" for c in range(curves))])

    true = arrow_map(found.select("item", "v"), exact, "probe long, d double, " + ", ".join(f"k{c} long" for c in range(curves)))
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy("d", *[f"k{c}" for c in range(curves)]))).where(F.col("n") <= top).toArrow()
    probe, best = true.column("probe").to_numpy(), np.full(len(true), np.inf)
    for c in range(curves):
        keys, place = true.column(f"k{c}").to_numpy().astype(np.int64).view(np.uint64), fitted.keys(asked, c)[probe]
        (a, b), (x, y) = _places(sample[c], keys), _places(sample[c], place)
        best = np.minimum(best, np.maximum(0, np.maximum(a - y, x - b)) / max(1, len(sample[c])))
    return int(np.ceil(np.quantile(best, share) * cells)) if len(best) else 0
