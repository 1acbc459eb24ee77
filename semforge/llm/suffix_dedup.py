"""Exact substring deduplication over bytes with difference-cover suffix arrays.

Candidate stretches of text are dealt to buckets so that all places of a 50-byte string meet in one (see superwindows). Each bucket
orders the suffixes of its strings by the difference cover {1, 2} modulo 3: sampled triples are sorted and named, the names are
ordered by recursion, the remaining suffixes are sorted by their first symbol and the rank after it and merged in. Neighbours in that
order whose first 50 bytes are equal are one class. The recursion ends as soon as names span 50 bytes.

A suffix array over all bytes at once would ship every sampled position once a level: see the README for figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from semforge.llm.common import arrow_map, chunks, expand, flat_bytes
from semforge.llm.superwindows import HOT_RUNS, Shape, Strings, merged, with_spans

LENGTH, MINIMISER = 50, 24


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and the rank of each among the distinct ones, from 1."""
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]])
    return order, rank


def _triples(s: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
    """One integer for the three symbols from each place, in their order; pairs are named first where three don't fit in 63 bits."""
    bits = max(1, top.bit_length())
    if 3 * bits <= 63:
        return s[at] << 2 * bits | s[at + 1] << bits | s[at + 2]
    pair = _ranked(s[at] << 31 | s[at + 1])[1]
    return pair << 31 | s[at + 2]


def _ordered(symbols: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in the order of their first ``depth`` symbols at least, and the rank of each, from 1.

    Symbols are positive integers. Suffixes that agree on ``depth`` symbols or more may share a rank. With ``wanted``, a mask, only
    those places are merged into the order, and ranks are left out.
    """
    n = len(symbols)
    s = np.concatenate([symbols, np.zeros(4, np.int64)])
    top = int(symbols.max()) if n else 0
    if depth <= 2 or n < 3:
        order, rank = _ranked(_triples(s, np.arange(n), top))
        return (order if wanted is None else order[wanted[order]]), rank
    # Places 1 and 2 modulo 3 are the cover. A length of 1 modulo 3 has a sample just past its end, which keeps the two halves apart.
    at = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    keys = _triples(s, at, top)
    if (most := int(keys.max())) < 8 * len(keys):
        # Few enough for a table: names without a sort.
        seen = np.zeros(most + 1, bool)
        seen[keys] = True
        names = np.cumsum(seen)[keys]
        sample = None
    else:
        sample, names = _ranked(keys)
    if depth > 3 and names.max() < len(names):
        sample, names = _ordered(names, -(-depth // 3))
    elif sample is None:
        sample = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[at] = names
    rank[n:] = 0
    sample = at[sample]
    sample = sample[sample < n]
    i0 = np.arange(0, n, 3)
    if wanted is not None:
        sample, i0 = sample[wanted[sample]], i0[wanted[i0]]
    big, wide = int(rank.max()) + 1, top + 1
    first = s[i0] * big + rank[i0 + 1]
    by = np.argsort(first)
    i0, first = i0[by], first[by]
    kind = sample % 3
    i1, i2 = sample[kind == 1], sample[kind == 2]
    # How many samples are smaller than each of the rest: both are compared by what follows up to a sampled place.
    before = np.searchsorted(s[i1] * big + rank[i1 + 1], first)
    before += np.searchsorted((s[i2] * wide + s[i2 + 1]) * big + rank[i2 + 2], (s[i0] * wide + s[i0 + 1]) * big + rank[i0 + 2])
    total = len(i0) + len(sample)
    order = np.empty(total, np.int64)
    # Suffixes that agree on all that was compared may count one of their kind as smaller; no place is given twice.
    to = np.maximum.accumulate(before) + np.arange(len(i0))
    free = np.ones(total, bool)
    free[to] = False
    order[to] = i0
    order[free] = sample
    if wanted is not None:
        return order, rank
    # Neighbours share a rank if their symbols up to a sampled place agree and so do the ranks there.
    a, b = order[:-1], order[1:]
    ma, mb = a % 3, b % 3
    step = np.where((ma > 0) & (mb > 0), 0, np.where((ma != 2) & (mb != 2), 1, 2))
    agree = (step == 0) | (s[a] == s[b])
    agree &= (step < 2) | (s[a + 1] == s[b + 1])
    agree &= rank[np.minimum(a + step, n)] == rank[np.minimum(b + step, n)]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.r_[True, ~agree])
    return order, out


def suffix_order(symbols: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes, or of the wanted ones, in the order of their first ``depth`` symbols at least."""
    return _ordered(symbols.astype(np.int64), depth, wanted)[0]


def suffix_classes(texts: Strings, which: np.ndarray) -> np.ndarray:
    """Class of each 50-byte window of the strings: neighbours in suffix order whose first 50 bytes agree."""
    length = texts.shape.window
    sizes = texts.at[which + 1] - texts.at[which]
    to = np.cumsum(sizes + 1) - (sizes + 1)
    raw = np.zeros(int((sizes + 1).sum()) + 8, np.uint8)
    raw[expand(to, sizes)] = texts.data[expand(texts.at[which], sizes)]
    total = len(raw) - 8
    # Bytes get dense codes from 2 on; symbol 1 stands after each string.
    used = np.bincount(raw[:total], minlength=256) > 0
    symbols = (np.cumsum(used) + 1)[raw[:total]]
    symbols[to + sizes] = 1
    counts = sizes - length + 1
    number = np.full(len(symbols), -1, np.int64)
    places = expand(to, counts)
    number[places] = np.arange(len(places))
    order = suffix_order(symbols, length, number >= 0)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    equal = np.ones(max(len(order) - 1, 0), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        x = eight[order + k]
        equal &= x[1:] == x[:-1]
    out = np.empty(len(places), np.int64)
    out[number[order]] = np.cumsum(np.r_[True, ~equal]) if len(order) else order
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, minimiser: int = MINIMISER, keep_text: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and kept_bytes where asked for.

    Bytes covered by a string of ``length`` bytes (8 or more) that also starts in a document with a smaller doc_id go. A null text is
    empty. Rows without a doc_id keep all bytes and make no other row's go. Repeated rows, and different texts under one doc_id, don't
    repeat each other. Texts may be as long as Spark's strings; columns of other names play no part; an empty table stays empty.
    """
    shape = Shape(length, min(minimiser, length), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            data, offsets = flat_bytes(rows.column("text"))
            raw = data.tobytes()
            n_removed, n_spans, digest, kept = [], [], [], []
            for k, lists in enumerate(rows.column("spans").to_pylist()):
                text = raw[offsets[k] : offsets[k + 1]]
                starts, ends = merged(lists)
                if len(starts):
                    text = b"".join([text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)])
                n_removed.append(int((ends - starts).sum()))
                n_spans.append(len(starts))
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text)
            out = {"doc_id": rows.column("doc_id").combine_chunks(), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield from pa.table(out | ({"kept_bytes": pa.array(kept, pa.binary())} if keep_text else {})).to_batches()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_text
    return arrow_map(with_spans(docs, shape, suffix_classes, hot_runs), run, schema)
