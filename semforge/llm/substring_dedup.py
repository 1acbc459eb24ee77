"""Substring deduplication over words by super-k-mer partitioning.

Consecutive windows of 13 words that share a minimiser travel as one packed string, words joined by one blank, to the minimiser's
bucket. There windows are sorted by a hash of their bytes, and bytes decide which are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from semforge.llm.common import arrow_map, chunks, flat_bytes, prefix_hash, range_hash, word_bounds
from semforge.llm.superwindows import HOT_RUNS, Shape, Strings, merged, same, with_spans

WINDOW, MINIMISER = 13, 5


def sorted_windows(texts: Strings, which: np.ndarray) -> np.ndarray:
    """Class of each window of the strings: equal for equal words."""
    lo, hi = int(texts.at[which].min()), int(texts.at[which + 1].max())
    if hi - lo > 4 * int((texts.at[which + 1] - texts.at[which]).sum()):
        # The strings lie far apart: hash over a copy of them alone.
        from semforge.llm.common import expand
        from semforge.llm.superwindows import packed

        lengths = texts.at[which + 1] - texts.at[which]
        return sorted_windows(packed(texts.data[expand(texts.at[which], lengths)], np.r_[0, np.cumsum(lengths)], texts.shape), np.arange(len(which)))
    _, start, end = texts.window_ranges(which)
    sums, inverse = prefix_hash(texts.data[lo:hi])
    return same(texts.data, start, end - start, range_hash(sums, inverse, start - lo, end - lo))


def substring_dedup(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, keep_text: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, and kept_text where asked for.

    Words covered by a window that also starts in a document with a smaller doc_id go. A null text has no words. Rows without a doc_id
    keep all words and make no other row's go. Repeated rows, and different texts under one doc_id, don't repeat each other.
    Texts may be as long as Spark's strings; columns of other names play no part; an empty table stays empty.
    """
    shape = Shape(window, minimiser, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            data, offsets = flat_bytes(rows.column("text"))
            starts, ends, row = word_bounds(data, offsets)
            first = np.searchsorted(row, np.arange(len(offsets)))
            raw = data.tobytes()
            n_words, n_removed, digest, kept = [], [], [], []
            for k, lists in enumerate(rows.column("spans").to_pylist()):
                a, b = int(first[k]), int(first[k + 1])
                stay = np.ones(b - a, bool)
                for s, e in zip(*merged(lists), strict=True):
                    stay[s:e] = False
                if stay.all():
                    text = b" ".join(raw[offsets[k] : offsets[k + 1]].split())
                else:
                    at = np.flatnonzero(stay) + a
                    text = b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                n_words.append(b - a)
                n_removed.append(b - a - int(stay.sum()))
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text.decode())
            out = {"doc_id": rows.column("doc_id").combine_chunks(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield from pa.table(out | ({"kept_text": pa.array(kept, pa.string())} if keep_text else {})).to_batches()

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return arrow_map(with_spans(docs, shape, sorted_windows, hot_runs), run, schema)
