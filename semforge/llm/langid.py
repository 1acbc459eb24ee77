"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled texts by language; the matrix of log-probabilities, of languages x BUCKETS, is broadcast. Scoring
adds up matrix rows for a whole batch of texts in numpy. Nothing but the text enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semforge.llm.common import arrow_map, chunks, delete, expand, extended, flat_bytes, materialize, mix, partitions, unwrapped, wrapped

#: n-gram orders; the buckets that their hashes fall into; and the labels that are learnt at most, those with the most labelled rows, ties
#: by code point. Both are fixed, so the matrix that is broadcast has 2^24 entries at most, and labels beyond change nothing for others.
ORDERS, BUCKETS, LANGUAGES = (1, 2, 3), 1 << 15, 512
#: The classifier is fitted on about so many labelled rows of each language at most; everything else covers all rows.
FIT_ROWS = 3000
UND = "und"
PLANES = 0x40000
#: Evidence of this many n-grams at most counts, so that long texts keep scores below 1.
EVIDENCE = 200.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    #: Buckets x languages.
    log_prob: np.ndarray


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first four planes, which hold all letters: whether it is one, and its lower-case form."""
    points = [chr(i) for i in range(PLANES)]
    letter = np.array([c.isalpha() for c in points])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(points)], np.uint32)
    return letter, lower


def _code_points(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts with a blank before each and one at the end, and where each text's blank is."""
    data, offsets = flat_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) if len(data) else np.zeros(0, np.uint32)
    # A text starts where its first byte that begins a character starts.
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    starts = begins[offsets[:-1]]
    return np.insert(points, starts, 32) if len(starts) else points, starts + np.arange(len(starts))


def grams(column: pa.ChunkedArray, width: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each character, one array for each order; where texts start; letters of each text."""
    letter, lower = _tables()
    points, starts = _code_points(column)
    inside = np.minimum(points, PLANES - 1)
    is_letter = letter[inside]
    ends = np.r_[starts[1:], len(points)]
    cum = np.r_[0, np.cumsum(is_letter)]
    # All that isn't a letter is one kind of gap: digits, marks and blanks tell nothing of a language.
    plain = np.where(is_letter, lower[inside], np.uint32(32)).astype(np.uint64)
    out = []
    for n in ORDERS:
        key = plain.copy()
        for k in range(1, n):
            key[:-k] = key[:-k] * np.uint64(0x110001) + plain[k:]
        out.append((mix(key + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(width - 1)).astype(np.int32))
    return out, starts, cum[ends] - cum[starts]


def training_rows(docs: DataFrame, most: int = FIT_ROWS) -> tuple[DataFrame, str]:
    """Labelled texts, about ``most`` of each language at most, chosen by a hash: the same rows on every run; and the table that is read."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # A row for each language, written so that Spark knows its size: it broadcasts the table below its own threshold.
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts, path = materialize(counts.select("lang", F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")).alias("share")), "languages")
    rows = labelled.join(counts, "lang").filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    return rows.select("text", "lang"), path


def fit(docs: DataFrame, most: int = FIT_ROWS) -> Model:
    """Learns from text and lang. Counts of each n-gram bucket are summed on the executors; the driver gets one matrix, bounded in size."""
    rows, path = training_rows(docs, most)
    width = BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in chunks(batches, limit=1 << 20):
            ids, starts, _ = grams(part.column("text"), width)
            ends = np.r_[starts[1:], len(ids[0])]
            names, which = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            by = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[by], np.arange(len(names) + 1))
            for k, name in enumerate(names.tolist()):
                own = by[cuts[k] : cuts[k + 1]]
                places = expand(starts[own], ends[own] - starts[own])
                held = sums.setdefault(name, np.zeros(width + 1))
                for x in ids:
                    held[:width] += np.bincount(x[places], minlength=width)
                held[width] += len(own)
            if len(sums) > LANGUAGES // 4:
                yield _counted(sums)
                sums = {}
        yield _counted(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by language: one sum at a time.
        name, held = None, None
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if lang != name and held is not None:
                    yield _counted({name: held})
                    held = None
                name, held = lang, np.frombuffer(raw) + (0 if held is None else held)
        if held is not None:
            yield _counted({name: held})

    parts = arrow_map(rows, count, "lang string, counts binary")
    # One row for each task and language; they are added up before the driver gets them, one for each language.
    summed = arrow_map(parts.repartition(partitions(docs), "lang").sortWithinPartitions("lang"), add, "lang string, counts binary")
    found = [(r["lang"], np.frombuffer(r["counts"]).astype(np.float32)) for r in summed.toLocalIterator()]
    delete(docs.sparkSession, path)
    if not found:
        return Model((), np.zeros(0), np.zeros((width, 0), np.float32))
    found.sort(key=lambda x: x[0])
    seen = np.array([x[width] for _, x in found], float)
    prob = np.stack([x[:width] for _, x in found], 1) + np.float32(0.5)
    return Model(tuple(x for x, _ in found), np.log(seen / seen.sum()), np.log(prob / prob.sum(0, dtype=float)).astype(np.float32))


def _counted(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})


def score(texts: pa.ChunkedArray, model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its probability, 0 to 1. A null text or one without letters is `und` with 0."""
    n = len(texts)
    rows = max(1, (1 << 22) // max(1, len(model.languages)))
    if n > rows:
        parts = [score(texts.slice(k, rows), model) for k in range(0, n, rows)]
        return [x for lang, _ in parts for x in lang], np.concatenate([p for _, p in parts])
    ids, starts, letters = grams(texts, len(model.log_prob))
    known = (letters > 0) & bool(model.languages)
    out, probability = np.full(n, UND, object), np.zeros(n)
    if known.any():
        sums = np.zeros((n, len(model.languages)))
        # Blocks keep the gathered rows in the cache; a text that lies in several gets their sum.
        block = max(1 << 10, (1 << 18) // len(model.languages))
        total = len(ids[0])
        for at in range(0, total, block):
            to = min(total, at + block)
            first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, to, "left")
            cuts = np.maximum(starts[first:last], at) - at
            for x in ids:
                sums[first:last] += np.add.reduceat(model.log_prob[x[at:to]], cuts, axis=0, dtype=np.float64)
        lengths = np.diff(np.r_[starts, total]).astype(float)
        sums *= np.minimum(1.0, EVIDENCE / np.maximum(lengths, 1))[:, None]
        sums += model.log_prior * 0.1
        sums -= sums.max(1, keepdims=True)
        weights = np.exp(sums)
        weights /= weights.sum(1, keepdims=True)
        best = weights.argmax(1)
        out = np.where(known, np.array(model.languages, object)[best], UND)
        probability = np.where(known, weights[np.arange(n), best], 0.0)
    return out.tolist(), probability


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to every row, whatever its other columns. Empty tables stay empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, limit=1 << 20):
            lang, p = score(rows.column("text"), held.value)
            yield from rows.select(names).append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(p)).combine_chunks().to_batches()

    schema = extended(docs.schema, lang_pred=T.StringType(), score=T.DoubleType())
    return arrow_map(docs, run, schema)


def held_out() -> F.Column:
    """crc32 of the doc_id as text, modulo 4, is 2. A null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learnt from those that aren't held out.

    Null doc_ids, texts and langs are kept as rows; repeated rows get equal results; without a labelled row all are `und`, and an empty
    table stays empty. Up to LANGUAGES labels are learnt. The evidence of a text counts as that of EVIDENCE n-grams at most and the prior
    a tenth, so that scores of long texts stay below 1. Columns of other names play no part.
    """
    model = fit(docs.filter(~held_out()), most)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4, most: int = FIT_ROWS) -> DataFrame:
    """The rows whose language is known: not `und`, and with a score of at least ``least``. Other columns may have any name."""
    out = identify(wrapped(docs, text=F.col("text")), fit(docs.filter(~held_out()), most))
    return unwrapped(out.filter((F.col("lang_pred") != UND) & (F.col("score") >= least)))
