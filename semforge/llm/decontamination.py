"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk copies the character at its position, then moves on or stays as a random function of step and character says; it
maps a small edit distance to a small Hamming distance. A hash is some sampled steps of a walk. Walks start at every word of an item
and at every word of a document, and at every character of scripts that have no blanks, so an exact copy is found wherever it stands, and an edited one if one walk of any table runs
between its edits. Each walk has a table of its own. A collision stands for a window of the document as large as the item. It is kept
if the two agree around it on as many trigrams as the similarity asks for, and then verified by the exact edit distance between the
item and the best matching stretch of the window, for many at once.

Items of fewer than five words start few walks. Those of 24 bytes and more take more and shorter walks; shorter ones have too little text
for an edit distance to mean anything. All of them are also found as exact sequences of words, where each character of a script without
blanks is a word of its own.

Where the benchmark has many blocks, a task gathers documents and takes block after block over them, so that tables are built once for all
documents of a task's share, not for each chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.llm.common import SEPARATORS, arrow_map, chunks, expand, flat_bytes, mix, prefix_hash, range_hash, text_key, unwrapped, wrapped

#: Items of fewer words are also compared as sequences of words, and only so if they have fewer bytes than SHORT_BYTES. A character of
#: three bytes or more in UTF-8 counts as a word.
SIMILARITY, LEAST_WORDS, SHORT_BYTES = 0.8, 5, 24
WORD = "[\u0800-\U0010ffff]|[^ \u0800-\U0010ffff]+"
#: (steps of a walk, sampled steps, walks, most bytes of an item that uses them). Short items have few words to start at, and get short
#: walks too. Measured recall at a similarity of 0.81: 0.99 with edits at random places, 0.9 with edits as evenly spread as can be, which
#: leaves walks the least room (tests/llm/test_decontamination.py).
SCALES = ((18, 12, 10, 1 << 40), (15, 10, 4, 192), (12, 9, 3, 112), (9, 6, 4, 64))
#: Items are matched in blocks of this many bytes of text, and a pass over the documents takes so many blocks: what is broadcast is bounded.
BLOCK_BYTES, PASS_BLOCKS = 1 << 20, 64
#: Collisions whose distances are computed at once, and the most words of 64 characters of an item for that; longer ones go one by one, as
#: do those of which there are too few, for each word, to be worth arrays.
LANES, WORDS, FEW = 1 << 12, 16, 8
#: Bytes before and after a walk's start whose trigrams are compared, and how far they may have moved within them.
BEFORE, AFTER, DRIFT = 24, 56, 10
#: Bytes of text that are searched at once; those over which each of several blocks is taken; and walks that are made at once.
TEXT_BYTES, SHARE_BYTES = 1 << 20, 64 << 20
STARTS = 1 << 13
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[list(SEPARATORS)] = 32
#: Walks see 32 kinds of bytes: letters, the blank, and the rest dealt among them. Three fit in 15 bits.
_KIND = (np.arange(256) * 11 % 32).astype(np.uint16)
_KIND[97:123] = np.arange(26)
_KIND[32] = 26
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def trigrams(plain: np.ndarray) -> np.ndarray:
    """The kinds of the three bytes from each place on; after the end come zeros, as many as a walk may read."""
    kind = np.zeros(len(plain) + SCALES[0][0] + 3, np.uint16)
    kind[: len(plain)] = _KIND[plain]
    return kind[:-2] << np.uint16(10) | kind[1:-1] << np.uint16(5) | kind[2:]


@cache
def walk(steps: int, sampled: int, repeat: int) -> tuple[np.ndarray, ...]:
    """One array for every three steps: by trigram, how far they move (two bits) and a hash of what is sampled.

    For each kind of character one of the three steps at least moves on, so that no walk is stuck on a blank or a common letter.
    """
    random = np.random.default_rng([steps, repeat, 20240229])
    move = (random.integers(1, 8, (steps // 3, 1, 32)) >> np.arange(3)[:, None] & 1).reshape(steps, 32)
    chosen = set(random.choice(steps, sampled, replace=False).tolist())
    code = np.arange(1 << 15)
    out = []
    for t in range(0, steps, 3):
        at, seen = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.uint64)
        for k in range(t, t + 3):
            kind = code >> (10 - 5 * at) & 31
            if k in chosen:
                seen = seen * np.uint64(64) + kind.astype(np.uint64) + np.uint64(1)
            at = at + move[k][kind]
        out.append((mix(seen) & ~np.uint64(3)) | at.astype(np.uint64))
    return tuple(out)


def embed(codes: np.ndarray, starts: np.ndarray, steps: int, sampled: int, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the sampled characters of the walk from each start, and where it ends."""
    at, key = starts.astype(np.int64), np.zeros(len(starts), np.uint64)
    for table in walk(steps, sampled, repeat):
        step = table.take(codes.take(at))
        moved = step & np.uint64(3)
        at += moved.view(np.int64)
        step -= moved
        key *= _MULTIPLIER
        key += step
    return key, at


def distance(item: str, text: str, most: int) -> tuple[int, int]:
    """The least edit distance between the item and any stretch of the text, and where the best one ends; ``most`` + 1 if above."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    up, down, score, best, end = full, 0, m, most + 1, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(xh | up))
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(xv | plus))
        down = plus & xv
    return best, end


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each UTF-8 character starts, and its bytes as one integer."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.uint32)
    size = np.diff(np.r_[at, len(data)])
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return at, code


def _word_starts(plain: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    blank = plain == 32
    first = ~blank
    first[1:] &= blank[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(plain)]
    first[cuts] = ~blank[cuts]
    first |= plain >= 0xE0
    return np.flatnonzero(first)


def _tokens(plain: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word as ``WORD`` has them: characters of three bytes and more are words of their own."""
    if not len(plain):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = plain != 32
    # Whether each byte belongs to such a character: its first byte tells, and those after it follow.
    lead = (plain & 0xC0) != 0x80
    wide = (plain >= 0xE0)[np.maximum.accumulate(np.where(lead, np.arange(len(plain)), 0))]
    first = inner & lead & wide
    first[0] |= inner[0]
    first[1:] |= inner[1:] & lead[1:] & (~inner[:-1] | wide[:-1])
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(plain)]
    first[cuts] |= inner[cuts]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(offsets, starts, "right") - 1
    stops = np.r_[np.flatnonzero(~inner), len(plain)]
    blank = stops[np.searchsorted(stops, starts)]
    return starts, np.minimum(np.minimum(blank, np.r_[starts[1:], len(plain)]), offsets[rows + 1]), rows


class _Text:
    """A chunk of documents, and the hashes of their walks once they are asked for."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        data, self.offsets = flat_bytes(texts)
        self.plain = _PLAIN[data]
        self.codes = trigrams(self.plain)
        self.starts = _word_starts(self.plain, self.offsets)
        self.near: np.ndarray | None = None
        self.words: tuple[np.ndarray, ...] | None = None

    def around(self, at: np.ndarray) -> np.ndarray:
        """The trigrams around the places, and those within the drift."""
        if self.near is None:
            self.near = np.full(len(self.plain) + BEFORE + AFTER + 2 * DRIFT, 0xFFFE, np.uint16)
            self.near[BEFORE + DRIFT : BEFORE + DRIFT + len(self.plain)] = self.codes[: len(self.plain)]
        return np.lib.stride_tricks.sliding_window_view(self.near, BEFORE + AFTER + 2 * DRIFT)[at]

    def sequences(self) -> tuple[np.ndarray, ...]:
        if self.words is None:
            starts, ends, rows = _tokens(self.plain, self.offsets)
            self.words = starts, ends, rows, range_hash(*prefix_hash(self.plain), starts, ends)
        return self.words


def _sequence(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of each ``words`` words in a row."""
    n = max(0, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix(out * _MULTIPLIER + hashes[k : k + n])
    return out


class Tables:
    """LSH tables of one block of (item_id, items with that text, text), and their characters as bit masks."""

    def __init__(self, items: list[tuple]) -> None:
        items = [(i, n, _PLAIN[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-8", "replace")) for i, n, t in items]
        count = [len(re.findall(WORD, t)) for *_, t in items]
        self.short = [x for x, n in zip(items, count, strict=True) if 0 < n < LEAST_WORDS]
        self.items = [x for x, n in zip(items, count, strict=True) if n >= LEAST_WORDS or (n and len(x[2].encode()) >= SHORT_BYTES)]
        self._sequences()
        if not self.items:
            return
        data, offsets = flat_bytes(pa.array([t for *_, t in self.items], pa.string()))
        starts = _word_starts(data, offsets)
        rows = np.searchsorted(offsets, starts, "right") - 1
        self.length = np.array([len(t) for *_, t in self.items], np.int64)
        self.bytes = np.diff(offsets)
        self.most = np.array([int((1 - SIMILARITY) * n + 1e-9) for n in self.length.tolist()], np.int64)
        self.start_item, self.start_offset = rows, starts - offsets[rows]
        codes = trigrams(data)
        self.tables = []
        for steps, sampled, repeats, limit in SCALES:
            own = np.flatnonzero(self.bytes[rows] <= limit)
            for r in range(repeats):
                key, end = embed(codes, starts[own], steps, sampled, r)
                fits = own[end < offsets[rows[own] + 1]]
                key = key[end < offsets[rows[own] + 1]]
                if len(fits):
                    order = np.argsort(key, kind="stable")
                    # Most walks of a document meet nothing, which a table of one byte for a hash's first bits tells.
                    bits = 64 - max(20, int(len(fits)).bit_length() + 3)
                    met = np.zeros(1 << (64 - bits), bool)
                    met[(key >> np.uint64(bits)).astype(np.int64)] = True
                    self.tables.append((steps, sampled, r, key[order], fits[order], met, np.uint64(bits)))
        self._around(codes, starts, offsets[rows], offsets[rows + 1])
        self._masks()

    def _sequences(self) -> None:
        """The items of few words by their number of words: hash of the sequence and item."""
        self.sequences: dict[int, dict[int, list[int]]] = {}
        for k, (*_, t) in enumerate(self.short):
            data = np.frombuffer(t.encode(), np.uint8)
            starts, ends, _ = _tokens(data, np.array([0, len(data)]))
            key = int(_sequence(range_hash(*prefix_hash(data), starts, ends), len(starts))[0])
            self.sequences.setdefault(len(starts), {}).setdefault(key, []).append(k)

    def _around(self, codes: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """The item's trigrams around each start, and how many of them a text of the similarity has at least."""
        place = starts[:, None] + np.arange(-BEFORE, AFTER)
        inside = (place >= lo[:, None]) & (place < hi[:, None] - 2)
        self.near = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], np.uint16(0xFFFF))
        length = np.minimum(starts + AFTER, hi) - np.maximum(starts - BEFORE, lo)
        # An edit takes three trigrams away at most.
        self.least = np.floor(np.count_nonzero(inside, axis=1) - 3 * (1 - SIMILARITY) * length).astype(np.int64)

    def _masks(self) -> None:
        """For each item and character the positions that have it, 64 to a word, and where these words are; first come words without bits."""
        self.words = (self.length + 63) // 64
        codes = [_characters(np.frombuffer(t.encode(), np.uint8))[1] for *_, t in self.items]
        self.alphabet = np.unique(np.concatenate(codes))
        size = len(codes) * (len(self.alphabet) + 1)
        pairs, masks, used = [], [np.zeros(int(self.words.max()), np.uint64)], int(self.words.max())
        for k, code in enumerate(codes):
            bits = np.zeros(int(self.words[k]) * 64, np.uint8)
            for c in np.unique(code).tolist():
                bits[: len(code)] = code == c
                pairs.append((k * (len(self.alphabet) + 1) + int(np.searchsorted(self.alphabet, c)), used))
                masks.append(np.packbits(bits, bitorder="little").view(np.uint64))
                used += len(masks[-1])
        self.mask = np.concatenate(masks)
        self.pair, self.base = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.dense = None
        if size <= 1 << 22:
            self.dense = np.zeros(size, np.int64)
            self.dense[self.pair] = self.base

    def _bases(self, k: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the words of an item's character are."""
        pair = k * (len(self.alphabet) + 1) + symbol
        if self.dense is not None:
            return self.dense[pair]
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.base[at], 0)

    def _distances(self, symbols: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray | int, length: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``distance`` of ``length`` characters of items, from word ``first`` on, to stretches of symbols; longest stretch first.

        All take the same number of words. Each step takes the next symbol of every stretch.
        """
        words, one = int(length[0] + 63) // 64, np.uint64(1)
        n = len(k)
        up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
        top = ((length - 1) % 64).astype(np.uint64)
        score = length.copy()
        best, end = np.minimum(most + 1, length), np.zeros(n, np.int64)
        active = np.searchsorted(-(hi - lo), -np.arange(1, int((hi - lo)[0]) + 1), "right")
        for j, m in enumerate(active.tolist()):
            base = self._bases(k[:m], symbols[lo[:m] + j])
            base += first if isinstance(first, int) else first[:m]
            plus_in, minus_in = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            for w in range(words):
                eq, pv, mv = self.mask.take(base + w if w else base), up[w, :m], down[w, :m]
                xv = eq | mv
                eq |= minus_in
                xh = eq & pv
                xh += pv
                xh ^= pv
                xh |= eq
                plus = ~(xh | pv)
                plus |= mv
                minus = pv & xh
                shift = top[:m] if w == words - 1 else np.uint64(63)
                plus_out, minus_out = plus >> shift & one, minus >> shift & one
                plus <<= one
                plus |= plus_in
                minus <<= one
                minus |= minus_in
                np.bitwise_or(minus, ~(xv | plus), out=pv)
                np.bitwise_and(plus, xv, out=mv)
                plus_in, minus_in = plus_out, minus_out
            score[:m] += plus_in.astype(np.int64) - minus_in.astype(np.int64)
            less = np.flatnonzero(score[:m] < best[:m])
            best[less] = score[less]
            end[less] = j + 1
        return best, end

    def _possible(self, symbols: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, early: np.ndarray, late: np.ndarray) -> np.ndarray:
        """Whether the least distances of an item's pieces of 64 characters, each near its place, come to no more than the item may have.

        By its collisions the item starts between ``early`` and ``late``, give or take its edits.
        """
        owner = np.repeat(np.arange(len(k)), self.words[k])
        word = expand(np.zeros(len(k), np.int64), self.words[k])
        n, most = self.length[k][owner], self.most[k][owner]
        length = np.minimum(64, n - 64 * word)
        a = np.clip(early[owner] + 64 * word - most, lo[owner], hi[owner])
        b = np.clip(late[owner] + 64 * word + length + most, a, hi[owner])
        order = np.argsort(a - b, kind="stable")
        total = np.zeros(len(k), np.int64)
        for x in range(0, len(order), LANES):
            o = order[x : x + LANES]
            d = self._distances(symbols, k[owner[o]], a[o], b[o], word[o], length[o], length[o])[0] if (b[o[0]] > a[o[0]]) else length[o]
            np.add.at(total, owner[o], d)
        return total <= self.most[k]

    def collisions(self, text: _Text) -> tuple[np.ndarray, np.ndarray]:
        """Start in the text and start of an item of each pair whose walks of one table meet, once each."""
        found = [np.zeros(0, np.int64)]
        total = len(self.start_item)
        for a in range(0, len(text.starts), STARTS):
            starts = text.starts[a : a + STARTS]
            for steps, sampled, r, keys, item, met, bits in self.tables:
                got, _ = embed(text.codes, starts, steps, sampled, r)
                hit = np.flatnonzero(met[(got >> bits).view(np.int64)])
                lo = np.searchsorted(keys, got[hit], "left")
                count = np.searchsorted(keys, got[hit], "right") - lo
                found.append(np.repeat(a + hit, count) * total + item[expand(lo, count)])
        pairs = np.sort(np.concatenate(found))
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        return text.starts[pairs // total], pairs % total

    def alike(self, text: _Text, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether text and item share as many trigrams around a collision as the similarity asks for, each near its place."""
        out = np.empty(len(at), bool)
        width = BEFORE + AFTER
        for a in range(0, len(at), 512):
            have, want = (np.ascontiguousarray(x.T) for x in (text.around(at[a : a + 512]), self.near[start[a : a + 512]]))
            found, same = np.zeros(want.shape, bool), np.empty(want.shape, bool)
            for d in range(2 * DRIFT + 1):
                np.equal(have[d : d + width], want, out=same)
                found |= same
            out[a : a + 512] = found.view(np.uint8).sum(axis=0, dtype=np.uint8) >= self.least[start[a : a + 512]]
        return out

    def matches(self, text: _Text) -> list[tuple[int, tuple, int, int, int]]:
        """(row, item, edit distance, characters of the item, byte at which the stretch ends) of each pair within the bound, once each."""
        out = self._exact(text)
        if not self.items or not len(text.plain):
            return out
        at, start = self.collisions(text)
        near = self.alike(text, at, start)
        at, start = at[near], start[near]
        row, k = np.searchsorted(text.offsets, at, "right") - 1, self.start_item[start]
        begin = np.clip(at - self.start_offset[start], text.offsets[row], text.offsets[row + 1])
        order = np.lexsort((begin, k, row))
        row, k, begin = row[order], k[order], begin[order]
        # Bytes around the collisions of a document and an item, joined where they meet; taken out of the text so many at once.
        slack = self.most[k] + self.length[k] // 16 + 8
        lo, hi = np.maximum(begin - 4 * slack, text.offsets[row]), np.minimum(begin + self.bytes[k] + 4 * slack, text.offsets[row + 1])
        new = np.r_[True, (row[1:] != row[:-1]) | (k[1:] != k[:-1]) | (lo[1:] > hi[:-1])] if len(row) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        sizes = hi[np.r_[first[1:] - 1, len(hi) - 1]] - lo[first] if len(first) else first
        part = np.cumsum(sizes) >> 22
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + 1])
            own = slice(first[a], first[b] if b < len(first) else len(row))
            out += self._verified(text, lo[first[a:b]], sizes[a:b], group[own] - a, row[own], k[own], begin[own], slack[own])
        best: dict[tuple, tuple] = {}
        for m in out:
            if (m[0], m[1][0], m[1][2]) not in best or m[2:] < best[m[0], m[1][0], m[1][2]][2:]:
                best[m[0], m[1][0], m[1][2]] = m
        return list(best.values())

    def _verified(self, text: _Text, lo: np.ndarray, sizes: np.ndarray, group: np.ndarray, row: np.ndarray, k: np.ndarray, begin: np.ndarray, slack: np.ndarray) -> list[tuple]:
        """Matches among the collisions whose bytes the stretches (lo, sizes) hold; ``group`` is a collision's stretch."""
        place = expand(lo, sizes)
        plain = text.plain[place]
        at, code = _characters(plain)
        symbols = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[symbols] == code, symbols, len(self.alphabet))
        edges = np.r_[0, np.cumsum(sizes)]
        begin = np.searchsorted(at, edges[group] + begin - lo[group])
        edges = np.searchsorted(at, edges)
        lo, hi = np.maximum(begin - slack, edges[group]), np.minimum(begin + self.length[k] + slack, edges[group + 1])
        order = np.lexsort((lo, group))
        row, k, lo, hi, group, begin = (x[order] for x in (row, k, lo, hi, group, begin))
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (lo[1:] > hi[:-1])])
        late = np.r_[new[1:] - 1, len(hi) - 1]
        hi, row, k, lo, early, late = hi[late], row[new], k[new], lo[new], begin[new], begin[late]
        # Long stretches are cut into pieces that overlap by more than a match.
        over = self.length[k] + self.most[k]
        count = np.maximum(1, -(-(hi - lo - over) // over))
        piece = expand(np.zeros(len(k), np.int64), count)
        row, k, lo, hi, over, early, late, cut = (np.repeat(x, count) for x in (row, k, lo, hi, over, early, late, count > 1))
        lo = lo + piece * over
        hi = np.minimum(hi, lo + 2 * over)
        early, late = np.where(cut, lo, early), np.where(cut, hi - self.length[k], late)
        keep = self._possible(symbols, k, lo, hi, early, late)
        row, k, lo, hi = row[keep], k[keep], lo[keep], hi[keep]
        d, end = self.most[k] + 1, np.zeros(len(k), np.int64)
        order = np.lexsort((lo - hi, self.words[k]))
        after = np.r_[at, len(plain)]
        cuts = np.flatnonzero(np.diff(self.words[k[order]])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            words = int(self.words[k[part[0]]])
            if words > WORDS or len(part) <= FEW * words:
                for x in part.tolist():
                    stretch = plain[after[lo[x]] : after[hi[x]]].tobytes().decode("utf-8", "replace")
                    d[x], end[x] = distance(self.items[k[x]][2], stretch, int(self.most[k[x]]))
                continue
            for a in range(0, len(part), LANES):
                x = part[a : a + LANES]
                d[x], end[x] = self._distances(symbols, k[x], lo[x], hi[x], 0, self.length[k[x]], self.most[k[x]])
        out = []
        for x in np.flatnonzero(d <= self.most[k]).tolist():
            last = int(place[after[lo[x] + end[x]] - 1]) + 1 - int(text.offsets[row[x]])
            out.append((int(row[x]), self.items[k[x]], int(d[x]), int(self.length[k[x]]), last))
        return out

    def _exact(self, text: _Text) -> list[tuple]:
        """The items of few words, wherever a document has their words in a row."""
        out = []
        for words, keys in self.sequences.items():
            starts, ends, rows, hashes = text.sequences()
            got = _sequence(hashes, words)
            hit = np.flatnonzero(np.isin(got, np.array(list(keys), np.uint64)) & (rows[: len(got)] == rows[words - 1 :]))
            seen = set()
            for w in hit.tolist():
                have = [text.plain[starts[w + j] : ends[w + j]].tobytes() for j in range(words)]
                for k in keys[int(got[w])]:
                    row, item = int(rows[w]), self.short[k]
                    if (row, k) not in seen and [x.encode() for x in re.findall(WORD, item[2])] == have:
                        seen.add((row, k))
                        out.append((row, item, 0, len(item[2]), int(ends[w + words - 1] - text.offsets[row])))
        return out


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item_id and class_id of every row of the benchmark: the smallest item_id with the same text, cases and kinds of separators apart."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), _plain_text().alias("plain")).withColumn("class_id", F.expr("min(item_id) OVER (PARTITION BY plain)")).select("item_id", F.when(F.col("plain").isNotNull(), F.col("class_id")).alias("class_id"))


def _plain_text():
    upper = "".join(map(chr, range(65, 91)))
    return F.translate("text", upper + SEPARATORS.decode(), upper.lower() + " " * len(SEPARATORS))


def _passes(spark, benchmark: DataFrame, least_words: int) -> Iterator[list]:
    """Distinct items in broadcast blocks of bounded size, and so many blocks at once as a pass over the documents takes."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _plain_text().alias("text")).groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))
    asked = asked.filter(F.regexp_count("text", F.lit(WORD)) >= least_words)
    held, block, size = [], [], 0
    for r in asked.toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_BYTES:
            held.append(spark.sparkContext.broadcast(block))
            block, size = [], 0
            if len(held) == PASS_BLOCKS:
                yield held
                held = []
        block.append((r["item_id"], r["n"], r["text"]))
        size += len(r["text"])
    if block:
        held.append(spark.sparkContext.broadcast(block))
    if held:
        yield held


#: Items and tables of the block that this Python worker built last: the worker's next task may begin with the same.
_LAST: list = [None, None]


def _tables(block) -> Tables:
    items = block.value
    if _LAST[0] is not items:
        _LAST[:] = [None, None]
        _LAST[:] = [items, Tables(items)]
    return _LAST[1]


def _searched(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[tuple[pa.Table, list[tuple]]]:
    """Each chunk of a task's documents with its matches in all blocks of a pass.

    One block is held against the chunks as they come. Of several, each is built once for SHARE_BYTES of text, and the last one first in
    every second share.
    """
    if len(held) == 1:
        tables = None
        for part in chunks(batches, limit=TEXT_BYTES):
            tables = tables or _tables(held[0])
            yield part, tables.matches(_Text(part.column("text")))
        return
    turn = 1
    for share in chunks(batches, limit=SHARE_BYTES):
        parts = list(chunks(iter(share.combine_chunks().to_batches()), limit=TEXT_BYTES))
        found: list[list[tuple]] = [[] for _ in parts]
        for block in held[::turn]:
            tables = _tables(block)
            for part, out in zip(parts, found, strict=True):
                out += tables.matches(_Text(part.column("text")))
        turn = -turn
        yield from zip(parts, found, strict=True)


def leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, n_items, distance, similarity, end_byte, key) of each document that holds an item with similarity 0.8 or more.

    Similarity is 1 - edit distance / length of the item, after lower-casing A-Z and turning separators into blanks. Items of one to four
    words also match where a document has the same words in a row, those of under 24 bytes only there; those of fewer than ``least_words``, and null and empty ones, match
    nothing; null and empty texts hold nothing. Items with one text are one: it goes by their smallest item_id, ``n_items`` tells how many
    they are, and ``item_classes`` which. Other columns of either table play no part, whatever they are called. ``key`` tells rows with
    one doc_id and different texts apart. Whole texts are searched; the benchmark is the query set, and a pass over the documents takes
    up to 64 blocks of 1 MB of it.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_items long, distance int, similarity double, end_byte long, key long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    out = None
    for held in _passes(spark, benchmark, least_words):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part, found in _searched(batches, held):
                ids, keys = part.column("doc_id").to_pylist(), part.column("key").to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([ids[r] for r, *_ in found], pa.int64()),
                        "item_id": pa.array([item[0] for _, item, *_ in found], pa.int64()),
                        "n_items": pa.array([item[1] for _, item, *_ in found], pa.int64()),
                        "distance": pa.array([d for _, _, d, _, _ in found], pa.int32()),
                        "similarity": pa.array([1 - d / n for _, _, d, n, _ in found], pa.float64()),
                        "end_byte": pa.array([e for *_, e in found], pa.int64()),
                        "key": pa.array([keys[r] for r, *_ in found], pa.int64()),
                    }
                )

        one = arrow_map(rows, run, schema)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], schema) if out is None else out


def leaked_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_items, distance, similarity and end_byte of each leak; clean documents have no row."""
    return leaks(docs, benchmark).select("doc_id", "item_id", "n_items", "distance", "similarity", "end_byte").distinct()


def drop_leaked(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows that hold no benchmark item of ``least_words`` words or more, with all their columns, whatever they are called.

    A document isn't condemned for a phrase of one to four words, which many clean ones have too, unless ``least_words`` says so.
    """
    out = wrapped(docs, text=F.col("text"))
    schema = out.schema
    for held in _passes(docs.sparkSession, benchmark, least_words):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part, found in _searched(batches, held):
                bad = {r for r, *_ in found}
                clean = part.filter(pa.array([k not in bad for k in range(len(part))])) if bad else part
                yield from clean.combine_chunks().to_batches()

        out = arrow_map(out, run, schema)
    return unwrapped(out)
