"""Media columns: lossless bytes in progressive JPEG, decoded to coefficient arrays and full-resolution RGB tensors.

A payload's bytes stand for the quantised DCT coefficients of a 4:2:0 image whose quantisers are 1, which is the format's unit that
survives exactly: bytes that texts have often are small coefficients, padding is zero. The image is coded in seven scans, with spectral selection and successive approximation; each MCU or block
is a restart interval of its own, so that all intervals of a batch of images are coded and decoded side by side in numpy, one
symbol of each at a time. Decoding accumulates scans into coefficient arrays, inverts the transform, repeats chroma and converts to
RGB. The inverse transform multiplies integers held in float64, which is exact, so results don't depend on the batch.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.llm.common import arrow_map, chunks, expand, flat_bytes, materialize

UNIT, PAD = 576, 255
MCU_BLOCKS = 6
#: (components, first and last coefficient, bit from, bit to) of each scan. Components 0, 1 and 2 are Y, Cb and Cr.
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 0, 0), ((0,), 1, 5, 1, 0), ((0, 1, 2), 0, 0, 1, 0))
#: Bytes in the order of their coefficients 0, 1, -1, 2, -2 ...: padding, blank and letters, what UTF-8 has of accented letters, capitals,
#: digits, then all others by number.
OFTEN = bytes([PAD]) + b" etnaiohrsdul\xc3cgbm.fwy,pvkqjxz\n" + bytes([*range(0xA0, 0xC0), *range(65, 91), *range(48, 58)])
#: Blocks of an MCU that belong to each component.
BLOCKS = {0: (0, 1, 2, 3), 1: (4,), 2: (5,)}
#: Payload bytes that are coded at once.
BATCH_BYTES = 1 << 19


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block, row by row, of each coefficient of the zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in order])


@lru_cache(2)
def huffman(dc: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The table as its DHT segment has it; code and length by symbol; (length << 8 | symbol) by the next 16 bits.

    Lengths follow a rule: sizes that text has often get short codes, all others the longest.
    """
    if dc:
        ranked = [(0, 2), (1, 2), (2, 2), *((s, s) for s in range(3, 8)), *((s, 10) for s in range(8, 12))]
    else:
        often = [(0x01, 2), (0x02, 2), (0x03, 2), (0x04, 3), (0x05, 5), (0x06, 5), (0x07, 6), (0x11, 6), (0x00, 7), *((s, 8) for s in (0x08, 0x12, 0x21, 0x31, 0x41))]
        seen = {s for s, _ in often}
        ranked = often + [(s, 16) for s in [0xF0, *(r << 4 | n for r in range(16) for n in range(1, 11))] if s not in seen]
    counts = bytes(sum(n == k for _, n in ranked) for k in range(1, 17))
    code, length, look = np.zeros(256, np.uint64), np.zeros(256, np.int64), np.zeros(1 << 16, np.uint16)
    at = last = 0
    for symbol, n in ranked:
        at <<= n - last
        last = n
        code[symbol], length[symbol] = at, n
        look[at << (16 - n) : (at + 1) << (16 - n)] = n << 8 | symbol
        at += 1
    return counts + bytes(s for s, _ in ranked), code, length, look


@lru_cache(1)
def coefficient_table() -> tuple[np.ndarray, np.ndarray]:
    """Coefficient of each byte; and the byte of each coefficient, from -128 to 128."""
    order = np.array([*OFTEN, *(b for b in range(256) if b not in OFTEN)])
    value = np.empty(256, np.int32)
    value[order] = [(k + 1) // 2 * (1 if k % 2 else -1) for k in range(256)]
    back = np.zeros(257, np.uint8)
    back[value + 128] = np.arange(256)
    return value, back


@lru_cache(1)
def _sized() -> tuple[np.ndarray, np.ndarray]:
    """Bits of the magnitude, and the bits that stand for the value, of -4096 .. 4095; the index is the value modulo 8192."""
    v = np.r_[0:4096, -4096:0]
    size = np.array([abs(int(x)).bit_length() for x in v], np.uint8)
    return size, np.where(v < 0, v + (1 << size.astype(np.int64)) - 1, v).astype(np.uint16)


def _coded(table: bool, run: np.ndarray | None, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and magnitude bits of values, and how many bits these are."""
    _, code, length, _ = huffman(table)
    sizes, bits = _sized()
    at = value & 8191
    size = sizes[at]
    symbol = size if run is None else (run.astype(np.uint8) << 4) | size
    return code[symbol] << size | bits[at], length[symbol] + size


def _segments(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in the order of their lanes to entropy-coded bytes, with stuffing and restart markers; and where each lane begins.

    ``first`` tells for each lane how many lanes of its image's scan come before it.
    """
    per = np.bincount(lane, bits, lanes).astype(np.int64)
    size = (per + 7) // 8
    begin = np.cumsum(size) - size
    total = int(size.sum())
    words = np.zeros(total // 4 + 3, np.uint64)
    before = np.cumsum(bits) - bits
    code_first = np.searchsorted(lane, np.arange(lanes))
    start = before[np.minimum(code_first, len(before) - 1)] if len(before) else np.zeros(lanes, np.int64)
    at = before - start[lane] + 8 * begin[lane]
    # Ones fill each lane's last byte.
    fill = 8 * size - per
    tail = np.flatnonzero(fill)
    for x, n, p in ((value, bits, at), ((np.uint64(1) << fill[tail].astype(np.uint64)) - np.uint64(1), fill[tail], 8 * begin[tail] + per[tail])):
        if not len(x):
            continue
        word, shift = p >> 5, 64 - (p & 31) - n
        y = x << shift.astype(np.uint64)
        cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        y, word = np.bitwise_or.reduceat(y, cut), word[cut]
        words[word] |= y >> np.uint64(32)
        words[word + 1] |= y & np.uint64(0xFFFFFFFF)
    raw = words.astype(">u4").view(np.uint8)[:total]
    full = raw == 255
    marks = (first > 0).astype(np.int64)
    mark_before = np.cumsum(marks)
    to = np.arange(total) + np.cumsum(full) - full + 2 * np.repeat(mark_before, size)
    out = np.zeros(total + int(full.sum()) + 2 * int(marks.sum()), np.uint8)
    out[to] = raw
    lane_at = begin + np.r_[0, np.cumsum(full)][begin] + 2 * (mark_before - marks)
    k = np.flatnonzero(marks)
    out[lane_at[k]] = 255
    out[lane_at[k] + 1] = 0xD0 + (first[k] - 1) % 8
    return out, np.r_[lane_at, len(out)]


def _code_scan(c: np.ndarray, scan: tuple, lanes_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One scan of a batch: c has (MCU, block, coefficient); lanes_of the number of MCUs of each image."""
    parts, lo, hi, high, low = scan
    own = sum(len(BLOCKS[p]) for p in parts) if lo == 0 else len(BLOCKS[parts[0]])
    if lo == 0:
        v = c[:, :, 0]
        lanes, first = len(c), expand(np.zeros(len(lanes_of), np.int64), lanes_of)
        lane = np.repeat(np.arange(lanes), own)
        if high:
            return _segments((v.ravel() & 1).astype(np.uint64), np.ones(v.size, np.int64), lane, lanes, first)
        v = v >> low
        diff = np.empty_like(v)
        for blocks in BLOCKS.values():
            part = v[:, list(blocks)]
            diff[:, list(blocks)] = np.diff(part, axis=1, prepend=0)
        return _segments(*_coded(True, None, diff.ravel()), lane, lanes, first)
    v = c[:, list(BLOCKS[parts[0]]), lo : hi + 1].reshape(-1, hi - lo + 1)
    lanes, first = len(v), expand(np.zeros(len(lanes_of), np.int64), lanes_of * own)
    _, code, length, _ = huffman(False)
    size_ = np.abs(v) >> low
    if high:
        # Codes of newly set coefficients carry the pending bits of those set before; the band is too short for long runs.
        values, bits = np.zeros((lanes, v.shape[1] + 1), np.uint64), np.zeros((lanes, v.shape[1] + 1), np.int64)
        run, pending, many = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
        for k in range(v.shape[1]):
            t = size_[:, k]
            run += t == 0
            old, new = t > 1, t == 1
            pending = np.where(old, pending << np.uint64(1) | (t & 1).astype(np.uint64), pending)
            many += old
            symbol = run << 4 | 1
            x = (code[symbol] << np.uint64(1) | (v[:, k] > 0).astype(np.uint64)) << many.astype(np.uint64) | pending
            values[:, k] = np.where(new, x, 0)
            bits[:, k] = np.where(new, length[symbol] + 1 + many, 0)
            run, many, pending = np.where(new, 0, run), np.where(new, 0, many), np.where(new, 0, pending)
        rest = (run > 0) | (many > 0)
        values[:, -1] = np.where(rest, code[0] << many.astype(np.uint64) | pending, 0)
        bits[:, -1] = np.where(rest, length[0] + many, 0)
        k = np.flatnonzero(bits)
        return _segments(values.ravel()[k], bits.ravel()[k], k // bits.shape[1], lanes, first)
    width = v.shape[1]
    at = np.flatnonzero(size_)
    lane, k = at // width, at % width
    value = v.ravel()[at] if not low else np.sign(v.ravel()[at]) * size_.ravel()[at]
    before = np.r_[-1, k[:-1]]
    before[np.r_[True, lane[1:] != lane[:-1]]] = -1
    run = k - before - 1
    codes = _coded(False, run & 15, value)
    long = run >> 4
    last = np.full(lanes, -1, np.int64)
    last[lane] = k
    open_ = last < width - 1
    events = np.bincount(lane, long + 1, lanes).astype(np.int64) + open_
    total = int(events.sum())
    values, bits = np.full(total, code[0xF0], np.uint64), np.full(total, length[0xF0], np.int64)
    open_before = np.cumsum(open_) - open_
    p = np.cumsum(long + 1) - 1 + open_before[lane]
    values[p], bits[p] = codes
    ends = (np.cumsum(events) - 1)[open_]
    values[ends], bits[ends] = code[0], length[0]
    return _segments(values, bits, np.repeat(np.arange(lanes), events), lanes, first)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(payload: int, mcus: int) -> tuple[bytes, int]:
    """All before the first scan, and the MCUs of the whole image."""
    across = -(-mcus // 4095)
    down = -(-mcus // across)
    frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, payload.to_bytes(8, "big")) + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC2, frame) + _segment(0xC4, b"\x00" + huffman(True)[0]) + _segment(0xC4, b"\x10" + huffman(False)[0]) + _segment(0xDD, b"\0\1"), across * down


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """The progressive JPEG of each payload."""
    heads, mcus = zip(*(_header(len(x), -(-len(x) // (64 * MCU_BLOCKS))) for x in payloads), strict=True)
    per = np.array(mcus, np.int64)
    flat = np.full(int(per.sum()) * 64 * MCU_BLOCKS, PAD, np.uint8)
    at = (np.cumsum(per) - per) * 64 * MCU_BLOCKS
    for x, p in zip(payloads, at.tolist(), strict=True):
        flat[p : p + len(x)] = x
    c = coefficient_table()[0][flat].reshape(-1, MCU_BLOCKS, 64)
    pieces: list[list[bytes]] = [[h] for h in heads]
    for scan in SCANS:
        parts, lo, hi, high, low = scan
        raw, lane_at = _code_scan(c, scan, per)
        own = 1 if lo == 0 else len(BLOCKS[parts[0]])
        cut = lane_at[np.r_[0, np.cumsum(per * own)]].tolist()
        head = _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in parts) + bytes([lo, hi, high << 4 | low]))
        whole = raw.tobytes()
        for k, mine in enumerate(pieces):
            mine += (head, whole[cut[k] : cut[k + 1]])
    return [b"".join([*x, b"\xff\xd9"]) for x in pieces]


class _Image:
    """The segments of one image within a batch's bytes."""

    def __init__(self, raw: bytes, begin: int, markers: list[int]) -> None:
        at = begin + 2
        self.scans: list[tuple[tuple, int, int]] = []
        self.tables: dict[int, bytes] = {}
        self.payload = self.down = self.across = 0
        if raw[begin:at] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while raw[at + 1] != 0xD9:
            kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xFE:
                self.payload = int.from_bytes(body, "big")
            elif kind == 0xC2:
                self.down, self.across = int.from_bytes(body[1:3], "big") // 16, int.from_bytes(body[3:5], "big") // 16
            elif kind == 0xC4:
                self.tables[body[0]] = body[1:]
            elif kind == 0xDD and body != b"\0\1":
                raise ValueError("restart intervals of one MCU are supported")
            elif kind == 0xDA:
                n = body[0]
                end = markers[bisect_left(markers, at)]
                self.scans.append(((tuple(body[1 + 2 * k] - 1 for k in range(n)), body[-3], body[-2], body[-1] >> 4, body[-1] & 15), at, end))
                at = end


def _lanes(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded stretches without stuffing and markers, padded; and the bit at which each restart interval begins."""
    a = np.array([x for x, _ in spans], np.int64)
    n = np.array([y - x for x, y in spans], np.int64)
    raw = data[expand(a, n)]
    begin = np.cumsum(n) - n
    after = np.r_[raw[1:], np.uint8(0)]
    full = raw == 255
    stuffed = np.r_[False, full[:-1]] & (raw == 0)
    mark = full & (after >= 0xD0) & (after <= 0xD7)
    keep = ~stuffed & ~mark & ~np.r_[False, mark[:-1]]
    place = np.r_[0, np.cumsum(keep)]
    starts = np.sort(np.concatenate([begin, np.flatnonzero(mark) + 2]))
    return np.concatenate([raw[keep], np.zeros(16, np.uint8)]), 8 * place[starts]


def _window(eight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next bits of each lane, at the top of 64; 57 of them at least are there."""
    return eight[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)


def _value(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    v = bits.astype(np.int64)
    return np.where((size > 0) & (v < (1 << np.maximum(size, 1) - 1)), v - (1 << size) + 1, v)


def _top(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits of each window, n at most 32."""
    return (x >> np.uint64(32)) >> (32 - n).astype(np.uint64)


def _read_scan(c: np.ndarray, scan: tuple, data: np.ndarray, at: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> None:
    """Adds one scan to the coefficients c of (MCU, block, coefficient)."""
    parts, lo, hi, high, low = scan
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    if lo == 0:
        last = {}
        for p in parts:
            for block in BLOCKS[p]:
                x = _window(eight, at)
                if high:
                    c[:, block, 0] |= ((x >> np.uint64(63)).astype(np.int32)) << low
                    at = at + 1
                    continue
                look = dc[(x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                n, size = look >> 8, look & 255
                last[p] = last.get(p, 0) + _value(_top(x << n.astype(np.uint64), size), size)
                c[:, block, 0] = last[p] << low
                at = at + n + size
        return
    blocks = list(BLOCKS[parts[0]])
    band = c[:, blocks, lo : hi + 1].reshape(-1, hi - lo + 1)
    width = band.shape[1]
    if high:
        at = at.copy()
        run, sign, state = (np.zeros(len(band), np.int64) for _ in range(3))  # state 0: a code is due; 1: a run is open; 2: only bits are left
        for k in range(width):
            due = np.flatnonzero(state == 0)
            if len(due):
                x = _window(eight, at[due])
                look = ac[(x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                n, symbol = look >> 8, look & 255
                end = (symbol & 15 == 0) & (symbol >> 4 < 15)
                one = symbol & 15 == 1
                sign[due] = np.where(one, np.where(_top(x << n.astype(np.uint64), np.ones_like(n)) > 0, 1, -1), 0)
                run[due] = symbol >> 4
                state[due] = np.where(end, 2, 1)
                at[due] += n + one
            old = band[:, k] != 0
            j = np.flatnonzero(old)
            bit = (_window(eight, at[j]) >> np.uint64(63)).astype(np.int32)
            band[j, k] += np.sign(band[j, k]) * (bit << low)
            at[j] += 1
            free = ~old & (state == 1)
            here = free & (run == 0)
            band[here, k] = (sign[here] << low).astype(np.int32)
            state[here] = 0
            run[free & ~here] -= 1
    else:
        lane, at, k = np.arange(len(band)), at.copy(), np.zeros(len(band), np.int64)
        flat = np.zeros(len(band) * width, np.int32)
        while len(lane):
            x = _window(eight, at)
            look = ac[(x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            n, size, run = look >> 8, look & 15, look >> 4 & 15
            k += run
            at += n + size
            some = size > 0
            if some.all():
                flat[lane * width + k] = _value(_top(x << n.astype(np.uint64), size), size) << low
            else:
                j = np.flatnonzero(some)
                flat[lane[j] * width + k[j]] = _value(_top(x[j] << n[j].astype(np.uint64), size[j]), size[j]) << low
                k[~some & (run < 15)] = width
            k += 1
            if (k >= width).any():
                go = k < width
                lane, at, k = lane[go], at[go], k[go]
        band = flat.reshape(-1, width)
    c[:, blocks, lo : hi + 1] = band.reshape(len(c), len(blocks), width)


@lru_cache(8)
def _looks(raw: bytes) -> np.ndarray:
    """(length << 8 | symbol) by the next 16 bits, from the body of a DHT segment."""
    look = np.zeros(1 << 16, np.uint16)
    at, k = 0, 16
    for n in range(1, 17):
        at <<= 1
        for _ in range(raw[n - 1]):
            look[at << (16 - n) : (at + 1) << (16 - n)] = n << 8 | raw[k]
            at += 1
            k += 1
    return look


def coefficients(media: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Coefficients (MCU, block, zigzag place) of all images, where each image's MCUs begin, and (payload, MCUs down, across) of each.

    Images of a batch share their tables and scans, as those that `encode` makes do.
    """
    raw = b"".join(media)
    data = np.frombuffer(raw, np.uint8)
    after = np.r_[data[1:], np.uint8(0)]
    markers = np.flatnonzero((data == 255) & (after != 0) & ((after < 0xD0) | (after > 0xD7))).tolist()
    begins = np.cumsum([0, *map(len, media)]).tolist()
    images = [_Image(raw, b, markers) for b in begins[:-1]]
    first = images[0]
    if any(x.tables != first.tables or [s[0] for s in x.scans] != [s[0] for s in first.scans] for x in images):
        raise ValueError("images of a batch must share tables and scans")
    per = np.array([x.down * x.across for x in images], np.int64)
    c = np.zeros((int(per.sum()), MCU_BLOCKS, 64), np.int32)
    dc, ac = _looks(first.tables[0]), _looks(first.tables[0x10])
    for k, (scan, _, _) in enumerate(first.scans):
        _read_scan(c, scan, *_lanes(data, [x.scans[k][1:] for x in images]), dc, ac)
    return c, np.r_[0, np.cumsum(per)], [(x.payload, x.down, x.across) for x in images]


@lru_cache(1)
def _basis() -> np.ndarray:
    """The two-dimensional inverse transform as one matrix of integers, from zigzag places to rows of samples, times 2**26."""
    k = np.arange(8)
    b = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    b[0] /= np.sqrt(2)
    b = np.round(b * 8192)
    return np.ascontiguousarray(np.kron(b, b)[zigzag()])


def samples(c: np.ndarray) -> np.ndarray:
    """(MCU, block, zigzag place) to 8-bit samples (MCU, block, row, column) by the inverse transform."""
    flat = c.reshape(-1, 64)
    out = np.empty(flat.shape, np.uint8)
    for a in range(0, len(flat), 2048):
        x = flat[a : a + 2048].astype(np.float64) @ _basis()
        x *= 1.0 / (1 << 26)
        x += 128.5
        np.clip(x, 0, 255, out=x)
        out[a : a + 2048] = x
    return out.reshape(len(c), MCU_BLOCKS, 8, 8)


@lru_cache(1)
def _chroma() -> tuple[np.ndarray, ...]:
    """What Cr adds to red, Cb and Cr to green, and Cb to blue, by sample: BT.601, rounded."""
    x = np.arange(256) - 128.0
    return tuple(np.round(f * x).astype(np.int16) for f in (1.402, -0.344136, -0.714136, 1.772))


def rgb(s: np.ndarray) -> np.ndarray:
    """Samples of MCUs to their RGB tensors (MCU, 16, 16, 3); chroma is repeated to full resolution."""
    out = np.empty((len(s), 16, 16, 3), np.uint8)
    red, green_b, green_r, blue = _chroma()
    for a in range(0, len(s), 256):
        part = s[a : a + 256]
        y = part[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16).astype(np.int16)
        cb, cr = part[:, 4], part[:, 5]
        for k, add in enumerate((red[cr], green_b[cb] + green_r[cr], blue[cb])):
            x = y + add.repeat(2, 1).repeat(2, 2)
            np.clip(x, 0, 255, out=x)
            out[a : a + 256, :, :, k] = x
    return out


def tensor(tiles: np.ndarray, down: int, across: int) -> np.ndarray:
    """RGB tensors of one image's MCUs to that of the image (rows, columns, 3)."""
    if across == 1:
        return tiles.reshape(16 * down, 16, 3)
    return tiles.reshape(down, across, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * down, 16 * across, 3)


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes and media; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, limit=BATCH_BYTES):
            data, offsets = flat_bytes(rows.column("text"))
            payloads = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                size = max(1, -(-int(b - a) // UNIT)) * UNIT
                payloads.append(np.concatenate([data[a:b], np.full(size - int(b - a), PAD, np.uint8)]))
            yield from pa.table({"doc_id": rows.column("doc_id").combine_chunks(), "n_bytes": pa.array(np.diff(offsets)), "media": pa.array(encode(payloads), pa.binary())}).to_batches()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


def decoded(media: DataFrame, keep_rgb: bool = False) -> DataFrame:
    """(doc_id, n_bytes, media) to what the stored bytes give back, and the RGB tensors (rgb, height, width) where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, text="media", limit=BATCH_BYTES):
            stored = rows.column("media").to_pylist()
            c, begin, about = coefficients(stored)
            tiles = rgb(samples(c))
            flat = coefficient_table()[1][c + 128]
            out: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rgb", "height", "width")}
            for k, (size, down, across) in enumerate(about):
                payload = flat[begin[k] : begin[k + 1]].ravel()[:size].tobytes()
                image = tensor(tiles[begin[k] : begin[k + 1]], down, across)
                total = [int(image[:, :, j].sum(dtype=np.int64)) for j in range(3)]
                raw = image.tobytes()
                out["payload_bytes"].append(size)
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(stored[k]))
                out["media_sha256"].append(hashlib.sha256(stored[k]).hexdigest())
                out["feature"].append(f"{image.shape[0]}x{image.shape[1]} sum {total[0]} {total[1]} {total[2]} crc {zlib.crc32(raw):08x}")
                if keep_rgb:
                    out["rgb"].append(raw)
                    out["height"].append(image.shape[0])
                    out["width"].append(image.shape[1])
            kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "rgb": pa.binary(), "height": pa.int32(), "width": pa.int32()}
            columns = {n: pa.array(v, kinds.get(n, pa.string())) for n, v in out.items() if keep_rgb or n not in ("rgb", "height", "width")}
            yield from pa.table({"doc_id": rows.column("doc_id").combine_chunks(), "n_bytes": rows.column("n_bytes").combine_chunks(), **columns}).to_batches()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(media, run, schema + ", rgb binary, height int, width int" * keep_rgb)


def media_columns(docs: DataFrame, keep_rgb: bool = False) -> DataFrame:
    """Stores every text as a JPEG column in the shared folder and computes features from the stored bytes, read back.

    Null and empty texts are one unit of 255; repeated rows give equal values; a null doc_id stays null; an empty table no rows. Other
    columns play no part. With ``keep_rgb`` the RGB tensors are columns too: twice the size of the payload.
    """
    stored, _ = materialize(encoded(docs), "media")
    return decoded(stored, keep_rgb)
