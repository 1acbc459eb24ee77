"""Any progressive or sequential JPEG to coefficient arrays and a full-resolution RGB tensor.

Scans add spectral bands and bits of precision to one coefficient array for each component; the inverse transform, the upsampling of
chroma and the conversion to RGB are numpy over whole components. Only the entropy-coded bits are read one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semforge.llm.common import arrow_map, extended, unwrapped, wrapped
from semforge.llm.media import _basis, _chroma


class JpegError(ValueError):
    """A stream that isn't a JPEG of Huffman-coded 8-bit samples."""


class _Bits:
    """The bits of one restart interval, after which come zeros."""

    def __init__(self, raw: bytes) -> None:
        self.data, self.at = raw.replace(b"\xff\x00", b"\xff"), 0

    def peek16(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 3].ljust(3, b"\0"), "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek16() >> (16 - n)
        self.at += n
        return out

    def symbol(self, table: np.ndarray) -> int:
        found = int(table[self.peek16()])
        if not found:
            raise JpegError("no such code")
        self.at += found >> 8
        if self.at > 8 * len(self.data) + 64:
            raise JpegError("a scan ends too early")
        return found & 255

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@dataclass
class _Component:
    across: int
    down: int
    quantiser: int
    wide: int = 0
    high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    last: int = 0


def _lookup(body: bytes) -> np.ndarray:
    """(length << 8 | symbol) by the next 16 bits."""
    look, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        code <<= 1
        for _ in range(body[n - 1]):
            look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[at]
            code += 1
            at += 1
    return look


class Decoder:
    """Segments of one image, and the coefficients of its components (block row, block column, zigzag place) once read."""

    def __init__(self, raw: bytes) -> None:
        if raw[:2] != b"\xff\xd8":
            raise JpegError("not a JPEG")
        self.components: dict[int, _Component] = {}
        self.tables: dict[int, np.ndarray] = {}
        self.quantisers: dict[int, np.ndarray] = {}
        self.width = self.height = self.interval = 0
        self.progressive, self.transform = False, True
        at = 2
        try:
            while (kind := raw[at + 1]) != 0xD9:
                if raw[at] != 255:
                    raise JpegError("a marker is missing")
                if kind == 0xFF:
                    at += 1
                    continue
                size = int.from_bytes(raw[at + 2 : at + 4], "big")
                body = raw[at + 4 : at + 2 + size]
                at += 2 + size
                if kind == 0xDA:
                    at = self._scan(body, raw, at)
                else:
                    self._segment(kind, body)
        except IndexError:
            raise JpegError("the image ends too early") from None
        if not self.components:
            raise JpegError("there is no frame")

    def _segment(self, kind: int, body: bytes) -> None:
        if kind in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise JpegError("samples have 8 bits")
            self.progressive = kind == 0xC2
            self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                name, factors, quantiser = body[6 + 3 * k : 9 + 3 * k]
                self.components[name] = _Component(factors >> 4, factors & 15, quantiser)
            self.most_across, self.most_down = max(c.across for c in self.components.values()), max(c.down for c in self.components.values())
            self.mcus = -(-self.width // (8 * self.most_across)), -(-self.height // (8 * self.most_down))
            for c in self.components.values():
                c.wide, c.high = -(-self.width * c.across // (8 * self.most_across)), -(-self.height * c.down // (8 * self.most_down))
                c.blocks = np.zeros((self.mcus[1] * c.down, self.mcus[0] * c.across, 64), np.int32)
        elif 0xC3 <= kind <= 0xCF and kind != 0xC4 and kind != 0xCC:
            raise JpegError("only sequential and progressive Huffman coding")
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                self.tables[body[0]] = _lookup(body[1:n])
                body = body[n:]
        elif kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], f">u{wide}").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xDD:
            self.interval = int.from_bytes(body, "big")
        elif kind == 0xEE and body[:5] == b"Adobe":
            self.transform = body[11] != 0

    def _scan(self, body: bytes, raw: bytes, at: int) -> int:
        """Reads one scan; returns where the next segment begins."""
        own = [(self.components[body[1 + 2 * k]], body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])]
        lo, hi, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
        pieces, begin = [], at
        while True:
            at = raw.index(b"\xff", at)
            if raw[at + 1] == 0:
                at += 2
            elif 0xD0 <= raw[at + 1] <= 0xD7:
                pieces.append(raw[begin:at])
                at += 2
                begin = at
            else:
                pieces.append(raw[begin:at])
                break
        places = self._places(own)
        step = self.interval or max(1, len(places))
        for k in range(0, len(places), step):
            bits, self.run = _Bits(pieces[k // step]), 0
            for c, _, _ in own:
                c.last = 0
            for mcu in places[k : k + step]:
                for which, row, column in mcu:
                    c, dc, ac = own[which]
                    self._block(bits, c, c.blocks[row, column], dc, ac, lo, hi, high, low)
        return at

    def _places(self, own: list) -> list[list[tuple[int, int, int]]]:
        """(component, block row, block column) of each block, by MCU; the blocks of a component alone are each an MCU."""
        if len(own) == 1:
            return [[(0, r, x)] for r in range(own[0][0].high) for x in range(own[0][0].wide)]
        return [[(k, r * c.down + i, x * c.across + j) for k, (c, _, _) in enumerate(own) for i in range(c.down) for j in range(c.across)] for r in range(self.mcus[1]) for x in range(self.mcus[0])]

    def _block(self, bits: _Bits, c: _Component, block: np.ndarray, dc: int, ac: int, lo: int, hi: int, high: int, low: int) -> None:
        if lo == 0:
            if high:
                block[0] |= bits.take(1) << low
            else:
                c.last += bits.signed(bits.symbol(self.tables[dc]))
                block[0] = c.last << low
            if self.progressive:
                return
            lo = 1
        if high:
            self._refine(bits, block, self.tables[ac], lo, hi, 1 << low)
            return
        if self.run:
            self.run -= 1
            return
        k, table = lo, self.tables[ac]
        while k <= hi:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                if k > 63:
                    raise JpegError("a run leaves its block")
                block[k] = bits.signed(size) << low
            elif zeros < 15:
                self.run = (1 << zeros) - 1 + bits.take(zeros)
                return
            else:
                k += 15
            k += 1

    def _refine(self, bits: _Bits, block: np.ndarray, table: np.ndarray, lo: int, hi: int, bit: int) -> None:
        """One more bit of a band: of coefficients that are set already, and new ones between them."""
        k = lo
        while k <= hi and not self.run:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = bit if bits.take(1) else -bit
            elif zeros < 15:
                self.run = (1 << zeros) + bits.take(zeros)
                break
            while k <= hi:
                if block[k]:
                    if bits.take(1) and not abs(int(block[k])) & bit:
                        block[k] += bit if block[k] > 0 else -bit
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if self.run:
            for j in range(k, hi + 1):
                if block[j] and bits.take(1) and not abs(int(block[j])) & bit:
                    block[j] += bit if block[j] > 0 else -bit
            self.run -= 1

    def rgb(self) -> np.ndarray:
        """(height, width, 3) samples; chroma is repeated to full resolution."""
        planes = []
        for c in self.components.values():
            flat = (c.blocks.reshape(-1, 64) * self.quantisers[c.quantiser]).astype(np.float64) @ _basis()
            values = np.clip(flat / (1 << 26) + 128.5, 0, 255).astype(np.uint8)
            rows, columns = c.blocks.shape[:2]
            plane = values.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
            plane = plane.repeat(self.most_down // c.down, 0).repeat(self.most_across // c.across, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2)
        if len(planes) != 3:
            raise JpegError("an image has one component or three")
        if not self.transform:
            return np.stack(planes, 2)
        red, green_b, green_r, blue = _chroma()
        y, cb, cr = planes[0].astype(np.int16), planes[1], planes[2]
        return np.clip(np.stack([y + red[cr], y + green_b[cb] + green_r[cr], y + blue[cb]], 2), 0, 255).astype(np.uint8)


def decoded_images(images: DataFrame, column: str = "media") -> DataFrame:
    """All columns, and height, width and rgb (bytes by row, column and colour) of a column of JPEGs; these replace columns of their names.

    A null image has nulls; one that can't be decoded has nulls too, and why as ``decode_error``.
    """
    rows = wrapped(images, media=F.col(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column("media").to_pylist()):
                out, error = (None, None, None), None
                if raw is not None:
                    try:
                        x = Decoder(raw).rgb()
                        out = (x.shape[0], x.shape[1], x.tobytes())
                    except (JpegError, KeyError, ValueError) as e:
                        error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(k, 1), pa.array([out[0]], pa.int32()), pa.array([out[1]], pa.int32()), pa.array([out[2]], pa.binary()), pa.array([error], pa.string())], ["row", "height", "width", "rgb", "decode_error"])

    schema = extended(rows.select("row").schema, height=T.IntegerType(), width=T.IntegerType(), rgb=T.BinaryType(), decode_error=T.StringType())
    return unwrapped(arrow_map(rows, run, schema), height=F.col("height"), width=F.col("width"), rgb=F.col("rgb"), decode_error=F.col("decode_error"))
