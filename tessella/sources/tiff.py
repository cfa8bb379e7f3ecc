"""Tiled and stripped TIFF and BigTIFF with numpy: random-access reads of pyramid levels, and pyramid writes.

Reads uncompressed, LZW, deflate and PackBits data of 8 or 16 bits with or without horizontal differencing, chunky samples.
Levels are the first directory and its sub-directories, or the chain of directories that shrink.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Sequence
from functools import cached_property
from typing import BinaryIO

import numpy as np

#: Fixed values of the TIFF 6.0 and BigTIFF specifications: sizes and struct codes of field types, and tags.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, X_RESOLUTION, Y_RESOLUTION, PLANAR, UNIT = 273, 277, 278, 279, 282, 283, 284, 296
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SUB_DIRECTORIES = 317, 322, 323, 324, 325, 330
DEFLATE = (8, 32946)
CENTIMETRE = 3


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widened one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            width = 9 + sum(len(table) >= n for n in (511, 1023, 2047))
        out += entry
        last = entry
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


class Page:
    """One directory: its tags and its pixels."""

    def __init__(self, file: BinaryIO, order: str, tags: dict[int, tuple]):
        self.file, self.order, self.tags = file, order, tags
        self.width, self.height = tags[WIDTH][0], tags[HEIGHT][0]
        self.samples = tags.get(SAMPLES, (1,))[0]
        bits = tags.get(BITS, (1,))[0]
        if bits not in (8, 16) or tags.get(PLANAR, (1,))[0] != 1:
            raise ValueError("only chunky samples of 8 or 16 bits can be read")
        self.dtype = np.dtype(np.uint8 if bits == 8 else np.uint16).newbyteorder(order)

    def resolution(self, strict: bool = False) -> tuple[float, float]:
        """Microns per pixel (x, y); inch, centimetre and millimetre units, and microns as ``levels.tiff_resolution`` has them."""
        from tessella.operators.levels import MICRONS

        unit = self.tags.get(UNIT, (2,))[0]
        values = [self.tags[t][0][0] / self.tags[t][0][1] for t in (X_RESOLUTION, Y_RESOLUTION)]
        if unit == 5:
            return tuple(1 / v if strict else v for v in values)
        if unit not in MICRONS:
            raise ValueError(f"unsupported resolution unit: {unit}")
        return tuple(MICRONS[unit] / v for v in values)

    @cached_property
    def blocks(self) -> tuple[int, int, int]:
        """Width and height of a block, and blocks in a row."""
        if TILE_WIDTH in self.tags:
            w, h = self.tags[TILE_WIDTH][0], self.tags[TILE_HEIGHT][0]
            return w, h, -(-self.width // w)
        return self.width, min(self.tags.get(STRIP_ROWS, (self.height,))[0], self.height), 1

    def block(self, column: int, row: int) -> np.ndarray:
        w, h, across = self.blocks
        tiled = TILE_WIDTH in self.tags
        at = row * across + column
        offset, size = self.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS][at], self.tags[TILE_BYTES if tiled else STRIP_BYTES][at]
        if not tiled:
            h = min(h, self.height - row * h)
        self.file.seek(offset)
        data, kind = self.file.read(size), self.tags.get(COMPRESSION, (1,))[0]
        if kind in DEFLATE:
            data = zlib.decompress(data)
        elif kind == 5:
            data = unpack_lzw(data)
        elif kind == 32773:
            data = unpack_bits(data)
        elif kind != 1:
            raise ValueError(f"compression {kind} can't be read here")
        pixels = np.frombuffer(data, self.dtype, w * h * self.samples).reshape(h, w, self.samples)
        if self.tags.get(PREDICTOR, (1,))[0] == 2:
            pixels = np.cumsum(pixels, axis=1, dtype=self.dtype.newbyteorder("="))
        return pixels

    def read(self, x: int, y: int, width: int, height: int, background: int | Sequence[int] = 255, channels: int = 3) -> np.ndarray:
        """Pixels (height, width, channels) of a window; parts outside the page, also left and above, have the background.

        A gray page is repeated over the channels; further samples than ``channels`` are left out.
        """
        out = np.empty((height, width, channels), self.dtype.newbyteorder("="))
        out[:] = background
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + width, self.width), min(y + height, self.height)
        if x0 >= x1 or y0 >= y1:
            return out
        w, h, _ = self.blocks
        for row in range(y0 // h, -(-y1 // h)):
            for column in range(x0 // w, -(-x1 // w)):
                block = self.block(column, row)
                a, b = max(x0, column * w), min(x1, column * w + w)
                c, d = max(y0, row * h), min(y1, row * h + h)
                part = block[c - row * h : d - row * h, a - column * w : b - column * w]
                out[c - y : d - y, a - x : b - x] = part[..., :channels] if self.samples >= channels else part[..., :1]
        return out


class TiffFile:
    """The levels of the first image of a TIFF."""

    def __init__(self, file: BinaryIO):
        self.file = file
        head = file.read(16)
        self.order = {b"II": "<", b"MM": ">"}[head[:2]]
        magic = struct.unpack(self.order + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        at = struct.unpack(self.order + "Q", head[8:16])[0] if self.big else struct.unpack(self.order + "I", head[4:8])[0]
        first, after = self._directory(at)
        tags = [first]
        if SUB_DIRECTORIES in first:
            tags += [self._directory(o)[0] for o in first[SUB_DIRECTORIES]]
        else:
            while after:
                more, after = self._directory(after)
                if more[WIDTH][0] < tags[-1][WIDTH][0] and more[HEIGHT][0] < tags[-1][HEIGHT][0]:
                    tags.append(more)
        self.pages = [Page(file, self.order, t) for t in tags]
        # levels without a resolution of their own have the first one's, scaled by their size
        for page in self.pages[1:]:
            for tag, ratio in ((X_RESOLUTION, page.width / self.pages[0].width), (Y_RESOLUTION, page.height / self.pages[0].height)):
                if tag not in page.tags and tag in first:
                    page.tags[tag] = ((first[tag][0][0] * ratio, first[tag][0][1]),)
            page.tags.setdefault(UNIT, first.get(UNIT, (2,)))

    def _directory(self, at: int) -> tuple[dict[int, tuple], int]:
        self.file.seek(at)
        n = struct.unpack(self.order + ("Q" if self.big else "H"), self.file.read(8 if self.big else 2))[0]
        size, inline, code = (20, 8, "Q") if self.big else (12, 4, "I")
        raw = self.file.read(n * size + inline)
        tags = {}
        for i in range(n):
            entry = raw[i * size : (i + 1) * size]
            tag, kind = struct.unpack(self.order + "HH", entry[:4])
            count = struct.unpack(self.order + code, entry[4 : 4 + inline])[0]
            if kind not in TYPES:
                continue
            form = TYPES[kind]
            length = struct.calcsize("=" + form) * count
            value = entry[4 + inline :]
            if length > inline:
                self.file.seek(struct.unpack(self.order + code, value)[0])
                value = self.file.read(length)
            flat = struct.unpack(self.order + form[0] * (count * len(form)), value[:length])
            tags[tag] = tuple(zip(flat[::2], flat[1::2], strict=True)) if len(form) == 2 else flat
        return tags, struct.unpack(self.order + code, raw[n * size :])[0]

    def resolutions(self) -> list[tuple[float, float]]:
        return [p.resolution() for p in self.pages]

    def closest_level(self, mpp: float | Sequence[float]) -> int:
        wanted = (mpp, mpp) if isinstance(mpp, (int, float)) else mpp
        far = [(abs(x - wanted[0]) + abs(y - wanted[1])) / 2 for x, y in self.resolutions()]
        return far.index(min(far))


def halved(pixels: np.ndarray) -> np.ndarray:
    """The level above: means of two by two pixels, the last row and column repeated where sizes are odd."""
    h, w = pixels.shape[:2]
    padded = np.pad(pixels, ((0, h % 2), (0, w % 2), (0, 0)), mode="edge").astype(np.uint32)
    total = padded[::2, ::2] + padded[1::2, ::2] + padded[::2, 1::2] + padded[1::2, 1::2]
    return ((total + 2) // 4).astype(pixels.dtype)


def pyramid(pixels: np.ndarray, least: int = 512) -> list[np.ndarray]:
    out = [pixels]
    while max(out[-1].shape[:2]) > least:
        out.append(halved(out[-1]))
    return out


def encode_tiff(levels: Sequence[np.ndarray], mpp: Sequence[float], tile: Sequence[int] = (512, 512), compression: str = "deflate", big: bool = True, unit: int = CENTIMETRE) -> bytes:
    """A tiled TIFF of ``levels`` (height, width[, samples]), the first with ``mpp`` (x, y); the others are sub-directories."""
    if compression not in ("deflate", "none"):
        raise ValueError("compression must be deflate or none")
    microns = {2: 25400.0, 3: 10000.0, 4: 1000.0}[unit]
    out = io.BytesIO()
    code, inline = ("Q", 8) if big else ("I", 4)
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    w, h = tile
    directories = []
    for k, pixels in enumerate(levels):
        pixels = np.atleast_3d(pixels)
        rows, columns, samples = pixels.shape
        offsets, sizes = [], []
        for y in range(0, rows, h):
            for x in range(0, columns, w):
                block = np.zeros((h, w, samples), pixels.dtype)
                part = pixels[y : y + h, x : x + w]
                block[: part.shape[0], : part.shape[1]] = part
                data = block.astype(pixels.dtype.newbyteorder("<")).tobytes()
                data = zlib.compress(data) if compression == "deflate" else data
                offsets.append(out.tell())
                sizes.append(len(data))
                out.write(data)
        scale = (levels[0].shape[1] / columns, levels[0].shape[0] / rows)
        ratio = [(round(microns / (m * s) * 1000), 1000) for m, s in zip(mpp, scale, strict=True)]
        directories.append([
            (254, 4, [int(k > 0)]), (WIDTH, 4, [columns]), (HEIGHT, 4, [rows]), (BITS, 3, [pixels.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [8 if compression == "deflate" else 1]),
            (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (X_RESOLUTION, 5, list(ratio[0])), (Y_RESOLUTION, 5, list(ratio[1])), (PLANAR, 3, [1]), (UNIT, 3, [unit]),
            (TILE_WIDTH, 3, [w]), (TILE_HEIGHT, 3, [h]), (TILE_OFFSETS, 16 if big else 4, offsets), (TILE_BYTES, 16 if big else 4, sizes),
        ])

    def put(entries: list) -> int:
        rows = []
        for tag, kind, values in sorted(entries):
            form = TYPES[kind]
            data = struct.pack("<" + form[0] * len(values), *values)
            if len(data) > inline:
                data, at = struct.pack("<" + code, out.tell()), out.write(data)
            rows.append(struct.pack("<HH" + code, tag, kind, len(values) // len(form)) + data.ljust(inline, b"\0"))
        at = out.tell()
        out.write(struct.pack("<" + ("Q" if big else "H"), len(rows)) + b"".join(rows) + struct.pack("<" + code, 0))
        return at

    below = [put(d) for d in directories[1:]]
    first = put(directories[0] + ([(SUB_DIRECTORIES, 18 if big else 13, below)] if below else []))
    out.seek(8 if big else 4)
    out.write(struct.pack("<" + code, first))
    return out.getvalue()
