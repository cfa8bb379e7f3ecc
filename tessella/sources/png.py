"""PNG files of 8-bit pixels: gray, gray with alpha, RGB or RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: The signature of the format, and its colour type for each number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}
#: Bytes of the signature and of the header up to the height.
HEAD = 24


def png_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from a file's first bytes; none if it is no PNG."""
    return struct.unpack(">II", head[16:24]) if len(head) >= HEAD and head.startswith(SIGNATURE) else None


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """A PNG of ``pixels`` (height, width[, channels]) of type uint8."""
    pixels = pixels if pixels.ndim == 3 else pixels[..., None]
    height, width, channels = pixels.shape

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    # every row starts with its filter: none
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels).reshape(height, width * channels)], axis=1)
    header = struct.pack(">IIBBBBB", width, height, 8, COLOUR[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")
