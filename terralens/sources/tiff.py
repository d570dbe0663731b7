"""Baseline TIFF images with a geographic transform: strips or tiles, plain or deflated."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX = 33550, 33922, 34264
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_KINDS = {1: "u", 2: "i", 3: "f"}


class Image:
    """One image file in memory; ``read`` unpacks the strips or tiles of a window."""

    def __init__(self, data: bytes):
        self.data, self.order = data, {b"II": "<", b"MM": ">"}[data[:2]]
        if struct.unpack(self.order + "H", data[2:4])[0] != 42:
            raise ValueError("not a TIFF file")
        at = struct.unpack(self.order + "I", data[4:8])[0]
        n = struct.unpack_from(self.order + "H", data, at)[0]
        self.tags = dict(self._tag(at + 2 + 12 * i) for i in range(n))
        one = lambda t, d: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.kind = np.dtype(f"{self.order}{_KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
        self.packed, self.predictor, self.apart = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        if self.packed not in (1, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.packed} with predictor {self.predictor} is not supported")
        if TILE_WIDTH in self.tags:
            self.block = one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)
            self.places = self.tags[TILE_OFFSETS], self.tags[TILE_COUNTS]
        else:
            self.block = min(one(ROWS, self.height), self.height), self.width
            self.places = self.tags[OFFSETS], self.tags[COUNTS]

    def _tag(self, at):
        tag, kind, n = struct.unpack_from(self.order + "HHI", self.data, at)
        code, size = _SIZES.get(kind, ("B", 1))
        if kind not in _SIZES:
            return tag, ()
        where = at + 8 if n * size <= 4 else struct.unpack_from(self.order + "I", self.data, at + 8)[0]
        if kind == 2:
            return tag, (self.data[where : where + n],)
        return tag, struct.unpack_from(self.order + code * n, self.data, where)

    @property
    def transform(self) -> tuple[float, ...] | None:
        """(a, b, c, d, e, f) with x = a col + b row + c and y = d col + e row + f."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIEPOINT]
            return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        return None

    def read(self, top: int, left: int, height: int, width: int) -> np.ndarray:
        """(bands, rows, columns) of a window, cut to the image."""
        top, left = max(0, top), max(0, left)
        height, width = max(0, min(height, self.height - top)), max(0, min(width, self.width - left))
        out = np.zeros((self.bands, height, width), self.kind.newbyteorder("="))
        if not out.size:
            return out
        bh, bw = self.block
        across, down = -(-self.width // bw), -(-self.height // bh)
        inside = 1 if self.apart else self.bands
        for plane in range(self.bands if self.apart else 1):
            for i in range(top // bh, (top + height - 1) // bh + 1):
                for j in range(left // bw, (left + width - 1) // bw + 1):
                    part = self._unpack((plane * down + i) * across + j, min(bh, self.height - i * bh) if bw == self.width and TILE_WIDTH not in self.tags else bh, bw, inside)
                    r0, r1 = max(top, i * bh), min(top + height, i * bh + part.shape[0])
                    c0, c1 = max(left, j * bw), min(left + width, j * bw + bw)
                    got = part[r0 - i * bh : r1 - i * bh, c0 - j * bw : c1 - j * bw]
                    to = slice(plane, plane + 1) if self.apart else slice(None)
                    out[to, r0 - top : r1 - top, c0 - left : c1 - left] = got.transpose(2, 0, 1)
        return out

    def _unpack(self, n, rows, cols, bands):
        at, size = self.places[0][n], self.places[1][n]
        raw = self.data[at : at + size]
        raw = raw if self.packed == 1 else zlib.decompress(raw)
        part = np.frombuffer(raw, self.kind, rows * cols * bands).reshape(rows, cols, bands)
        return part if self.predictor == 1 else np.cumsum(part, axis=1, dtype=self.kind.newbyteorder("="))


def write(bands: np.ndarray, transform: tuple[float, ...] | None = None, rows: int = 64) -> bytes:
    """A deflated image of (bands, rows, columns) or (rows, columns)."""
    m = np.atleast_3d(bands.transpose(1, 2, 0) if bands.ndim == 3 else bands)
    height, width, n = m.shape
    kind = m.dtype.newbyteorder("<")
    strips = [zlib.compress(np.ascontiguousarray(m[i : i + rows]).astype(kind).tobytes(), 6) for i in range(0, height, rows)]
    form = {"u": 1, "i": 2, "f": 3}[m.dtype.kind]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s) + len(s) % 2
    tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * kind.itemsize] * n), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, offsets), (SAMPLES, 3, [n]), (ROWS, 4, [rows]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [1]), (FORMAT, 3, [form] * n)]
    if transform:
        a, b, c, d, e, f = map(float, transform)
        tags.append((MATRIX, 12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]))
    body, extra, after = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, code, values in sorted(tags):
        raw = struct.pack("<" + _SIZES[code][0] * len(values), *values)
        if len(raw) > 4:
            body += struct.pack("<HHII", tag, code, len(values), after + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            body += struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
    data = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return struct.pack("<2sHI", b"II", 42, at) + data + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + extra
