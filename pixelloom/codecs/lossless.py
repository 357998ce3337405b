"""Lossless frames of ITU-T T.81 (annex H, Huffman-coded): predictors 1 to 7, point transform, restarts, 2 to 16 bits.

Components of one sampling are coded sample by sample. The first line is predicted from the left, the first sample of
each other line from above, the first of all (and after a restart) as the middle of the range.
"""

from __future__ import annotations

import re

import numpy as np

from . import jpeg, segments

SOF3 = 0xC3


def guess(kind: int, a, b, c):
    """From left, above and upper left; numbers or arrays."""
    return (0 * a, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[kind]


def predictions(plane: np.ndarray, kind: int, middle: int, lines: int = 0) -> np.ndarray:
    """Of all samples at once, for the writer; every `lines` lines (0: never) prediction starts afresh."""
    a = np.empty_like(plane)
    a[:, 1:], a[:, 0] = plane[:, :-1], 0
    b = np.vstack([np.zeros_like(plane[:1]), plane[:-1]])
    c = np.empty_like(plane)
    c[:, 1:], c[:, 0] = b[:, :-1], 0
    out = guess(kind, a, b, c)
    out[:, 0] = b[:, 0]
    fresh = np.arange(len(plane)) % (lines or len(plane)) == 0
    out[fresh] = a[fresh]
    out[fresh, 0] = middle
    return out


def encode(pixels: np.ndarray, bits: int = 8, predictor: int = 1, shift: int = 0, restart_lines: int = 0) -> bytes:
    """pixels: height x width x components. shift: low bits that are left out (the only loss)."""
    height, width, n = pixels.shape
    if not pixels.size or not 2 <= bits <= 16 or not 1 <= predictor <= 7 or not 0 <= shift < bits or int(pixels.max()) >> bits or n > 4 or restart_lines * width > 65535:
        raise ValueError("samples or options are out of range")
    planes = [pixels[..., i].astype(np.int64) >> shift for i in range(n)]
    diff = np.stack([p - predictions(p, predictor, 1 << bits - shift - 1, restart_lines) for p in planes], axis=2).reshape(-1)
    diff = (diff + 32768) % 65536 - 32768
    diff[diff == -32768] = 32768
    size = jpeg.category(diff)
    extra = np.where(size == 16, 0, size)
    value = np.where(size == 16, 0, np.where(diff < 0, diff + (1 << size) - 1, diff))
    table, code, wide = jpeg.table_of(np.bincount(size, minlength=256))
    out = [segments.segment(segments.SOI, bare=True), segments.segment(SOF3, segments.frame_bytes(bits, width, height, [(i + 1, 1, 1, 0) for i in range(n)])), segments.segment(segments.DHT, b"\x00" + table)]
    if restart_lines:
        out.append(segments.segment(segments.DRI, (restart_lines * width).to_bytes(2, "big")))
    out.append(segments.segment(segments.SOS, bytes([n, *(b for i in range(n) for b in (i + 1, 0)), predictor, 0, shift])))
    each = (restart_lines or height) * width * n
    for i, a in enumerate(range(0, len(diff), each)):
        part = slice(a, a + each)
        if i:
            out.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
        out.append(jpeg.packed(code[size[part]] << extra[part] | value[part], wide[size[part]] + extra[part]))
    return b"".join([*out, segments.segment(segments.EOI, bare=True)])


def read_planes(data: bytes, width: int, height: int, bits: int, predictor: int, shift: int, tables: list[dict], restart: int) -> list[np.ndarray]:
    """The planes of one scan's components, sample by sample."""
    if not 1 <= predictor <= 7 or shift >= bits or (restart and restart % width):
        raise ValueError("scan of an impossible kind")
    n, lines, middle = len(tables), restart // width or height, 1 << bits - shift - 1
    pieces = re.split(rb"\xff[\xd0-\xd7]", data)
    if len(pieces) < -(-height // lines):
        raise ValueError("scan is cut short")
    planes: list[list[list[int]]] = [[] for _ in range(n)]
    for first, piece in zip(range(0, height, lines), pieces, strict=False):
        source = jpeg.Bits(piece.replace(b"\xff\x00", b"\xff"))
        for y in range(first, min(height, first + lines)):
            now = [[0] * width for _ in range(n)]
            for x in range(width):
                for j in range(n):
                    size = source.symbol(tables[j])
                    diff = 32768 if size == 16 else source.value(size)
                    above = planes[j][-1] if y > first else None
                    if above is None:
                        p = now[j][x - 1] if x else middle
                    else:
                        p = guess(predictor, now[j][x - 1], above[x], above[x - 1]) if x else above[0]
                    now[j][x] = p + diff & 0xFFFF
            for j in range(n):
                planes[j].append(now[j])
    return [np.array(p, np.int64) << shift for p in planes]
