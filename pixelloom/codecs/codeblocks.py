"""Bit-plane coding of wavelet code-blocks (ITU-T T.800, annex D): one walk over the passes serves both directions.

The walk asks its coder to code each decision: an encoder is given the bit, a decoder returns it. A block is laid out with
a border, so that a sample's neighbours need no tests: sample (x, y) stands at (y + 1) * (w + 2) + x + 1.
"""

from __future__ import annotations

import numpy as np

from . import arithmetic

RUN, UNIFORM = 17, 18
#: The states that contexts start from (the first of significance, run length, uniform).
START = [4, *[0] * 16, 3, 46]
LOW, HL, LH, HH = range(4)


def _significance(band: int, h: int, v: int, d: int) -> int:
    """Context 0 to 8 by the number of significant neighbours beside, above and below, and at the corners."""
    if band == HH:
        s = h + v
        return 8 if d >= 3 else (7 if s else 6) if d == 2 else 3 + min(s, 2) if d == 1 else min(s, 2)
    if band == HL:
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    return v + 2 if v else min(d, 2)


SIGNIFICANCE = [[_significance(b, h, v, d) for h in range(3) for v in range(3) for d in range(5)] for b in range(4)]
#: Context and flip by the signs beside and above or below (each -1 to 1, row by row).
SIGN = [(13, 1), (12, 1), (11, 1), (10, 1), (9, 0), (10, 0), (11, 0), (12, 0), (13, 0)]


class Block:
    def __init__(self, coder, width: int, height: int, band: int, given: np.ndarray | None = None):
        self.coder, self.w, self.h, self.wide = coder, width, height, width + 2
        n = (width + 2) * (height + 2)
        self.table = SIGNIFICANCE[band]
        self.hit, self.sign, self.done, self.refined, self.size = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        self.given = self.negative = None
        if given is not None:
            padded = np.pad(given, 1).ravel()
            self.given, self.negative = np.abs(padded).tolist(), (padded < 0).astype(int).tolist()

    def context(self, i: int) -> int:
        s, w = self.hit, self.wide
        return ((s[i - 1] + s[i + 1]) * 3 + s[i - w] + s[i + w]) * 5 + s[i - w - 1] + s[i - w + 1] + s[i + w - 1] + s[i + w + 1]

    def become(self, i: int, plane: int) -> None:
        """The sample turns significant: its sign follows."""
        s, w = self.sign, self.wide
        h, v = s[i - 1] + s[i + 1], s[i - w] + s[i + w]
        ctx, flip = SIGN[(max(-1, min(1, h)) + 1) * 3 + max(-1, min(1, v)) + 1]
        bit = self.coder.code(ctx, None if self.given is None else self.negative[i] ^ flip) ^ flip
        self.sign[i] = -1 if bit else 1
        self.hit[i] = 1
        self.size[i] = 1 << plane

    def bit(self, i: int, plane: int) -> int | None:
        return None if self.given is None else self.given[i] >> plane & 1

    def stripes(self):
        """Places in the order of the scan: stripes of four rows, column by column."""
        for top in range(0, self.h, 4):
            rows = range(top + 1, min(top + 4, self.h) + 1)
            for x in range(1, self.w + 1):
                yield [y * self.wide + x for y in rows]

    def propagate(self, plane: int) -> None:
        code, table = self.coder.code, self.table
        for column in self.stripes():
            for i in column:
                if not self.hit[i] and (ctx := self.context(i)):
                    self.done[i] = 1
                    if code(table[ctx], self.bit(i, plane)):
                        self.become(i, plane)

    def refine(self, plane: int) -> None:
        for column in self.stripes():
            for i in column:
                if self.hit[i] and not self.done[i]:
                    ctx = 16 if self.refined[i] else 15 if self.context(i) else 14
                    self.size[i] |= self.coder.code(ctx, self.bit(i, plane)) << plane
                    self.refined[i] = 1

    def clean(self, plane: int) -> None:
        code, table, hit, done = self.coder.code, self.table, self.hit, self.done
        for column in self.stripes():
            first = 0
            if len(column) == 4 and not any(hit[i] or done[i] or self.context(i) for i in column):
                given = None if self.given is None else [self.bit(i, plane) for i in column]
                if not code(RUN, None if given is None else int(any(given))):
                    continue
                first = None if given is None else given.index(1)
                high = code(UNIFORM, None if given is None else first >> 1)
                first = high << 1 | code(UNIFORM, None if given is None else first & 1)
                self.become(column[first], plane)
                first += 1
            for i in column[first:]:
                if not hit[i] and not done[i] and code(table[self.context(i)], self.bit(i, plane)):
                    self.become(i, plane)
        self.done = [0] * len(done)

    def passes(self, planes: int, many: int, marked: bool = False) -> int:
        """The first passes of a block of so many bit planes; returns the last plane that they reach."""
        plane, kind = planes - 1, 2
        for _ in range(many):
            (self.propagate, self.refine, self.clean)[kind](plane)
            if kind == 2 and marked:
                for bit in (1, 0, 1, 0):
                    self.coder.code(UNIFORM, None if self.given is None else bit)
            kind = (kind + 1) % 3
            plane -= not kind
        return plane + (kind == 0)

    def values(self) -> np.ndarray:
        size, sign = (np.array(x, np.int64).reshape(self.h + 2, self.wide)[1:-1, 1:-1] for x in (self.size, self.sign))
        return size * sign


def encode(values: np.ndarray, band: int) -> tuple[bytes, int, int]:
    """Data, bit planes and passes of a block of whole numbers."""
    planes = int(np.abs(values).max()).bit_length() if values.size else 0
    if not planes:
        return b"", 0, 0
    coder = arithmetic.Encoder(START)
    Block(coder, values.shape[1], values.shape[0], band, values).passes(planes, 3 * planes - 2)
    return coder.done(), planes, 3 * planes - 2


def decode(data: bytes, width: int, height: int, band: int, planes: int, many: int, marked: bool = False) -> tuple[np.ndarray, int]:
    """Values of a block, and the plane below which they are not known."""
    block = Block(arithmetic.Decoder(START, data), width, height, band)
    last = block.passes(planes, many, marked) if many else 0
    return block.values(), last
