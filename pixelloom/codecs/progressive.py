"""Progressive frames of ITU-T T.81 (spectral selection and successive approximation): scans read and written.

Levels are arrays of blocks in scan order, as in the baseline coder; every scan adds to them.
"""

from __future__ import annotations

import numpy as np

from . import jpeg, segments

#: The writer's scans: first and last place, bits left out before and after; the DC scans hold all components.
SCRIPT = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]


class Scan:
    """One scan's state; `block` takes the next block of its j-th component."""

    def __init__(self, span: tuple[int, int, int, int], tables: list[tuple[dict | None, dict | None]]):
        self.first, self.last, self.high, self.low = span
        self.tables = tables
        if self.first > self.last or self.last > 63 or (self.first == 0) != (self.last == 0) or (self.first and len(tables) > 1) or self.low > 13 or (self.high and self.high != self.low + 1):
            raise ValueError("scan of an impossible span")
        self.restart()

    def restart(self) -> None:
        self.before, self.blank = [0] * len(self.tables), 0

    def block(self, bits: jpeg.Bits, j: int, out: np.ndarray) -> None:
        if not self.first:
            if self.high:
                out[0] |= bits.raw(1) << self.low
            else:
                self.before[j] += bits.value(min(bits.symbol(self.tables[j][0]), 16))
                out[0] = self.before[j] << self.low
        elif self.high:
            self.refine(bits, out)
        else:
            self.begin(bits, out)

    def begin(self, bits: jpeg.Bits, out: np.ndarray) -> None:
        if self.blank:
            self.blank -= 1
            return
        k = self.first
        while k <= self.last:
            s = bits.symbol(self.tables[0][1])
            run, size = s >> 4, s & 15
            if not size:
                if run < 15:
                    self.blank = (1 << run) - 1 + bits.raw(run)
                    return
                k += 16
                continue
            k += run
            if k > self.last:
                raise ValueError("coefficients overrun the span")
            out[k] = bits.value(size) * (1 << self.low)
            k += 1

    def refine(self, bits: jpeg.Bits, out: np.ndarray) -> None:
        one, k = 1 << self.low, self.first

        def pass_by(run: int) -> None:
            """Corrects the levels that are there, up to the place after so many zeros."""
            nonlocal k
            while k <= self.last:
                if out[k]:
                    if bits.raw(1) and not abs(int(out[k])) & one:
                        out[k] += one if out[k] > 0 else -one
                elif not run:
                    return
                else:
                    run -= 1
                k += 1

        while not self.blank and k <= self.last:
            s = bits.symbol(self.tables[0][1])
            run, size = s >> 4, s & 15
            fresh = 0
            if size:
                fresh = one if bits.raw(1) else -one
            elif run < 15:
                self.blank = (1 << run) + bits.raw(run)
                break
            pass_by(run)
            if fresh and k <= self.last:
                out[k] = fresh
            k += 1
        if self.blank:
            pass_by(64)
            self.blank -= 1


class Tokens:
    """Symbols of one table with their extra bits; -1 stands for bits without a symbol."""

    def __init__(self):
        self.symbol: list[int] = []
        self.value: list[int] = []
        self.bits: list[int] = []
        self.blank, self.held = 0, []

    def put(self, symbol: int, value: int = 0, bits: int = 0) -> None:
        self.symbol.append(symbol)
        self.value.append(value)
        self.bits.append(bits)

    def raw(self, bits: list[int]) -> None:
        for b in bits:
            self.put(-1, b, 1)

    def end(self) -> None:
        """The run of blocks without further levels, and the corrections inside it."""
        if self.blank:
            size = self.blank.bit_length() - 1
            self.put(size << 4, self.blank - (1 << size), size)
            self.raw(self.held)
            self.blank, self.held = 0, []

    def data(self) -> tuple[bytes, bytes]:
        """The table's bytes and the coded data."""
        symbol, value, bits = (np.array(x, np.int64) for x in (self.symbol, self.value, self.bits))
        table, code, size = jpeg.table_of(np.bincount(symbol[symbol >= 0], minlength=256))
        code, size = np.append(code, 0), np.append(size, 0)
        return table, jpeg.packed(code[symbol] << bits | value, size[symbol] + bits)


def _signed(v: int) -> tuple[int, int]:
    size = abs(v).bit_length()
    return v if v >= 0 else v + (1 << size) - 1, size


def first_dc(levels: list[np.ndarray], low: int) -> Tokens:
    out, before = Tokens(), [0] * len(levels)
    for row in np.stack([p[..., 0].ravel() >> low for p in levels], axis=1).tolist():
        for j, v in enumerate(row):
            value, size = _signed(v - before[j])
            out.put(size, value, size)
            before[j] = v
    return out


def first_ac(blocks: np.ndarray, first: int, last: int, low: int) -> Tokens:
    out = Tokens()
    for block in (np.sign(blocks) * (np.abs(blocks) >> low))[:, first : last + 1].tolist():
        run = 0
        for v in block:
            if not v:
                run += 1
                continue
            out.end()
            while run > 15:
                out.put(0xF0)
                run -= 16
            value, size = _signed(v)
            out.put(run << 4 | size, value, size)
            run = 0
        if run:
            out.blank += 1
            if out.blank == 0x7FFF:
                out.end()
    out.end()
    return out


def more_ac(blocks: np.ndarray, first: int, last: int, low: int) -> Tokens:
    out = Tokens()
    size, positive = np.abs(blocks)[:, first : last + 1] >> low, (blocks > 0)[:, first : last + 1]
    for own, plus in zip(size.tolist(), positive.tolist(), strict=True):
        end = max((k for k, v in enumerate(own) if v == 1), default=-1)
        run, held = 0, []
        for k, v in enumerate(own):
            if not v:
                run += 1
                continue
            while run > 15 and k <= end:
                out.end()
                out.put(0xF0)
                out.raw(held)
                run, held = run - 16, []
            if v > 1:
                held.append(v & 1)
                continue
            out.end()
            out.put(run << 4 | 1, int(plus[k]), 1)
            out.raw(held)
            run, held = 0, []
        if run or held:
            out.blank += 1
            out.held += held
            if out.blank == 0x7FFF or len(out.held) > 900:
                out.end()
    out.end()
    return out


def scans(levels: list[np.ndarray]) -> bytes:
    """All scans of SCRIPT, each with a table of its own."""
    out = []
    for first, last, high, low in SCRIPT:
        span = bytes([first, last, high << 4 | low])
        if first:
            for i, plane in enumerate(levels):
                tokens = (more_ac if high else first_ac)(plane.reshape(-1, 64), first, last, low)
                table, data = tokens.data()
                if data or not tokens.symbol:
                    out += [segments.segment(segments.DHT, b"\x10" + table), segments.segment(segments.SOS, bytes([1, i + 1, 0]) + span), data]
            continue
        head = segments.segment(segments.SOS, bytes([len(levels), *(b for i in range(len(levels)) for b in (i + 1, 0))]) + span)
        if high:
            bits = np.stack([p[..., 0].ravel() >> low & 1 for p in levels], axis=1).ravel().astype(np.int64)
            out += [head, jpeg.packed(bits, np.ones(len(bits), np.int64))]
        else:
            table, data = first_dc(levels, low).data()
            out += [segments.segment(segments.DHT, b"\x00" + table), head, data]
    return b"".join(out)
