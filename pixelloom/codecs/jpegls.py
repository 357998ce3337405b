"""Lossless and near-lossless coding by the public standard ITU-T T.87: one model walks the samples for both directions.

The model asks its coder to code a value: the writer is given the value and puts it out, the reader is given None and
returns what it reads. So contexts, predictions and runs are written down once. Samples are whole numbers of 2 to 16 bits.
"""

from __future__ import annotations

import numpy as np

from . import segments

#: The orders of the run lengths' codes.
RUN_ORDERS = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15]
RESET = 64
LAYOUTS = {"none": 0, "line": 1, "sample": 2}


def thresholds(top: int, near: int) -> tuple[int, int, int]:
    """The default gradient thresholds for samples of 0 to top."""
    if top >= 128:
        f = (min(top, 4095) + 128) // 256
        wanted = [f * (a - b) + b + c * near for a, b, c in ((3, 2, 3), (7, 3, 5), (21, 4, 7))]
    else:
        f = 256 // (top + 1)
        wanted = [max(b, a // f + c * near) for a, b, c in ((3, 2, 3), (7, 3, 5), (21, 4, 7))]
    out, floor = [], near + 1
    for w in wanted:
        floor = w if floor <= w <= top else floor
        out.append(floor)
    return tuple(out)


def presets(bits: int, near: int, given: tuple[int, ...] = ()) -> tuple[int, int, int, int, int]:
    """The largest sample, three thresholds and the reset interval; zeros, and values that aren't given, stand for the defaults."""
    wanted = [*given, *[0] * (5 - len(given))]
    top = wanted[0] or (1 << bits) - 1
    if not 1 <= top < 1 << bits or not 0 <= near <= min(255, top // 2):
        raise ValueError("largest sample or bound is out of range")
    t = [a or b for a, b in zip(wanted[1:4], thresholds(top, near), strict=True)]
    reset = wanted[4] or RESET
    if not near + 1 <= t[0] <= t[1] <= t[2] <= top or not 3 <= reset <= max(255, top):
        raise ValueError("preset parameters are out of range")
    return top, *t, reset


class Writer:
    """Bits of a scan; the byte after 0xFF carries seven."""

    def __init__(self):
        self.out, self.value, self.free = bytearray(), 0, 8

    def put(self, value: int, n: int) -> None:
        while n:
            take = min(n, self.free)
            n -= take
            self.free -= take
            self.value |= (value >> n & (1 << take) - 1) << self.free
            if not self.free:
                self.out.append(self.value)
                self.free, self.value = 7 if self.value == 0xFF else 8, 0

    def bits(self, n: int, value: int) -> int:
        self.put(value, n)
        return value

    def golomb(self, k: int, limit: int, wide: int, value: int) -> int:
        q, most = value >> k, limit - wide - 1
        if q < most:
            self.put(1, q + 1)
            self.put(value & (1 << k) - 1, k)
        else:
            self.put(1, most + 1)
            self.put(value - 1, wide)
        return value

    def run(self, model: Model, lane: int, left: int, length: int) -> tuple[int, bool]:
        rest = length
        while rest >= 1 << RUN_ORDERS[model.index[lane]]:
            self.put(1, 1)
            rest -= 1 << RUN_ORDERS[model.index[lane]]
            model.index[lane] = min(31, model.index[lane] + 1)
        if length < left:
            self.put(rest, 1 + RUN_ORDERS[model.index[lane]])
        elif rest:
            self.put(1, 1)
        return length, length == left

    def done(self) -> bytes:
        if self.free < (7 if self.out[-1:] == b"\xff" else 8) or self.out[-1:] == b"\xff":
            self.out.append(self.value)
        return bytes(self.out)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.value, self.last = data, 0, 0, 0, 0

    def bit(self) -> int:
        if not self.left:
            if self.at >= len(self.data):
                raise ValueError("scan is cut short")
            self.left = 7 if self.last == 0xFF else 8
            self.last = self.value = self.data[self.at]
            self.at += 1
        self.left -= 1
        return self.value >> self.left & 1

    def bits(self, n: int, value: None = None) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def golomb(self, k: int, limit: int, wide: int, value: None = None) -> int:
        q, most = 0, limit - wide - 1
        while not self.bit():
            q += 1
            if q > most:
                raise ValueError("code is too long")
        return q << k | self.bits(k) if q < most else self.bits(wide) + 1

    def run(self, model: Model, lane: int, left: int, length: None = None) -> tuple[int, bool]:
        n = 0
        while n < left and self.bit():
            n += 1 << RUN_ORDERS[model.index[lane]]
            if n <= left:
                model.index[lane] = min(31, model.index[lane] + 1)
            else:
                n = left
            if n == left:
                return n, True
        if n < left:
            n += self.bits(RUN_ORDERS[model.index[lane]])
            if n >= left:
                raise ValueError("run is too long")
        return n, n == left


class Model:
    """Contexts and prediction of one scan; `samples` are given to a writer and None to a reader."""

    def __init__(self, coder, bits: int, near: int, lanes: int, given: tuple[int, ...] = ()):
        self.top, *self.t, self.reset = presets(bits, near, given)
        self.coder, self.near = coder, near
        self.step = 2 * near + 1
        self.range = (self.top + 2 * near) // self.step + 1
        self.wide = (self.range - 1).bit_length()
        deep = max(2, self.top.bit_length())
        self.limit = 2 * (deep + max(8, deep))
        start = max(2, (self.range + 32) // 64)
        self.a, self.b, self.c, self.n = [start] * 367, [0] * 365, [0] * 365, [1] * 367
        self.negative = [0, 0]
        self.index = [0] * lanes

    def level(self, d: int) -> int:
        m = abs(d)
        q = 0 if m <= self.near else 1 if m < self.t[0] else 2 if m < self.t[1] else 3 if m < self.t[2] else 4
        return -q if d < 0 else q

    def fold(self, e: int) -> int:
        """A difference of samples as a quantised error modulo the range."""
        if self.near:
            e = (e + self.near) // self.step if e > 0 else -((self.near - e) // self.step)
        e %= self.range
        return e - self.range if e >= (self.range + 1) // 2 else e

    def rebuilt(self, guess: int, e: int) -> int:
        v = guess + e * self.step
        if v < -self.near:
            v += self.range * self.step
        elif v > self.top + self.near:
            v -= self.range * self.step
        return min(max(v, 0), self.top)

    def order(self, weight: int, n: int) -> int:
        k = 0
        while n << k < weight:
            k += 1
        return k

    def regular(self, ctx: int, a: int, b: int, c: int, v: int | None) -> int:
        sign, q = (-1, -ctx) if ctx < 0 else (1, ctx)
        guess = min(a, b) if c >= max(a, b) else max(a, b) if c <= min(a, b) else a + b - c
        guess = min(max(guess + sign * self.c[q], 0), self.top)
        k = self.order(self.a[q], self.n[q])
        swapped = not self.near and not k and 2 * self.b[q] <= -self.n[q]
        code = None
        if v is not None:
            e = self.fold(sign * (v - guess))
            code = 2 * e if e >= 0 else -2 * e - 1
            code ^= swapped
        code = self.coder.golomb(k, self.limit, self.wide, code) ^ swapped
        e = -(code + 1 >> 1) if code & 1 else code >> 1
        self.learn(q, e)
        return self.rebuilt(guess, sign * e)

    def learn(self, q: int, e: int) -> None:
        self.a[q] += abs(e)
        b, n = self.b[q] + e * self.step, self.n[q]
        if n == self.reset:
            self.a[q] >>= 1
            b >>= 1
            n >>= 1
        n += 1
        if b <= -n:
            b = max(b + n, 1 - n)
            self.c[q] = max(-128, self.c[q] - 1)
        elif b > 0:
            b = min(b - n, 0)
            self.c[q] = min(127, self.c[q] + 1)
        self.b[q], self.n[q] = b, n

    def interruption(self, lane: int, alike: int, a: int, b: int, v: int | None) -> int:
        """The sample that ends a run: `alike` says that left and above are (near) equal."""
        q = 365 + alike
        guess, sign = (a, 1) if alike else (b, -1 if a > b else 1)
        k = self.order(self.a[q] + (self.n[q] >> 1 if alike else 0), self.n[q])
        lower = k > 0 or 2 * self.negative[alike] >= self.n[q]  # then negative errors take the odd places
        code = None
        if v is not None:
            e = self.fold(sign * (v - guess))
            code = 2 * abs(e) - alike - (e != 0 and lower == (e < 0))
        code = self.coder.golomb(k, self.limit - RUN_ORDERS[self.index[lane]] - 1, self.wide, code)
        odd = code + alike & 1
        e = (code + alike + 1) // 2
        e = -e if lower == bool(odd) else e
        self.negative[alike] += e < 0
        self.a[q] += code + 1 - alike >> 1
        if self.n[q] == self.reset:
            self.a[q] >>= 1
            self.n[q] >>= 1
            self.negative[alike] >>= 1
        self.n[q] += 1
        self.index[lane] = max(0, self.index[lane] - 1)
        return self.rebuilt(guess, sign * e)

    def line(self, lane: int, above: list[list[int]], now: list[list[int]], given: list[list[int]] | None, width: int) -> None:
        """One line of a group of components; each line has one place more at both ends."""
        near = self.near
        for p, c in zip(above, now, strict=True):
            c[0], p[width + 1] = p[1], p[width]
        every = range(len(now))
        x = 1
        while x <= width:
            ctx = []
            for p, c in zip(above, now, strict=True):
                ctx.append((self.level(p[x + 1] - p[x]) * 9 + self.level(p[x] - p[x - 1])) * 9 + self.level(p[x - 1] - c[x - 1]))
            if any(ctx):
                for i in every:
                    now[i][x] = self.regular(ctx[i], now[i][x - 1], above[i][x], above[i][x - 1], given[i][x - 1] if given else None)
                x += 1
                continue
            left, length = width + 1 - x, None
            if given:
                length = 0
                while length < left and all(abs(given[i][x - 1 + length] - now[i][x - 1]) <= near for i in every):
                    length += 1
            length, whole = self.coder.run(self, lane, left, length)
            for i in every:
                now[i][x : x + length] = [now[i][x - 1]] * length
            x += length
            if whole:
                continue
            index = self.index[lane]
            for i in every:
                a, b = now[i][x - 1], above[i][x]
                self.index[lane] = index
                now[i][x] = self.interruption(lane, int(len(now) == 1 and abs(a - b) <= near), a, b, given[i][x - 1] if given else None)
            x += 1

    def planes(self, groups: list[list], width: int, height: int, reading: bool) -> list[list[list[int]]]:
        """All lines; groups of component planes take turns line by line."""
        above = [[[0] * (width + 2) for _ in g] for g in groups]
        out = [[[] for _ in g] for g in groups]
        for y in range(height):
            for lane, g in enumerate(groups):
                now = [[0] * (width + 2) for _ in g]
                self.line(lane, above[lane], now, None if reading else [p[y] for p in g], width)
                above[lane] = now
                for part, row in zip(out[lane], now, strict=True):
                    part.append(row[1 : width + 1])
        return out


def scans(parts: int, layout: int) -> list[list[list[int]]]:
    """Scans as lists of groups of component numbers."""
    if layout == 0:
        return [[[i]] for i in range(parts)]
    return [[[i] for i in range(parts)]] if layout == 1 else [[list(range(parts))]]


def encode(pixels: np.ndarray, bits: int = 8, near: int = 0, layout: str = "none", given: tuple[int, ...] = (), spiff: bool = False) -> bytes:
    """pixels: height x width x components. given: preset parameters (see presets), written where there are any; spiff: with that header."""
    height, width, n = pixels.shape
    if not 2 <= bits <= 16 or (pixels.size and int(pixels.max()) > presets(bits, near, given)[0]):
        raise ValueError("samples are out of range")
    ilv = LAYOUTS[layout] if n > 1 else 0
    out = [segments.segment(segments.SOI, bare=True)]
    if spiff:
        out += [segments.segment(segments.APP8, segments.spiff_bytes(width, height, n, bits)), segments.segment(segments.APP8, segments.SPIFF_END)]
    out.append(segments.segment(segments.SOF_LS, segments.frame_bytes(bits, width, height, [(i + 1, 1, 1, 0) for i in range(n)])))
    if given:
        out.append(segments.segment(segments.LSE, segments.presets_bytes(presets(bits, near, given))))
    for scan in scans(n, ilv):
        ids = [i for g in scan for i in g]
        out.append(segments.segment(segments.SOS, bytes([len(ids), *(b for i in ids for b in (i + 1, 0)), near, ilv, 0])))
        writer = Writer()
        Model(writer, bits, near, len(scan), given).planes([[pixels[:, :, i].tolist() for i in g] for g in scan], width, height, False)
        out.append(writer.done())
    return b"".join([*out, segments.segment(segments.EOI, bare=True)])


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (height x width x components) and bits a sample. Mapping tables are passed over: samples stay as they are coded."""
    head, planes, given = None, {}, ()
    for at, code, payload in segments.walk(data):
        if code == segments.SOF_LS:
            head = segments.frame(payload)
        elif code == segments.LSE:
            given = segments.presets(payload) or given
        elif code == segments.SOS:
            if head is None or len(payload) < 4 or len(payload) < 4 + 2 * payload[0]:
                raise ValueError("scan without a frame")
            ids = [payload[1 + 2 * i] for i in range(payload[0])]
            near, ilv = payload[1 + 2 * len(ids)], payload[2 + 2 * len(ids)]
            if not ids or ilv > 2 or set(ids) - {p[0] for p in head["parts"]}:
                raise ValueError("scan of unknown components")
            start = at + 4 + len(payload)
            groups = [ids] if ilv == 2 else [[i] for i in ids]
            model = Model(Reader(data[start : segments.scan_end(data, start, True)]), head["bits"], near, len(groups), given)
            got = model.planes(groups, head["width"], head["height"], True)
            planes |= {i: p for g, ps in zip(groups, got, strict=True) for i, p in zip(g, ps, strict=True)}
    if head is None or len(planes) != len(head["parts"]):
        raise ValueError("components are missing")
    return np.stack([np.array(planes[p[0]], np.uint16) for p in head["parts"]], axis=2), head["bits"]


def golomb_table(k: int) -> list[tuple[int, int]]:
    """For each byte: the value and length of the code of order k that it begins with, (0, 0) where that is longer than a byte."""
    out = []
    for byte in range(256):
        q = 8 - byte.bit_length()
        size = q + 1 + k
        out.append((q << k | byte >> 8 - size & (1 << k) - 1, size) if size <= 8 else (0, 0))
    return out
