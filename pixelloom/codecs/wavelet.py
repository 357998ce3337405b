"""Wavelet codestreams (ITU-T T.800, JPEG 2000 part 1): geometry, packets, and coding of whole images.

The reader takes tiles and tile parts, all five progression orders, layers, precincts, subsampled components, both
transforms, region-of-interest shifts, and markers around packets. The writer makes one layer with one tile part a tile.
Progression changes, packed headers and code-block styles other than segmentation symbols raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from . import codeblocks, lifting, segments

SIZ, COD, COC, QCD, QCC, RGN, SOT, SOD, EOC = 0x51, 0x52, 0x53, 0x5C, 0x5D, 0x5E, 0x90, 0x93, 0xD9
PROGRESSIONS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")
GAINS = (0, 1, 1, 2)
#: The colour transform of lossy coding, and its inverse's weights.
TO_YCC = np.array([(0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312)])
FROM_YCC = np.array([(1.0, 0.0, 1.402), (1.0, -0.344136, -0.714136), (1.0, 1.772, 0.0)])


def up(a: int, b: int) -> int:
    return -(-a // b)


class HeaderWriter:
    """Bits of a packet's header; the byte after 0xFF carries seven."""

    def __init__(self):
        self.out, self.value, self.free = bytearray(), 0, 8

    def put(self, value: int, n: int = 1) -> None:
        for k in range(n - 1, -1, -1):
            self.free -= 1
            self.value |= (value >> k & 1) << self.free
            if not self.free:
                self.out.append(self.value)
                self.free, self.value = 7 if self.value == 0xFF else 8, 0

    def done(self) -> bytes:
        if self.free < 8:
            self.out.append(self.value)
        return bytes(self.out)


class HeaderReader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.value = data, at, 0, 0

    def bit(self) -> int:
        if not self.left:
            if self.at >= len(self.data):
                raise ValueError("packet header is cut short")
            self.left = 7 if self.value == 0xFF else 8
            self.value = self.data[self.at]
            self.at += 1
        self.left -= 1
        return self.value >> self.left & 1

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def done(self) -> int:
        """The place after the header."""
        return self.at + (self.value == 0xFF)


class TagTree:
    """A quad tree of minima: which leaves lie under a threshold is told with few bits, as ancestors are told once."""

    def __init__(self, height: int, width: int, values: list[int] | None = None):
        self.shapes = [(height, width)]
        while self.shapes[-1] != (1, 1) and height * width:
            h, w = self.shapes[-1]
            self.shapes.append((up(h, 2), up(w, 2)))
        self.low = [[0] * (h * w) for h, w in self.shapes]
        self.known = [[False] * (h * w) for h, w in self.shapes]
        self.value = None
        if values is not None:
            self.value = [list(values)]
            for (h, w), (ph, pw) in zip(self.shapes, self.shapes[1:], strict=False):
                above = [1 << 30] * (ph * pw)
                for i, v in enumerate(self.value[-1]):
                    k = i // w // 2 * pw + i % w // 2
                    above[k] = min(above[k], v)
                self.value.append(above)

    def path(self, leaf: int) -> list[tuple[int, int]]:
        """Nodes from the root to a leaf."""
        y, x = divmod(leaf, self.shapes[0][1])
        return [(k, (y >> k) * self.shapes[k][1] + (x >> k)) for k in range(len(self.shapes) - 1, -1, -1)]

    def code(self, leaf: int, threshold: int, bits) -> bool:
        """Whether the leaf's value is under the threshold; bits.put is given the bits, or bits.bit gives them."""
        low = 0
        for k, i in self.path(leaf):
            low = max(low, self.low[k][i])
            while low < threshold and not self.known[k][i]:
                if self.value is None:
                    found = bits.bit()
                else:
                    found = int(self.value[k][i] <= low)
                    bits.put(found)
                if found:
                    self.known[k][i] = True
                else:
                    low += 1
            self.low[k][i] = low
        return self.known[k][i] and low < threshold


def put_passes(bits: HeaderWriter, n: int) -> None:
    """The number of coding passes, 1 to 164."""
    if n < 3:
        bits.put(2 * (n - 1), n)
    elif n < 6:
        bits.put(0b1100 | n - 3, 4)
    elif n < 37:
        bits.put(0b1111 << 5 | n - 6, 9)
    else:
        bits.put(0b111111111 << 7 | n - 37, 16)


def read_passes(bits: HeaderReader) -> int:
    if not bits.bit():
        return 1
    if not bits.bit():
        return 2
    if (n := bits.bits(2)) < 3:
        return 3 + n
    if (n := bits.bits(5)) < 31:
        return 6 + n
    return 37 + bits.bits(7)


@dataclass
class Style:
    """Coding style and steps of a component."""

    levels: int = 5
    block: tuple[int, int] = (6, 6)  # logarithms of a code-block's width and height
    flags: int = 0
    reversible: bool = True
    precincts: list[tuple[int, int]] = field(default_factory=list)  # of each resolution; none: the largest
    quantisation: int = 0
    guard: int = 2
    steps: list[tuple[int, int]] = field(default_factory=list)  # exponent and mantissa of each band
    shift: int = 0

    def step(self, band: int) -> tuple[int, int]:
        """Of a band in the order of the codestream; derived steps follow from the first."""
        if self.quantisation == 1:
            e, m = self.steps[0]
            return e - max(0, (band - 1) // 3), m
        if band >= len(self.steps):
            raise ValueError("steps are missing")
        return self.steps[band]

    def precinct(self, r: int) -> tuple[int, int]:
        return self.precincts[r] if self.precincts else (15, 15)


@dataclass
class Head:
    """Geometry and defaults of an image or a tile."""

    size: tuple[int, ...] = ()  # x1, y1, x0, y0, tile width, tile height, tile x0, tile y0
    parts: list[tuple[int, int, int]] = field(default_factory=list)  # bits (with sign), and steps across and down
    progression: int = 0
    layers: int = 1
    colour: int = 0
    markers: int = 0
    styles: dict[int, Style] = field(default_factory=dict)
    coded: dict[int, bytes] = field(default_factory=dict)  # what a component's own or the common markers say
    quantised: dict[int, bytes] = field(default_factory=dict)
    shifts: dict[int, int] = field(default_factory=dict)

    def copy(self) -> Head:
        return Head(self.size, self.parts, self.progression, self.layers, self.colour, self.markers, {}, dict(self.coded), dict(self.quantised), dict(self.shifts))

    def take(self, code: int, body: bytes, in_tile: bool = False) -> None:
        wide = 2 if len(self.parts) > 256 else 1
        if code == SIZ:
            n = struct.unpack(">H", body[34:36])[0]
            self.size = struct.unpack(">8I", body[2:34])
            self.parts = [(body[36 + 3 * i], body[37 + 3 * i], body[38 + 3 * i]) for i in range(n)]
            x1, y1, x0, y0, tw, th, tx, ty = self.size
            if not n or x1 <= x0 or y1 <= y0 or not (tw and th) or any(not (h and v) for _, h, v in self.parts) or tx > x0 or ty > y0:
                raise ValueError("image without tiles or samples")
        elif code == COD:
            self.markers, self.progression, self.layers, self.colour = body[0], body[1], int.from_bytes(body[2:4], "big"), body[4]
            if self.progression > 4 or not self.layers:
                raise ValueError("unknown progression")
            if in_tile:
                self.coded = {}
            self.coded[-1] = bytes([body[0] & 1]) + body[5:]
        elif code == COC:
            self.coded[int.from_bytes(body[:wide], "big")] = body[wide:]
        elif code == QCD:
            if in_tile:
                self.quantised = {}
            self.quantised[-1] = body
        elif code == QCC:
            self.quantised[int.from_bytes(body[:wide], "big")] = body[wide:]
        elif code == RGN:
            self.shifts[int.from_bytes(body[:wide], "big")] = body[wide + 1]
        elif code in (0x5F, 0x60, 0x61):
            raise ValueError("progression changes and packed headers are not supported")

    def style(self, c: int) -> Style:
        if c not in self.styles:
            cod, q = self.coded.get(c, self.coded.get(-1)), self.quantised.get(c, self.quantised.get(-1))
            if cod is None or q is None or len(cod) < 6 or not q:
                raise ValueError("coding style or steps are missing")
            n = cod[1]
            sizes = [(b & 15, b >> 4) for b in cod[6 : 7 + n]] if cod[0] & 1 else []
            if cod[4] & ~0x20 or n > 32 or (sizes and len(sizes) <= n):
                raise ValueError("coding style is not supported")
            kind = q[0] & 31
            steps = [(b >> 3, 0) for b in q[1:]] if not kind else [(v >> 11, v & 0x7FF) for v in (int.from_bytes(q[i : i + 2], "big") for i in range(1, len(q) - 1, 2))]
            self.styles[c] = Style(n, ((cod[2] & 15) + 2, (cod[3] & 15) + 2), cod[4], cod[5] == 1, sizes, kind, q[0] >> 5, steps, self.shifts.get(c, 0))
        return self.styles[c]


@dataclass
class Piece:
    """A code-block: its place in its band, and what packets have said of it."""

    band: Band
    x0: int
    y0: int
    x1: int
    y1: int
    data: bytes = b""
    zero: int = 0
    passes: int = 0
    length: int = 3
    planes: int = 0


@dataclass
class Band:
    kind: int
    number: int  # in the order of the codestream
    x0: int
    y0: int
    x1: int
    y1: int
    values: np.ndarray | None = None


@dataclass
class Precinct:
    """Of one resolution of a component: for each band the code-blocks (row by row) and the two tag trees."""

    place: tuple[int, int]  # y, x on the reference grid
    groups: list[tuple[int, int, list[Piece]]]
    trees: list[tuple[TagTree, TagTree]] = field(default_factory=list)


class Tile:
    """Bands, precincts and code-blocks of a tile."""

    def __init__(self, head: Head, number: int):
        self.head, self.number = head, number
        x1, y1, x0, y0, tw, th, tx, ty = head.size
        across = up(x1 - tx, tw)
        p, q = number % across, number // across
        self.x0, self.y0, self.x1, self.y1 = max(tx + p * tw, x0), max(ty + q * th, y0), min(tx + (p + 1) * tw, x1), min(ty + (q + 1) * th, y1)
        if self.x0 >= self.x1 or self.y0 >= self.y1:
            raise ValueError("tile outside the image")
        self.resolutions: list[list[tuple[list[Band], list[Precinct]]]] = [[self.resolution(c, r) for r in range(head.style(c).levels + 1)] for c in range(len(head.parts))]

    def area(self, c: int) -> tuple[int, int, int, int]:
        _, h, v = self.head.parts[c]
        return up(self.x0, h), up(self.y0, v), up(self.x1, h), up(self.y1, v)

    def resolution(self, c: int, r: int) -> tuple[list[Band], list[Precinct]]:
        style, (_, h, v) = self.head.style(c), self.head.parts[c]
        area, scale = self.area(c), 1 << style.levels - r
        x0, y0, x1, y1 = (up(a, scale) for a in area)
        bands = []
        for kind in (codeblocks.LOW,) if not r else (codeblocks.HL, codeblocks.LH, codeblocks.HH):
            half = 1 << style.levels - r + (r > 0)
            dx, dy = (half // 2 if kind in (codeblocks.HL, codeblocks.HH) else 0), (half // 2 if kind in (codeblocks.LH, codeblocks.HH) else 0)
            bands.append(Band(kind, 0 if not r else 3 * r - 3 + kind, *(up(a - d, half) for a, d in zip(area, (dx, dy, dx, dy), strict=True))))
        px, py = style.precinct(r)
        if r and not (px and py):
            raise ValueError("precincts are too small")
        precincts = []
        for j in range(y0 >> py, up(y1, 1 << py)) if x1 > x0 and y1 > y0 else ():
            for i in range(x0 >> px, up(x1, 1 << px)):
                place = max(self.y0, (j << py) * scale * v), max(self.x0, (i << px) * scale * h)
                groups = []
                for b in bands:
                    wx, wy = px - (r > 0), py - (r > 0)
                    bx0, by0, bx1, by1 = max(b.x0, i << wx), max(b.y0, j << wy), min(b.x1, i + 1 << wx), min(b.y1, j + 1 << wy)
                    cx, cy = min(style.block[0], wx), min(style.block[1], wy)
                    if bx0 >= bx1 or by0 >= by1:
                        groups.append((0, 0, []))
                        continue
                    columns, rows = range(bx0 >> cx, up(bx1, 1 << cx)), range(by0 >> cy, up(by1, 1 << cy))
                    pieces = [Piece(b, max(bx0, x << cx), max(by0, y << cy), min(bx1, x + 1 << cx), min(by1, y + 1 << cy)) for y in rows for x in columns]
                    groups.append((len(rows), len(columns), pieces))
                precincts.append(Precinct(place, groups))
        return bands, precincts

    def packets(self) -> Iterator[tuple[int, Precinct]]:
        """Layer and precinct of each packet in the order of the progression."""
        every = []
        for c, own in enumerate(self.resolutions):
            for r, (_, precincts) in enumerate(own):
                for k, p in enumerate(precincts):
                    y, x = p.place
                    for layer in range(self.head.layers):
                        every.append(((layer, r, c, k), (r, layer, c, k), (r, y, x, c, k, layer), (y, x, c, r, k, layer), (c, y, x, r, k, layer), layer, p))
        every.sort(key=lambda e: e[self.head.progression])
        return ((e[5], e[6]) for e in every)


def read_packet(data: bytes, at: int, layer: int, precinct: Precinct, markers: int) -> int:
    """Takes one packet's contributions; returns the place after it."""
    if data[at : at + 2] == b"\xff\x91":
        at += 6
    bits, taken = HeaderReader(data, at), []
    if not precinct.trees:
        precinct.trees = [(TagTree(h, w), TagTree(h, w)) for h, w, _ in precinct.groups]
    if bits.bit():
        for (_, _, pieces), (inclusion, zeros) in zip(precinct.groups, precinct.trees, strict=True):
            for i, piece in enumerate(pieces):
                if piece.passes:
                    if not bits.bit():
                        continue
                elif not inclusion.code(i, layer + 1, bits):
                    continue
                else:
                    zero = 1
                    while not zeros.code(i, zero, bits):
                        zero += 1
                        if zero > 80:
                            raise ValueError("too many empty bit planes")
                    piece.zero = zero - 1
                many = read_passes(bits)
                while bits.bit():
                    piece.length += 1
                taken.append((piece, many, bits.bits(piece.length + many.bit_length() - 1)))
    at = bits.done()
    if data[at : at + 2] == b"\xff\x92":
        at += 2
    for piece, many, size in taken:
        if at + size > len(data):
            raise ValueError("packet is cut short")
        piece.data += data[at : at + size]
        piece.passes += many
        at += size
    return at


def write_packet(precinct: Precinct) -> bytes:
    """The only packet of a precinct: all its code-blocks in one layer."""
    bits, body = HeaderWriter(), []
    bits.put(1)
    for h, w, pieces in precinct.groups:
        inclusion = TagTree(h, w, [0 if p.passes else 1 for p in pieces])
        zeros = TagTree(h, w, [p.zero for p in pieces])
        for i, p in enumerate(pieces):
            inclusion.code(i, 1, bits)
            if not p.passes:
                continue
            for zero in range(1, p.zero + 2):
                zeros.code(i, zero, bits)
            put_passes(bits, p.passes)
            free = p.passes.bit_length() - 1
            more = max(0, len(p.data).bit_length() - free - 3)
            bits.put((1 << more + 1) - 2, more + 1)
            bits.put(len(p.data), 3 + more + free)
            body.append(p.data)
    return bits.done() + b"".join(body)


def tile_parts(data: bytes) -> tuple[Head, list[tuple[int, int, int, Head | None, bytes]]]:
    """The main header, and of each tile part its tile, number and place, what its own header changes, and its packets."""
    data = segments.codestream(data)
    if data[:2] != b"\xff\x4f":
        raise ValueError("no start of codestream")
    main, parts, at = Head(), [], 2
    tiles: dict[int, Head] = {}
    while True:
        code, body, after = _segment(data, at)
        if code == SOT:
            break
        if code == EOC:
            break
        main.take(code, body)
        at = after
    if not main.size:
        raise ValueError("main header without geometry")
    while at + 2 <= len(data):
        code, body, after = _segment(data, at)
        if code == EOC:
            break
        if code != SOT or len(body) != 8:
            raise ValueError("tile part is missing")
        tile, size, part, _ = struct.unpack(">HIBB", body)
        start, at, own = at, after, tiles.setdefault(tile, main.copy())
        while True:
            code, body, after = _segment(data, at)
            at = after
            if code == SOD:
                break
            own.take(code, body, True)
        end = start + size if size else len(data) - (2 if data.endswith(b"\xff\xd9") else 0)
        if end > len(data) or end < at:
            raise ValueError("tile part is cut short")
        parts.append((tile, part, start, own, data[at:end]))
        at = end
    return main, parts


def _segment(data: bytes, at: int) -> tuple[int, bytes, int]:
    if at + 2 > len(data) or data[at] != 0xFF:
        raise ValueError("codestream is cut short")
    code = data[at + 1]
    if code in (SOD, EOC):
        return code, b"", at + 2
    size = int.from_bytes(data[at + 2 : at + 4], "big")
    if size < 2 or at + 2 + size > len(data):
        raise ValueError("segment is cut short")
    return code, data[at + 4 : at + 2 + size], at + 2 + size


def _band_step(style: Style, bits: int, band: Band) -> float:
    e, m = style.step(band.number)
    return 2.0 ** (bits + GAINS[band.kind] - e) * (1 + m / 2048)


def _read_bands(tile: Tile, c: int) -> None:
    style, bits = tile.head.style(c), (tile.head.parts[c][0] & 127) + 1
    for bands, precincts in tile.resolutions[c]:
        for b in bands:
            b.values = np.zeros((max(0, b.y1 - b.y0), max(0, b.x1 - b.x0)), np.int64 if style.reversible else float)
        for precinct in precincts:
            for _, _, pieces in precinct.groups:
                for p in (p for p in pieces if p.passes):
                    b = p.band
                    planes = style.guard + style.step(b.number)[0] - 1 + style.shift - p.zero
                    if not 0 < planes < 64 or p.passes > 3 * planes - 2:
                        raise ValueError("more coding passes than bit planes")
                    got, last = codeblocks.decode(p.data, p.x1 - p.x0, p.y1 - p.y0, b.kind, planes, p.passes, bool(style.flags & 0x20))
                    size = np.abs(got)
                    middle = np.where(size > 0, 1 << last, 0) if last else 0 * size
                    if style.shift:
                        size = np.where(size >> style.shift, size >> style.shift, size)
                    if style.reversible:
                        size = size + middle // 2
                    else:
                        size = (size + np.where(size > 0, 0.5 * (1 << last), 0)) * _band_step(style, bits, b)
                    b.values[p.y0 - b.y0 : p.y1 - b.y0, p.x0 - b.x0 : p.x1 - b.x0] = np.sign(got) * size


def _planes(tile: Tile) -> list[np.ndarray]:
    """Samples of each component of a tile, after the colour transform and level shift, not yet clipped."""
    out = []
    for c, own in enumerate(tile.resolutions):
        _read_bands(tile, c)
        x0, y0, _, _ = tile.area(c)
        details = [tuple(b.values for b in bands) for bands, _ in own[1:]]
        out.append(lifting.unlevels(own[0][0][0].values, details, y0, x0, tile.head.style(c).reversible))
    if tile.head.colour and len(out) >= 3:
        if tile.head.style(0).reversible:
            y, u, v = out[:3]
            g = y - (u + v >> 2)
            out[:3] = v + g, g, u + g
        else:
            out[:3] = np.tensordot(FROM_YCC, np.stack(out[:3]), 1)
    return [p if bits & 128 else p + (1 << (bits & 127)) for p, (bits, _, _) in zip(out, tile.head.parts, strict=True)]


def _tiles(data: bytes) -> tuple[Head, list[Tile]]:
    """The main header and the tiles, with what their packets say of code-blocks."""
    main, parts = tile_parts(data)
    bodies: dict[int, tuple[Head, bytes]] = {}
    for tile, _, _, head, body in parts:
        bodies[tile] = head, bodies.get(tile, (head, b""))[1] + body
    if len(bodies) != up(main.size[0] - main.size[6], main.size[4]) * up(main.size[1] - main.size[7], main.size[5]):
        raise ValueError("tiles are missing")
    tiles = []
    for number, (head, body) in sorted(bodies.items()):
        tile, at = Tile(head, number), 0
        for layer, precinct in tile.packets():
            at = read_packet(body, at, layer, precinct, head.markers)
        tiles.append(tile)
    return main, tiles


def code_blocks(data: bytes) -> list[tuple]:
    """tile, component, resolution, band, y, x, height, width, passes and bytes of each code-block."""
    out = []
    for tile in _tiles(data)[1]:
        for c, own in enumerate(tile.resolutions):
            for r, (_, precincts) in enumerate(own):
                for p in (p for precinct in precincts for _, _, pieces in precinct.groups for p in pieces):
                    out.append((tile.number, c, r, ("LL", "HL", "LH", "HH")[p.band.kind], p.y0, p.x0, p.y1 - p.y0, p.x1 - p.x0, p.passes, len(p.data)))
    return out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (height x width x components) and bits a sample; subsampled components are repeated."""
    main, tiles = _tiles(data)
    x1, y1, x0, y0 = main.size[:4]
    if any(b != main.parts[0][0] or b & 128 or b > 15 for b, _, _ in main.parts):
        raise ValueError("components of one depth, without sign, of at most 16 bits are needed")
    bits = main.parts[0][0] + 1
    whole = [np.zeros((up(y1, v) - up(y0, v), up(x1, h) - up(x0, h)), np.int64) for _, h, v in main.parts]
    for tile in tiles:
        for c, plane in enumerate(_planes(tile)):
            cx0, cy0, cx1, cy1 = tile.area(c)
            dx, dy = up(x0, main.parts[c][1]), up(y0, main.parts[c][2])
            whole[c][cy0 - dy : cy1 - dy, cx0 - dx : cx1 - dx] = np.clip(np.floor(plane + 0.5) if plane.dtype.kind == "f" else plane, 0, (1 << bits) - 1)
    y, x = np.arange(y0, y1), np.arange(x0, x1)
    out = [p[np.minimum(y // v - up(y0, v), len(p) - 1).clip(0)[:, None], np.minimum(x // h - up(x0, h), p.shape[1] - 1).clip(0)] for p, (_, h, v) in zip(whole, main.parts, strict=True)]
    return np.stack(out, axis=2).astype(np.uint8 if bits <= 8 else np.uint16), bits


def step_code(step: float, depth: int) -> tuple[int, int]:
    """Exponent and mantissa of a step for coefficients of `depth` bits (a band's gain included)."""
    power = int(np.floor(np.log2(step)))
    return depth - power, int((step / 2.0**power - 1) * 2048)


def encode(pixels: np.ndarray, bits: int = 8, levels: int = 5, reversible: bool = True, step: float = 0.25, tile: int = 0, progression: str = "LRCP", block: int = 6, precinct: int = 15, boxed: bool = False) -> bytes:
    """pixels: height x width x components. step: of all bands, where not reversible; tile, 2**block, 2**precinct: sides; boxed: in a file of boxes."""
    height, width, n = pixels.shape
    if not pixels.size or not 1 <= bits <= 16 or int(pixels.max()) >> bits or not 0 <= levels <= 32 or not 2 <= block <= 6 or not 1 <= precinct <= 15:
        raise ValueError("samples or options are out of range")
    head = Head((width, height, 0, 0, tile or width, tile or height, 0, 0), [(bits - 1, 1, 1)] * n, PROGRESSIONS.index(progression), 1, int(n == 3))
    # The colour differences of the reversible transform need one bit more; two guard bits hold it.
    depths = [bits + GAINS[b] for b in (0, *(1, 2, 3) * levels)]
    steps = [(d, 0) for d in depths] if reversible else [step_code(step, d) for d in depths]
    if not all(0 <= e < 32 for e, _ in steps):
        raise ValueError("step is out of range")
    sizes = [(precinct, precinct)] * (levels + 1) if precinct < 15 else []
    style = Style(levels, (block, block), 0, reversible, sizes, 0 if reversible else 2, 2, steps)
    head.styles = dict.fromkeys(range(n), style)
    siz = struct.pack(">H8IH", 0, *head.size, n) + bytes([bits - 1, 1, 1]) * n
    cod = bytes([int(bool(sizes)), head.progression, 0, 1, head.colour, levels, block - 2, block - 2, 0, int(reversible)]) + bytes(b << 4 | a for a, b in sizes)
    qcd = bytes([style.guard << 5 | style.quantisation]) + (bytes(e << 3 for e, _ in steps) if reversible else b"".join(struct.pack(">H", e << 11 | m) for e, m in steps))
    out = [b"\xff\x4f", *(segments.segment(c, p) for c, p in ((SIZ, siz), (COD, cod), (QCD, qcd)))]
    for number in range(up(width, head.size[4]) * up(height, head.size[5])):
        body = _write_tile(Tile(head, number), pixels, bits)
        out += [segments.segment(SOT, struct.pack(">HIBB", number, len(body) + 14, 0, 1)), b"\xff\x93", body]
    stream = b"".join([*out, b"\xff\xd9"])
    if not boxed:
        return stream
    colour = bytes([1, 0, 0]) + struct.pack(">I", 16 if n == 3 else 17)
    inner = segments.box("ihdr", struct.pack(">IIHBBBB", height, width, n, bits - 1, 7, 0, 0)) + segments.box("colr", colour)
    return segments.JP2_SIGNATURE + segments.box("ftyp", b"jp2 \0\0\0\0jp2 ") + segments.box("jp2h", inner) + segments.box("jp2c", stream)


def _write_tile(tile: Tile, pixels: np.ndarray, bits: int) -> bytes:
    style = tile.head.style(0)
    own = pixels[tile.y0 : tile.y1, tile.x0 : tile.x1].astype(np.int64) - (1 << bits - 1)
    planes = [own[..., c] for c in range(own.shape[2])]
    if tile.head.colour:
        if style.reversible:
            r, g, b = planes
            planes = [r + 2 * g + b >> 2, b - g, r - g]
        else:
            planes = list(np.tensordot(TO_YCC, np.stack(planes).astype(float), 1))
    for c, plane in enumerate(planes):
        low, details = lifting.levels(plane, tile.y0, tile.x0, style.levels, style.reversible)
        for (bands, precincts), values in zip(tile.resolutions[c], [(low,), *details], strict=True):
            for b, v in zip(bands, values, strict=True):
                b.values = v if style.reversible else (np.sign(v) * np.floor(np.abs(v) / _band_step(style, bits, b))).astype(np.int64)
            for precinct in precincts:
                for _, _, pieces in precinct.groups:
                    for p in pieces:
                        b = p.band
                        p.data, p.planes, p.passes = codeblocks.encode(b.values[p.y0 - b.y0 : p.y1 - b.y0, p.x0 - b.x0 : p.x1 - b.x0], b.kind)
                        p.zero = style.guard + style.step(b.number)[0] - 1 - p.planes
                        if p.zero < 0:
                            raise ValueError("step is too small for the guard bits")
    return b"".join(write_packet(p) for _, p in tile.packets())
