"""Coding by the public standard ITU-T T.81, in numpy but for the bit-serial reading of codes.

The writer makes each scan's code tables from the scan's own symbols, or takes the standard's; the reader takes any table, and baseline, extended, progressive and lossless Huffman-coded frames. Blocks that reach over the image's edge
are filled with mid-gray. Arithmetic and hierarchical frames raise ValueError.
"""

from __future__ import annotations

import re

import numpy as np

from pixelloom.functions import fixed

from . import segments

SCAN = np.array(fixed.zigzag())
_U, _X = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
BASIS = np.where(_U == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _X + 1) * _U * np.pi / 16)
FORWARD = np.array(fixed.RGB_TO_YCBCR)
CHROMA = np.array(fixed.YCBCR_TO_RGB)


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """Rows x columns of 64 samples less 128."""
    h, w = plane.shape
    padded = np.zeros((-(-h // 8) * 8, -(-w // 8) * 8))
    padded[:h, :w] = plane - 128.0
    return padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).swapaxes(1, 2)


def levels_of(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients in scan order of each block."""
    c = BASIS @ blocks_of(plane) @ BASIS.T
    c = c.reshape(*c.shape[:2], 64) / table
    return (np.sign(c) * np.floor(np.abs(c) + 0.5)).astype(np.int32)[..., SCAN]


def plane_of(levels: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The samples of blocks' levels, as whole numbers of 0 to 255."""
    c = np.zeros(levels.shape)
    c[..., SCAN] = levels
    rows, columns = levels.shape[:2]
    p = BASIS.T @ (c * table).reshape(rows, columns, 8, 8) @ BASIS
    return np.clip(np.floor(p.swapaxes(1, 2).reshape(rows * 8, columns * 8) + 128.5), 0, 255).astype(np.uint8)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of at most 16 bits by package-merge; one more place is kept, so that no code is all ones."""
    leaves = sorted((int(counts[s]), (int(s),)) for s in np.flatnonzero(counts))
    leaves = [(0, (-1,)), *leaves]
    merged: list = []
    for _ in range(16):
        merged = sorted(leaves + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2], strict=False)])
    lengths: dict[int, int] = {}
    for _, held in merged[: 2 * len(leaves) - 2]:
        for s in held:
            lengths[s] = lengths.get(s, 0) + 1
    return lengths


def table_of(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table's bytes, and code and length of each symbol."""
    lengths = code_lengths(counts)
    # The kept place is the rarest, so among the longest, and as the last of them it would get the code of all ones.
    order = sorted((s for s in lengths if s >= 0), key=lambda s: (lengths[s], s))
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at = was = 0
    for s in order:
        at <<= lengths[s] - was
        was = lengths[s]
        code[s], size[s] = at, was
        at += 1
    per = [sum(lengths[s] == n for s in order) for n in range(1, 17)]
    return bytes(per) + bytes(order), code, size


def stated_table(counts: list[int], symbols_: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The same of a table that is stated by its number of codes of each length and its symbols in order."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at, place = 0, 0
    for n, many in enumerate(counts, 1):
        at <<= 1
        for s in symbols_[place : place + many]:
            code[s], size[s] = at, n
            at += 1
        place += many
    return bytes(counts) + bytes(symbols_), code, size


def category(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def symbols(levels: np.ndarray, component: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks in coding order: block, table (0 DC, 1 AC), symbol, extra bits and how many, in the order of the stream."""
    n = len(levels)
    diff = levels[:, 0].astype(np.int64).copy()
    for c in np.unique(component):
        own = np.flatnonzero(component == c)
        before = np.concatenate([[0], levels[own[:-1], 0]])
        fresh = np.concatenate([[True], interval[own[1:]] != interval[own[:-1]]])
        diff[own] -= np.where(fresh, 0, before)
    block, k = np.nonzero(levels[:, 1:])
    value = levels[block, k + 1].astype(np.int64)
    first = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = k - np.where(first, -1, np.concatenate([[0], k[:-1]]) if len(k) else k) - 1
    long = run // 16
    skip = np.repeat(np.arange(len(block)), long)
    last = np.full(n, -1)
    last[block] = k  # places grow within a block, so the last one stays
    open_ = np.flatnonzero(last < 62)
    size = category(value)
    parts = [  # block, place, rank at the place, table, symbol, value, bits
        (np.arange(n), np.full(n, -1), 1, 0, category(diff), diff, category(diff)),
        (block[skip], k[skip], 0, 1, np.full(len(skip), 0xF0), np.zeros(len(skip), np.int64), np.zeros(len(skip), np.int64)),
        (block, k, 1, 1, (run % 16) * 16 + size, value, size),
        (open_, np.full(len(open_), 64), 0, 1, np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)),
    ]
    cat = [np.concatenate([np.broadcast_to(p[i], len(p[0])) for p in parts]) for i in range(7)]
    order = np.lexsort((cat[2], cat[1], cat[0]))
    at, _, _, table, symbol, value, bits = (c[order] for c in cat)
    return at, table, symbol, np.where(value < 0, value + (1 << bits) - 1, value), bits


def packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bits of all values one after another, filled up with ones, with a zero byte after each 0xFF."""
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bits = np.repeat(values, sizes) >> (np.repeat(sizes, sizes) - 1 - place) & 1
    full = np.concatenate([bits, np.ones(-total % 8, np.int64)]).astype(np.uint8)
    return np.packbits(full).tobytes().replace(b"\xff", b"\xff\x00")


def scan_bytes(planes: list[np.ndarray], ids: list[int], restart: int, standard: bool = False) -> bytes:
    """Tables, header and data of one scan; planes of levels of the same shape are interleaved block by block. standard: with the standard's luminance tables."""
    n = len(planes)
    levels = np.stack([p.reshape(-1, 64) for p in planes], axis=1).reshape(-1, 64)
    component = np.tile(np.arange(n), len(levels) // n)
    interval = np.arange(len(levels)) // n // restart if restart else np.zeros(len(levels), np.int64)
    at, kind, symbol, value, bits = symbols(levels, component, interval)
    if standard:
        tables = [stated_table(fixed.DC_COUNTS, list(range(12))), stated_table(fixed.AC_COUNTS, fixed.ac_symbols())]
        if any((tables[t][2][symbol[kind == t]] == 0).any() for t in (0, 1)):
            raise ValueError("a level is too large for the standard's tables")
    else:
        tables = [table_of(np.bincount(symbol[kind == t], minlength=256)) for t in (0, 1)]
    out = [segments.segment(segments.DHT, bytes([t << 4]) + tables[t][0]) for t in (0, 1)]
    out.append(segments.segment(segments.SOS, bytes([n, *(b for i in ids for b in (i, 0)), 0, 63, 0])))
    code = np.where(kind == 0, tables[0][1][symbol], tables[1][1][symbol])
    size = np.where(kind == 0, tables[0][2][symbol], tables[1][2][symbol])
    word, wide = code << bits | value, size + bits
    cuts = np.searchsorted(interval[at], np.arange(interval[-1] + 2))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i:
            out.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
        out.append(packed(word[a:b], wide[a:b]))
    return b"".join(out)


def encode(pixels: np.ndarray, quality: int = 75, restart: int = 0, planar: bool = False, progressive: bool = False, standard: bool = False) -> bytes:
    """pixels: height x width x 1 or 3 bytes. planar: one scan for each component instead of one for all; progressive: in several
    scans, without restarts; standard: with the standard's code tables instead of the scan's own."""
    from . import progressive as scans_of

    height, width, n = pixels.shape
    if n not in (1, 3) or pixels.dtype != np.uint8 or not pixels.size or (progressive and (restart or planar or standard)):
        raise ValueError("one or three components of bytes are needed, and options that go together")
    planes = pixels.astype(float)
    if n == 3:
        planes = np.clip(np.floor(planes @ FORWARD.T + np.array([0, 128, 128]) + 0.5), 0, 255)
    table = np.array(fixed.scaled(quality))
    levels = [levels_of(planes[:, :, i], table) for i in range(n)]
    out = [segments.segment(segments.SOI, bare=True), segments.segment(segments.DQT, bytes([0, *table[SCAN].tolist()]))]
    out.append(segments.segment(0xC2 if progressive else 0xC0, segments.frame_bytes(8, width, height, [(i + 1, 1, 1, 0) for i in range(n)])))
    if progressive:
        return b"".join([*out, scans_of.scans(levels), segments.segment(segments.EOI, bare=True)])
    if restart:
        out.append(segments.segment(segments.DRI, restart.to_bytes(2, "big")))
    for own in [[i] for i in range(n)] if planar else [list(range(n))]:
        out.append(scan_bytes([levels[i] for i in own], [i + 1 for i in own], restart, standard))
    return b"".join([*out, segments.segment(segments.EOI, bare=True)])


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff" * 8, 0, 8 * len(data)

    def peek16(self) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 3], "big") >> 8 - (self.at & 7) & 0xFFFF

    def symbol(self, table: dict) -> int:
        ahead = self.peek16()
        for size, codes in table.items():
            found = codes.get(ahead >> 16 - size)
            if found is not None:
                self.at += size
                if self.at > self.end:
                    raise ValueError("scan is cut short")
                return found
        raise ValueError("unknown code")

    def raw(self, n: int) -> int:
        v = self.peek16() >> 16 - n if n else 0
        self.at += n
        if self.at > self.end:
            raise ValueError("scan is cut short")
        return v

    def value(self, n: int) -> int:
        """A signed value of n bits; those that begin with 0 are negative."""
        if not n:
            return 0
        v = self.raw(n)
        return v if v >> n - 1 else v - (1 << n) + 1


def read_tables(payload: bytes, tables: dict) -> None:
    at = 0
    while at < len(payload):
        per = payload[at + 1 : at + 17]
        n = sum(per)
        if len(per) < 16 or at + 17 + n > len(payload):
            raise ValueError("code table is cut short")
        held, code, place = {}, 0, at + 17
        for size, many in enumerate(per, 1):
            code <<= 1
            if many:
                held[size] = {code + i: payload[place + i] for i in range(many)}
            code, place = code + many, place + many
        tables[payload[at]] = held
        at += 17 + n


def read_quantisers(payload: bytes, tables: dict) -> None:
    at = 0
    while at < len(payload):
        deep, size = payload[at] >> 4, 128 if payload[at] >> 4 else 64
        if at + 1 + size > len(payload):
            raise ValueError("quantisation table is cut short")
        raw = np.frombuffer(payload[at + 1 : at + 1 + size], ">u2" if deep else "u1").astype(np.int64)
        table = np.zeros(64, np.int64)
        table[SCAN] = raw
        tables[payload[at] & 15] = table
        at += 1 + size


def read_block(bits: Bits, dc: dict, ac: dict, out: np.ndarray, before: int) -> int:
    before += bits.value(min(bits.symbol(dc), 16))
    out[0] = before
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("coefficients overrun the block")
        out[k] = bits.value(size)
        k += 1
    return before


class Sequential:
    """A baseline scan's state; `block` takes the next block of its j-th component."""

    def __init__(self, tables: list[tuple[dict, dict]]):
        self.tables = tables
        self.restart()

    def restart(self) -> None:
        self.before = [0] * len(self.tables)

    def block(self, bits: Bits, j: int, out: np.ndarray) -> None:
        self.before[j] = read_block(bits, *self.tables[j], out, self.before[j])


def read_scan(data: bytes, head: dict, chosen: list[int], scan, restart: int, levels: dict) -> None:
    """Levels of the scan's components, whose numbers are chosen."""
    parts = head["parts"]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(chosen) == 1:  # blocks of the component alone, without those that only fill up units
        _, h, v, _ = parts[chosen[0]]
        across, down = -(-(-(-head["width"] * h // hmax)) // 8), -(-(-(-head["height"] * v // vmax)) // 8)
        shape = [(1, 1)]
    else:
        across, down = -(-head["width"] // (8 * hmax)), -(-head["height"] // (8 * vmax))
        shape = [parts[i][1:3] for i in chosen]
    pieces = re.split(rb"\xff[\xd0-\xd7]", data)
    units, each = across * down, restart or across * down
    if len(pieces) < -(-units // each):
        raise ValueError("scan is cut short")
    for first, piece in zip(range(0, units, each), pieces, strict=False):
        bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
        scan.restart()
        for unit in range(first, min(units, first + each)):
            for j, (i, (h, v)) in enumerate(zip(chosen, shape, strict=True)):
                for y in range(v):
                    for x in range(h):
                        scan.block(bits, j, levels[i][unit // across * v + y, unit % across * h + x])


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (height x width x components, RGB where there are three) and bits a sample."""
    from . import lossless, progressive

    head, codes, quantisers, levels, restart, seen, frame, exact = None, {}, {}, {}, 0, set(), 0, {}
    for at, code, payload in segments.walk(data):
        if code == segments.DHT:
            read_tables(payload, codes)
        elif code == segments.DQT:
            read_quantisers(payload, quantisers)
        elif code == segments.DRI:
            restart = int.from_bytes(payload[:2], "big")
        elif 0xC0 <= code <= 0xCF and code != 0xCC:
            if code > lossless.SOF3 or (code != lossless.SOF3 and payload[:1] != b"\x08"):
                raise ValueError(f"{segments.name_of(code)} frames of this depth are not supported")
            head, frame = segments.frame(payload), code
            hmax, vmax = (max(p[i] for p in head["parts"]) for i in (1, 2))
            across, down = -(-head["width"] // (8 * hmax)), -(-head["height"] // (8 * vmax))
            if code != lossless.SOF3:
                levels = {i: np.zeros((down * v, across * h, 64), np.int32) for i, (_, h, v, _) in enumerate(head["parts"])}
            elif any(p[1:3] != (hmax, vmax) for p in head["parts"]) or not 2 <= head["bits"] <= 16:
                raise ValueError("lossless components of one sampling and 2 to 16 bits are needed")
        elif code == segments.SOS:
            if head is None or not payload or len(payload) < 4 + 2 * payload[0]:
                raise ValueError("scan without a frame")
            number = {p[0]: i for i, p in enumerate(head["parts"])}
            first, last, approximation = payload[1 + 2 * payload[0] : 4 + 2 * payload[0]]
            chosen, tables = [], []
            for who, which in zip(payload[1 : 1 + 2 * payload[0] : 2], payload[2 : 2 + 2 * payload[0] : 2], strict=True):
                own = codes.get(which >> 4), codes.get(0x10 | which & 15)
                needed = own if frame < 0xC2 else own[:1] if not first and not approximation >> 4 or frame == lossless.SOF3 else own[1:] if first else ()
                if who not in number or None in needed:
                    raise ValueError("scan of unknown components or tables")
                chosen.append(number[who])
                tables.append(own)
            start = at + 4 + len(payload)
            body = data[start : segments.scan_end(data, start)]
            if frame == lossless.SOF3:
                got = lossless.read_planes(body, head["width"], head["height"], head["bits"], first, approximation & 15, [t for t, _ in tables], restart)
                exact |= dict(zip(chosen, got, strict=True))
            else:
                scan = progressive.Scan((first, last, approximation >> 4, approximation & 15), tables) if frame == 0xC2 else Sequential(tables)
                read_scan(body, head, chosen, scan, restart, levels)
            seen |= set(chosen)
    if exact and len(exact) == len(head["parts"]):
        return np.stack([exact[i] for i in range(len(exact))], axis=2).astype(np.uint8 if head["bits"] <= 8 else np.uint16), head["bits"]
    if head is None or exact or len(seen) != len(head["parts"]) or any(p[3] not in quantisers for p in head["parts"]):
        raise ValueError("components or tables are missing")
    h, w = head["height"], head["width"]
    planes = []
    for i, (_, ph, pv, table) in enumerate(head["parts"]):
        plane = plane_of(levels[i], quantisers[table])
        planes.append(plane[(np.arange(h) * pv // vmax)[:, None], np.arange(w) * ph // hmax])
    out = np.stack(planes, axis=2)
    if len(planes) == 3:
        y, c = out[..., :1].astype(float), out[..., 1:].astype(float) - 128
        out = np.clip(np.floor(y + c @ CHROMA.T + 0.5), 0, 255).astype(np.uint8)
    return out, head["bits"]
