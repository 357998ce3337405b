"""Marker segments and boxes of still-image streams, read and written without touching pixels.

Everything raises ValueError on input that is cut short or contradicts itself; callers turn that into an error column.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

JP2_SIGNATURE = b"\x00\x00\x00\x0cjP  \r\n\x87\n"
APP8, SPIFF_END = 0xE8, b"\0\0\0\1"
SOI, EOI, SOS, DQT, DHT, DRI, SOF_LS, LSE = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xF7, 0xF8
#: All frame headers: also of kinds that are not decoded, as their geometry is the same.
FRAMES = (*(c for c in range(0xC0, 0xD0) if c not in (0xC4, 0xC8, 0xCC)), SOF_LS)

#: Names of the markers that are not one of a numbered family.
NAMES = {
    0xC4: "DHT", 0xCC: "DAC", 0xC8: "JPG", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP",
    0xF7: "SOF55", 0xF8: "LSE", 0xFE: "COM",
}
#: Markers of wavelet codestreams.
WAVELET_NAMES = {0x4F: "SOC", 0x50: "CAP", 0x51: "SIZ", 0x52: "COD", 0x53: "COC", 0x5C: "QCD", 0x5D: "QCC", 0x5E: "RGN", 0x64: "COM", 0x90: "SOT", 0x93: "SOD", 0xD9: "EOC"}


def name_of(code: int) -> str:
    if code in NAMES:
        return NAMES[code]
    for first, last, family in ((0xC0, 0xCF, "SOF"), (0xD0, 0xD7, "RST"), (0xE0, 0xEF, "APP")):
        if first <= code <= last:
            return f"{family}{code - first}"
    return f"0x{code:02X}"


def walk(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, code, payload) of each segment; coded data after a scan's header is passed over, up to the next real marker."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    yield 0, SOI, b""
    at, lossless_rules = 2, False
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        if data[at + 1] == 0xFF:  # fill byte
            at += 1
            continue
        code = data[at + 1]
        if code == EOI:
            yield at, code, b""
            return
        if at + 4 > len(data):
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise ValueError(f"segment {name_of(code)} is cut short")
        yield at, code, data[at + 4 : at + 2 + size]
        lossless_rules |= code == SOF_LS
        at += 2 + size
        if code == SOS:
            at = scan_end(data, at, lossless_rules)
    raise ValueError("no end of image")


def scan_end(data: bytes, at: int, lossless_rules: bool = False) -> int:
    """The place of the marker that ends a scan's data; restart markers belong to the data."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        code = data[at + 1]
        inside = code < 0x80 if lossless_rules else code == 0
        if not inside and not 0xD0 <= code <= 0xD7 and code != 0xFF:
            return at
        at += 1 if code == 0xFF else 2
    return len(data)


def segment(code: int, payload: bytes = b"", bare: bool = False) -> bytes:
    return bytes([0xFF, code]) + (b"" if bare else struct.pack(">H", len(payload) + 2) + payload)


def frame(payload: bytes) -> dict:
    """Precision, height, width and components (id, h, v, table) of a frame header."""
    if len(payload) < 6 or len(payload) < 6 + 3 * payload[5]:
        raise ValueError("frame header is cut short")
    bits, height, width, n = struct.unpack(">BHHB", payload[:6])
    parts = [(payload[6 + 3 * i], payload[7 + 3 * i] >> 4, payload[7 + 3 * i] & 15, payload[8 + 3 * i]) for i in range(n)]
    if not (height and width and n) or any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in parts):
        raise ValueError("frame header without samples")
    return {"bits": bits, "height": height, "width": width, "parts": parts}


def frame_bytes(bits: int, width: int, height: int, parts: list[tuple[int, int, int, int]]) -> bytes:
    return struct.pack(">BHHB", bits, height, width, len(parts)) + b"".join(bytes([i, h << 4 | v, t]) for i, h, v, t in parts)


def presets(payload: bytes) -> tuple[int, ...]:
    """The five preset parameters of a T.87 parameter segment; nothing where it holds mapping tables."""
    if payload[:1] == b"\1":
        if len(payload) < 11:
            raise ValueError("preset parameters are cut short")
        return struct.unpack(">5H", payload[1:11])
    if payload[:1] in (b"\2", b"\3"):
        return ()
    raise ValueError("parameter segment is of an unknown kind")


def presets_bytes(given: tuple[int, ...]) -> bytes:
    return b"\1" + struct.pack(">5H", *given)


#: Fields of a SPIFF header in order, and the components that a colour space needs (0: none may be said).
SPIFF_FIELDS = ("profile", "components", "height", "width", "colour_space", "bits", "compression", "resolution_units", "vertical", "horizontal")
SPIFF_COMPONENTS = {1: 3, 3: 3, 4: 3, 8: 1, 9: 3, 10: 3, 11: 3, 12: 4, 13: 3, 14: 4, 15: 4}
SPIFF_LOSSLESS = 6


def spiff(payload: bytes) -> dict | None:
    """The fields of an APP8 segment, where it is a SPIFF header."""
    if len(payload) < 30 or payload[:6] != b"SPIFF\0":
        return None
    return dict(zip(SPIFF_FIELDS, struct.unpack(">BBIIBBBBII", payload[8:30]), strict=True))


def spiff_bytes(width: int, height: int, components: int, bits: int, compression: int = SPIFF_LOSSLESS) -> bytes:
    space = {1: 8, 3: 10, 4: 12}.get(components, 2)
    return b"SPIFF\0\2\0" + struct.pack(">BBIIBBBBII", 0, components, height, width, space, bits, compression, 1, 96, 96)


def spiff_header(data: bytes) -> dict | None:
    """The first SPIFF header before the first scan, with `valid`: it says T.87 coding, and `fits`: it agrees with the frame."""
    found = None
    for _, code, payload in walk(data):
        if code == APP8 and found is None:
            found = spiff(payload)
        elif code in FRAMES and found:
            own = frame(payload)
            same = (found["components"], found["height"], found["width"], found["bits"]) == (len(own["parts"]), own["height"], own["width"], own["bits"])
            space = found["colour_space"] == 2 or SPIFF_COMPONENTS.get(found["colour_space"]) == found["components"]
            return found | {"valid": found["compression"] == SPIFF_LOSSLESS, "fits": same and space and found["resolution_units"] < 3 and min(found["vertical"], found["horizontal"]) > 0}
        elif code == SOS:
            break
    return None


def kind(data: bytes) -> str:
    """jpegls, jpeg, jp2, j2k or unknown, by the first bytes and, after a start of image, by the frame's marker."""
    if data.startswith(JP2_SIGNATURE):
        return "jp2"
    if data.startswith(b"\xff\x4f\xff\x51"):
        return "j2k"
    if not data.startswith(b"\xff\xd8"):
        return "unknown"
    try:
        for _, code, _ in walk(data):
            if code in (SOF_LS, LSE):
                return "jpegls"
            if code == SOS:
                break
    except ValueError:
        pass
    return "jpeg"


def boxes(data: bytes) -> Iterator[tuple[int, str, int, bytes]]:
    """(place, type, size, content) of the boxes at top level, and of those in the header box after it."""
    stack = [(0, len(data))]
    while stack:
        at, end = stack.pop()
        while at < end:
            if at + 8 > end:
                raise ValueError("box header is cut short")
            size, name = struct.unpack(">I4s", data[at : at + 8])
            head = 8
            if size == 1:
                if at + 16 > end:
                    raise ValueError("box header is cut short")
                size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                raise ValueError("box is cut short")
            text = name.decode("latin-1")
            yield at, text, size, data[at + head : at + size]
            if text == "jp2h":
                stack.append((at + head, at + size))
            at += size


def box(name: str, content: bytes) -> bytes:
    return struct.pack(">I4s", len(content) + 8, name.encode("latin-1")) + content


def profile(data: bytes) -> bytes | None:
    """The embedded colour profile, where a colour box has one."""
    return next((c[3:] for _, name, _, c in boxes(data) if name == "colr" and c[:1] == b"\x02"), None)


def codestream(data: bytes) -> bytes:
    if not data.startswith(JP2_SIGNATURE):
        return data
    for _, name, _, content in boxes(data):
        if name == "jp2c":
            return content
    raise ValueError("no codestream box")


def wavelet_header(data: bytes) -> dict:
    """Geometry, coding style and step sizes of a codestream's main header."""
    data = codestream(data)
    if data[:2] != b"\xff\x4f":
        raise ValueError("no start of codestream")
    out: dict = {"high_throughput": False}
    at = 2
    while True:
        if data[at : at + 2] in (b"\xff\x90", b"\xff\x93", b"\xff\xd9"):
            break
        if at + 4 > len(data):
            raise ValueError("main header is cut short")
        code, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if data[at] != 0xFF or size < 2 or len(body) != size - 2:
            raise ValueError("main header is cut short")
        if code == 0x51:
            x1, y1, x0, y0, tw, th, tx, ty, n = struct.unpack(">8IH", body[2:36])
            parts = [(body[36 + 3 * i], body[37 + 3 * i], body[38 + 3 * i]) for i in range(n)]
            if not (tw and th) or any(not (h and v) for _, h, v in parts):
                raise ValueError("image without tiles or samples")
            out |= {"width": x1 - x0, "height": y1 - y0, "components": n, "bits": (parts[0][0] & 127) + 1 if parts else 0, "signed": bool(parts and parts[0][0] & 128),
                    "tiles": -(-(x1 - tx) // tw) * -(-(y1 - ty) // th)}
        elif code == 0x52:
            out |= {"progression": body[1], "layers": int.from_bytes(body[2:4], "big"), "colour_transform": body[4], "levels": body[5], "reversible": body[9] == 1}
        elif code == 0x5C:
            out |= {"quantisation": body[0] & 31, "guard_bits": body[0] >> 5}
            out["steps"] = [b >> 3 for b in body[1:]] if not body[0] & 31 else [int.from_bytes(body[i : i + 2], "big") for i in range(1, len(body) - 1, 2)]
        elif code == 0x5E:
            wide = 2 if out.get("components", 1) > 256 else 1
            out.setdefault("shifts", {})[int.from_bytes(body[:wide], "big")] = body[wide + 1]
        elif code == 0x50:
            out["high_throughput"] = bool(int.from_bytes(body[:4], "big") & 1 << 14 or int.from_bytes(body[:4], "big") & 1 << 17)
        at += 2 + size
    if "width" not in out:
        raise ValueError("main header without geometry")
    return out


def tile_parts(data: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """place, tile, number, how many the tile has (0: unknown), size and place of the packets of each tile part."""
    data = codestream(data)
    wavelet_header(data)
    at, out = data.find(b"\xff\x90"), []
    while data[at : at + 2] == b"\xff\x90" and at >= 0:
        if at + 12 > len(data):
            raise ValueError("tile part is cut short")
        tile, size, part, many = struct.unpack(">HIBB", data[at + 4 : at + 12])
        body = at + 12
        while data[body : body + 2] != b"\xff\x93":
            if body + 4 > len(data) or data[body] != 0xFF:
                raise ValueError("tile part is cut short")
            body += 2 + int.from_bytes(data[body + 2 : body + 4], "big")
        end = at + size if size else len(data) - 2
        if end > len(data) or end < body + 2:
            raise ValueError("tile part is cut short")
        out.append((at, tile, part, many, end - at, body + 2))
        at = end
    return out


def codestream_markers(data: bytes) -> list[tuple[int, str, int]]:
    """place, name and payload size of each marker of a wavelet codestream; packets are passed over by the tile parts' sizes."""
    data = codestream(data)
    ends = {body: at + size for at, _, _, _, size, body in tile_parts(data)}
    at, out = 0, []
    while at + 2 <= len(data):
        code = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        bare = code in (0x4F, 0x93, 0xD9)
        size = 0 if bare else int.from_bytes(data[at + 2 : at + 4], "big") - 2
        out.append((at, WAVELET_NAMES.get(code, f"0x{code:02X}"), size))
        if code == 0xD9:
            break
        at += 2 if bare else size + 4
        if code == 0x93:
            at = ends[at]
    return out


def wavelet_header_bytes(width: int, height: int, components: int, bits: int, levels: int, reversible: bool, tile: int = 0) -> bytes:
    """The main header of a codestream without tile parts, and its end."""
    side = (tile or width, tile or height)
    siz = struct.pack(">H8IH", 0, width, height, 0, 0, *side, 0, 0, components) + bytes([bits - 1, 1, 1]) * components
    cod = bytes([0, 0]) + struct.pack(">HB", 1, int(components == 3)) + bytes([levels, 4, 4, 0, int(reversible)])
    gains = [0] + [g for _ in range(levels) for g in (1, 1, 2)]
    qcd = bytes([2 << 5]) + bytes((bits + g) << 3 for g in gains) if reversible else bytes([2 << 5 | 2]) + b"".join(struct.pack(">H", (bits + g) << 11) for g in gains)
    body = b"".join(segment(c, p) for c, p in ((0x51, siz), (0x52, cod), (0x5C, qcd)))
    return b"\xff\x4f" + body + b"\xff\xd9"


def info(data: bytes) -> dict:
    """format, width, height, components and bits, without decoding."""
    found = kind(data)
    if found in ("jp2", "j2k"):
        head = wavelet_header(data)
        return {"format": found, **{k: head[k] for k in ("width", "height", "components", "bits")}}
    for _, code, payload in walk(data):
        if code in FRAMES:
            head = frame(payload)
            return {"format": found, "width": head["width"], "height": head["height"], "components": len(head["parts"]), "bits": head["bits"]}
    raise ValueError("no frame header")
