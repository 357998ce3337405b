"""High-throughput coding of wavelet code-blocks in quads of 2 x 2 samples: the frame of ITU-T T.814 without its tables.

Three streams: adaptive run lengths say which quads are all zero, a prefix code says which samples of a quad aren't, and
sign and magnitude of those follow as they are. The prefix code is a small one of our own (the standard's tables are
not in public code that this library may use), so the streams are for this library's blocks, not for T.814 files.
"""

from __future__ import annotations

import numpy as np

#: The logarithm of the run that each state of the run coder stands for.
RUNS = (0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5)
#: Codes of the patterns with one sample; the others are 1111 and four bits.
SINGLE = {8: "100", 4: "101", 2: "110", 1: "1110"}


class BitWriter:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def done(self) -> bytes:
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


class BitReader:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("stream is cut short")
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | b
        self.at += n
        return out


def doubling_runs(data: bytes, n: int) -> list[tuple[int, int]]:
    """n symbols of the simple run coder and its state after each: 0 is a run of 2**state zeros (state up), 1 a one (state down)."""
    bits, state, run, out = BitReader(data), 0, 0, []
    while len(out) < n:
        if run:
            run, symbol = run - 1, 0
        elif bits.take(1):
            state, symbol = max(0, state - 1), 1
        else:
            run, state, symbol = (1 << state) - 1, min(12, state + 1), 0
        out.append((symbol, state))
    return out


def put_runs(symbols: list[int]) -> bytes:
    """Zeros and ones by adaptive run lengths: 1 is a whole run, 0 and its length a run that a one ends."""
    out, state, run = BitWriter(), 0, 0
    for s in symbols:
        if s:
            out.put(0, 1)
            out.put(run, RUNS[state])
            state, run = max(0, state - 1), 0
            continue
        run += 1
        if run == 1 << RUNS[state]:
            out.put(1, 1)
            state, run = min(len(RUNS) - 1, state + 1), 0
    if run:  # the reader stops before the end of this run
        out.put(1, 1)
    return out.done()


def read_runs(data: bytes, n: int) -> list[int]:
    bits, state, out = BitReader(data), 0, []
    while len(out) < n:
        if bits.take(1):
            out += [0] * (1 << RUNS[state])
            state = min(len(RUNS) - 1, state + 1)
        else:
            out += [0] * bits.take(RUNS[state]) + [1]
            state = max(0, state - 1)
    return out[:n]


def put_pattern(out: BitWriter, rho: int) -> None:
    code = SINGLE.get(rho)
    if code:
        out.put(int(code, 2), len(code))
    else:
        out.put(0b1111 << 4 | rho, 8)


def read_pattern(bits: BitReader) -> int:
    if not bits.take(1):
        raise ValueError("unknown pattern")
    two = bits.take(2)
    if two < 3:
        return (8, 4, 2)[two]
    return bits.take(4) if bits.take(1) else 1


def quads(values: np.ndarray) -> np.ndarray:
    """Quads in the order of rows of them, four samples each: upper left, upper right, lower left, lower right."""
    h, w = values.shape
    padded = np.zeros((-(-h // 2) * 2, -(-w // 2) * 2), np.int64)
    padded[:h, :w] = values
    return padded.reshape(padded.shape[0] // 2, 2, padded.shape[1] // 2, 2).swapaxes(1, 2).reshape(-1, 4)


def contexts(values: np.ndarray) -> np.ndarray:
    """Of each quad, whether one to the left or above (and beside that) has a sample other than zero."""
    h, w = -(-values.shape[0] // 2), -(-values.shape[1] // 2)
    hit = np.zeros((h + 1, w + 2), bool)
    hit[1:, 1:-1] = quads(values).any(1).reshape(h, w)
    return (hit[1:, :-2] | hit[:-1, 1:-1] | hit[:-1, :-2] | hit[:-1, 2:]).astype(np.int64)


def encode(values: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The streams of runs, of patterns, and of magnitudes and signs."""
    own = quads(values)
    patterns, sizes = BitWriter(), BitWriter()
    wide = int(np.abs(own).max(initial=0)).bit_length()
    sizes.put(wide, 6)
    rho = (own != 0) @ np.array([1, 2, 4, 8])
    for r, quad in zip(rho.tolist(), own.tolist(), strict=True):
        if not r:
            continue
        put_pattern(patterns, r)
        deep = max(abs(v) for v in quad).bit_length()  # the quad's own depth, then sign and magnitude of each sample
        sizes.put(deep, max(1, wide.bit_length()))
        for v in filter(None, quad):
            sizes.put(v < 0, 1)
            sizes.put(abs(v) - 1, deep)
    return put_runs((rho != 0).astype(int).tolist()), patterns.done(), sizes.done()


def decode(streams: tuple[bytes, bytes, bytes], height: int, width: int) -> np.ndarray:
    h, w = -(-height // 2), -(-width // 2)
    out = np.zeros((h * w, 4), np.int64)
    patterns, sizes = BitReader(streams[1]), BitReader(streams[2])
    wide = sizes.take(6)
    for i, hit in enumerate(read_runs(streams[0], h * w)):
        if not hit:
            continue
        rho = read_pattern(patterns)
        deep = sizes.take(max(1, wide.bit_length()))
        for k in range(4):
            if rho >> k & 1:
                minus = sizes.take(1)
                size = sizes.take(deep) + 1
                out[i, k] = -size if minus else size
    return out.reshape(h, w, 2, 2).swapaxes(1, 2).reshape(2 * h, 2 * w)[:height, :width]
