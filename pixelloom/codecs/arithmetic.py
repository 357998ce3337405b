"""The binary arithmetic coder of wavelet code-blocks (ITU-T T.800, annex C), both directions with one `code` method."""

from __future__ import annotations

#: Probability, next state after the more and the less probable symbol, and whether the symbols swap.
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]


class Contexts:
    """State and more probable symbol of each context."""

    def __init__(self, start: list[int]):
        self.state, self.likely = list(start), [0] * len(start)

    def move(self, ctx: int, as_likely: bool) -> None:
        _, after, otherwise, swap = STATES[self.state[ctx]]
        if as_likely:
            self.state[ctx] = after
        else:
            self.likely[ctx] ^= swap
            self.state[ctx] = otherwise


class Encoder(Contexts):
    def __init__(self, start: list[int]):
        super().__init__(start)
        self.range, self.low, self.free = 0x8000, 0, 12
        self.out = bytearray(1)  # the byte before the first is never put out; it may take no carry

    def code(self, ctx: int, bit: int) -> int:
        q = STATES[self.state[ctx]][0]
        self.range -= q
        as_likely = bit == self.likely[ctx]
        if as_likely and self.range & 0x8000:
            self.low += q
            return bit
        # The larger part of the interval goes to the more probable symbol.
        if as_likely == (self.range < q):
            self.range = q
        else:
            self.low += q
        self.move(ctx, as_likely)
        while not self.range & 0x8000:
            self.range <<= 1
            self.low <<= 1
            self.free -= 1
            if not self.free:
                self.byte()
        return bit

    def byte(self) -> None:
        if self.out[-1] != 0xFF and self.low >= 0x8000000:  # a carry
            self.out[-1] += 1
            self.low &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.low >> 20 & 0xFF)
            self.low &= 0xFFFFF
            self.free = 7
        else:
            self.out.append(self.low >> 19 & 0xFF)
            self.low &= 0x7FFFF
            self.free = 8

    def done(self) -> bytes:
        top = self.low + self.range
        self.low |= 0xFFFF
        if self.low >= top:
            self.low -= 0x8000
        for _ in range(2):
            self.low <<= self.free
            self.byte()
        return bytes(self.out[1:-1] if self.out[-1] == 0xFF else self.out[1:])


class Decoder(Contexts):
    def __init__(self, start: list[int], data: bytes):
        super().__init__(start)
        self.data, self.at = data + b"\xff\xff", 0
        self.value = self.data[0] << 16
        self.byte()
        self.value <<= 7
        self.left -= 7
        self.range = 0x8000

    def byte(self) -> None:
        data, at = self.data, self.at
        if data[at] == 0xFF:
            if at + 1 >= len(data) or data[at + 1] > 0x8F:  # a marker or the end: ones for ever
                self.value += 0xFF00
                self.left = 8
            else:
                self.at += 1
                self.value += data[at + 1] << 9
                self.left = 7
        else:
            self.at += 1
            self.value += data[at + 1] << 8
            self.left = 8

    def code(self, ctx: int, bit: None = None) -> int:
        q = STATES[self.state[ctx]][0]
        self.range -= q
        upper = self.value >> 16 >= q
        if upper:
            self.value -= q << 16
            if self.range & 0x8000:
                return self.likely[ctx]
        as_likely = upper != (self.range < q)
        if not upper:
            self.range = q
        out = self.likely[ctx] if as_likely else 1 - self.likely[ctx]
        self.move(ctx, as_likely)
        while not self.range & 0x8000:
            if not self.left:
                self.byte()
            self.range <<= 1
            self.value <<= 1
            self.left -= 1
        return out
