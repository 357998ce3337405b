"""Fixed values of the public image coding standards, stated as they stand there."""

#: The example luminance quantisation table (row by row).
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]

#: Rows of the transform from RGB, and the weights of Cb and Cr in R, G and B.
RGB_TO_YCBCR = [(0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312)]
YCBCR_TO_RGB = [(0.0, 1.402), (-0.344136, -0.714136), (1.772, 0.0)]


def zigzag() -> list[int]:
    """The row-major place of each scan place: diagonals of growing sum, every other one upwards."""
    return [8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]


def scaled(quality: int) -> list[int]:
    """The luminance table at a quality of 1 to 100."""
    factor = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (q * factor + 50) // 100)) for q in LUMINANCE]


#: Of the standard's luminance code tables, the number of codes of each length from 1 to 16.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
AC_COUNTS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
#: The symbols (run and size, a hexadecimal digit each) of the AC codes of up to 15 bits, in the order of their codes.
AC_SHORT = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71,
    0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
]


def ac_symbols() -> list[int]:
    """All symbols of the AC table: those of 16 bits follow in their own order, runs 0 to 15 with sizes 1 to 10."""
    every = [run << 4 | size for run in range(16) for size in range(1, 11)]
    return AC_SHORT + [s for s in every if s not in AC_SHORT]


def lengths(counts: list[int]) -> list[int]:
    """The length of each code of a table, in the order of its symbols."""
    return [n + 1 for n, many in enumerate(counts) for _ in range(many)]
