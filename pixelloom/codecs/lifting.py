"""Wavelet lifting on arrays (ITU-T T.800, annex F): one line, planes of any origin, and several levels.

`start` is the place of the first sample: even places become low, odd ones high. Ends are mirrored. One sample alone is
its own low, or half of its high.
"""

from __future__ import annotations

import numpy as np

#: The four steps of the 9/7 transform and its scale.
STEPS_97 = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971)
SCALE_97 = 1.230174104914001


def _sides(n: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(n)
    return at[(at + start) % 2 == 0], at[(at + start) % 2 == 1], np.abs(at - 1), n - 1 - np.abs(n - 2 - at)


def forward(a: np.ndarray, start: int, reversible: bool) -> np.ndarray:
    """Along the first axis; places stay."""
    a = a.astype(np.int64 if reversible else float)
    if len(a) < 2:
        return a * 2 if len(a) and start % 2 else a
    even, odd, left, right = _sides(len(a), start)
    around = lambda i: a[left[i]] + a[right[i]]
    if reversible:
        a[odd] -= around(odd) >> 1
        a[even] += around(even) + 2 >> 2
        return a
    for k, weight in enumerate(STEPS_97):
        own = even if k % 2 else odd
        a[own] += weight * around(own)
    a[odd] *= SCALE_97
    a[even] /= SCALE_97
    return a


def inverse(a: np.ndarray, start: int, reversible: bool) -> np.ndarray:
    a = a.astype(np.int64 if reversible else float)
    if len(a) < 2:
        return (a >> 1 if reversible else a / 2) if len(a) and start % 2 else a
    even, odd, left, right = _sides(len(a), start)
    around = lambda i: a[left[i]] + a[right[i]]
    if reversible:
        a[even] -= around(even) + 2 >> 2
        a[odd] += around(odd) >> 1
        return a
    a[odd] /= SCALE_97
    a[even] *= SCALE_97
    for k in (3, 2, 1, 0):
        own = even if k % 2 else odd
        a[own] -= STEPS_97[k] * around(own)
    return a


def split(plane: np.ndarray, y0: int, x0: int, reversible: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LL, HL, LH and HH of a plane whose first sample stands at (y0, x0): columns first, then rows."""
    a = forward(forward(plane, y0, reversible).T, x0, reversible).T
    y, x = y0 % 2, x0 % 2
    return a[y::2, x::2], a[y::2, 1 - x :: 2], a[1 - y :: 2, x::2], a[1 - y :: 2, 1 - x :: 2]


def merge(bands: tuple, y0: int, x0: int, reversible: bool) -> np.ndarray:
    """The inverse of split: rows first, then columns."""
    ll, hl, lh, hh = bands
    a = np.zeros((ll.shape[0] + lh.shape[0], ll.shape[1] + hl.shape[1]), np.int64 if reversible else float)
    y, x = y0 % 2, x0 % 2
    a[y::2, x::2], a[y::2, 1 - x :: 2], a[1 - y :: 2, x::2], a[1 - y :: 2, 1 - x :: 2] = ll, hl, lh, hh
    return inverse(inverse(a.T, x0, reversible).T, y0, reversible)


def levels(plane: np.ndarray, y0: int, x0: int, n: int, reversible: bool) -> tuple[np.ndarray, list[tuple]]:
    """The last LL and (HL, LH, HH) of each level, coarsest first."""
    out = []
    for _ in range(n):
        plane, *rest = split(plane, y0, x0, reversible)
        out.append(tuple(rest))
        y0, x0 = -(-y0 // 2), -(-x0 // 2)
    return plane, out[::-1]


def unlevels(low: np.ndarray, details: list[tuple], y0: int, x0: int, reversible: bool) -> np.ndarray:
    """The inverse of levels; (y0, x0) is the origin of the whole plane."""
    n = len(details)
    for k, rest in enumerate(details):
        scale = 1 << n - 1 - k
        low = merge((low, *rest), -(-y0 // scale), -(-x0 // scale), reversible)
    return low
