"""Edit distance within a bound: banded and bit-parallel, many pairs at a time."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def within(a: list[str], b: list[str], most: int, together: int = 4096) -> np.ndarray:
    """Whether the edit distance (code points) of each pair is at most `most` (under 31)."""
    long = [np.frombuffer((x if len(x) >= len(y) else y).encode("utf-32-le", "surrogatepass"), np.uint32) for x, y in zip(a, b, strict=True)]
    short = [np.frombuffer((y if len(x) >= len(y) else x).encode("utf-32-le", "surrogatepass"), np.uint32) for x, y in zip(a, b, strict=True)]
    out = np.zeros(len(a), bool)
    order = np.argsort([len(x) for x in long], kind="stable")
    i = 0
    while i < len(order):
        # as many pairs as keep the padded characters bounded
        j = i + 1
        while j < len(order) and j - i < together and (j - i) * len(long[order[j]]) < 4_000_000:
            j += 1
        on = order[i:j]
        out[on] = _banded([long[k] for k in on], [short[k] for k in on], most)
        i = j
    return out


def _padded(rows: list[np.ndarray], before: int, after: int) -> np.ndarray:
    """(character, row): fill of 2**32 - 1 where there is none."""
    width = max(len(r) for r in rows) + before + after
    out = np.full((width, len(rows)), 0xFFFFFFFF, np.uint32)
    for k, r in enumerate(rows):
        out[before : before + len(r), k] = r
    return out


def _banded(long: list[np.ndarray], short: list[np.ndarray], most: int) -> np.ndarray:
    """The band of 2 * most + 1 diagonals lies in the low bits; its top bit is the diagonal `most` below the main one."""
    n1, n2 = np.array([len(x) for x in long]), np.array([len(x) for x in short])
    band = 2 * most + 1
    top = band - 1
    full = np.uint64((1 << band) - 1)
    pattern = _padded(long, most, band + int((n2 - n1).max(initial=0)) + most)
    text = _padded(short, 0, 1)
    vp = np.full(len(long), ((1 << (most + 1)) - 1) << (band - most - 1), np.uint64)
    vn = np.zeros(len(long), np.uint64)
    dist = np.full(len(long), most, np.int64)
    low = np.full(len(long), top - 1, np.int64)  # bit of the last row, once the diagonal has passed it
    for i in range(int(n2.max(initial=0))):
        pm = np.zeros(len(long), np.uint64)
        ch = text[i]
        for k in range(band):  # bit k: row i + k - most
            if i + k < len(pattern):
                pm |= (pattern[i + k] == ch).astype(np.uint64) << np.uint64(k)
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        on, diagonal = i < n2, i < n1 - most
        dist += on & diagonal & ((d0 >> np.uint64(top)) & ONE == 0)
        late = on & ~diagonal
        shift = np.maximum(low, 0).astype(np.uint64)
        dist += late & (low >= 0) & ((hp >> shift) & ONE == 1)
        dist -= (late & (low >= 0) & ((hn >> shift) & ONE == 1)).astype(np.int64)
        low -= late
        vp = (hn | ~((d0 >> ONE) | hp)) & full
        vn = (d0 >> ONE) & hp
    dist = np.where(n1 <= most, _short(long, short, n1, most), dist)
    return (dist <= most) & (n1 - n2 <= most)


def _short(long, short, n1, most):
    """Plain tables for strings no longer than the bound, where the band never lies inside."""
    out = np.full(len(long), most + 1)
    for k in np.flatnonzero(n1 <= most):
        row = list(range(len(short[k]) + 1))
        for x in long[k]:
            last, row[0] = row[0], row[0] + 1
            for j, y in enumerate(short[k], 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        out[k] = row[-1]
    return out
