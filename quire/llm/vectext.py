"""Words, lines and n-grams of a whole Arrow batch of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer one stands alone.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a plain word: ASCII but for letters and digits.
PLAIN_END = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def forget() -> None:
    """Gives the tables of powers back; they are made anew when needed."""
    _powers.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Several texts as one byte array. data: bytes; at: where each begins, and the end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.n = len(at) - 1

    def spans(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes b with not ends[b], within texts: starts, ends, and where each text's runs begin."""
        inside = ~ends[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = self.at[1:-1]
        edge = edge[(edge > 0) & (edge < len(inside))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The \\n-split lines, empty ones too: starts, ends, and where each text's lines begin."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([breaks, self.at[1:]]), kind="stable")
        per = np.diff(np.searchsorted(breaks, self.at)) + 1
        return starts, ends, np.concatenate([[0], np.cumsum(per)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
        """64-bit hashes of the spans; equal bytes have equal hashes."""
        data = LOWER[self.data] if fold_case else self.data
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def sums(self, values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums of values by text; at: where each text's values begin (by default: one value for each byte)."""
        at = self.at if at is None else at
        kind = np.float64 if values.dtype.kind == "f" else np.int64
        total = np.zeros(len(values) + 1, kind)
        np.cumsum(values, out=total[1:])
        return total[at[1:]] - total[at[:-1]]


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Texts]]:
    """The texts of a column (null: empty), SLICE_BYTES at a time: first row, past the last, Texts."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_binary()).fill_null(b"")
        _, where, held = chunk.buffers()
        at = np.frombuffer(where, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(chunk):
            end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1)
            yield row, end, Texts(data[at[row] : at[end]], at[row : end + 1] - at[row])
            row = end


def inner(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Whether the window of `width` values that begins at each of n values stays in its text."""
    last = np.repeat(at[1:], np.diff(at))
    return np.arange(n) + width <= last
