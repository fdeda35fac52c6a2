"""Vectorised 64-bit hashes of byte ranges, for numpy code inside tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed together.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(n + 1 + n // 2, b, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.multiply.accumulate(x)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Ranges:
    """Hashes of ranges of one array of bytes or of 64-bit hashes, each in a few operations."""

    def __init__(self, data: np.ndarray):
        self._sum(data if data.dtype == np.uint64 else _VALUES[data])

    def _sum(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of what stands from start to stop; equal ranges have equal hashes wherever they stand."""
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class GramRanges(Ranges):
    """The same for ranges of at least 8 bytes, made of the mixed 8 bytes at each position, so that no periodic or mirrored text is special."""

    def __init__(self, data: np.ndarray):
        data = np.ascontiguousarray(data)
        at_each = np.ndarray((max(0, len(data) - 7),), np.dtype("<u8"), data, strides=(1,)) if len(data) >= 8 else np.zeros(0, np.uint64)
        self._sum(mix(at_each ^ np.uint64(_BASE)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return super().of(start, stop - 7)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.fill_null("").cast(pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose bytes fill about a block: first row, row after the last."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, last
        first = last
