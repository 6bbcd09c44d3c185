"""Words of many texts at once, in numpy: spans over the Arrow buffer and a 64-bit hash of each word.

Used inside Arrow functions. Everything works on slices of a batch of about ``SLICE`` bytes, so that
memory stays bounded whatever the lengths of the texts are; a longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Give memory that is free back to the system: workers are kept between tasks, and what they hold counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """An Arrow function that gives its memory back when its partition ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit constants that look random."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_EXACT = constants(11, 256)
_BYTE = _EXACT.copy()
#: A-Z count as a-z.
_BYTE[65:91] = _BYTE[97:123]
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE
    while size < n:
        size *= 2
    if size not in _powers:
        with np.errstate(over="ignore"):
            up, down = np.full(size + 1, U64(_BASE)), np.full(size + 1, U64(_INVERSE))
            up[0] = down[0] = 1
            found = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > SLICE:  # a very long text: not kept
            return found
        _powers[size] = found
    return _powers[size]


@dataclass
class Words:
    """The words of the texts of a slice."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at the end
    offsets: np.ndarray  # first byte of each text, and the number of bytes at the end

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; ``fold``: A-Z and a-z alike."""
        n = len(self.data)
        up, down = powers(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum((_BYTE if fold else _EXACT)[self.data] * up[:n], out=sums[1:])
            h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
            return mix(h + (self.ends - self.starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def find(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` (or of another table of separators) of texts that lie one after another."""
    inside = ~space[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    begin[at] = inside[at]
    last = offsets[1:][full] - 1
    stop[last] = inside[last]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets), offsets)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``size`` bytes."""
    data, offsets = buffers(texts)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def runs(hashes: np.ndarray, first: np.ndarray, width: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all runs of ``width`` words that lie within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = hashes[:n] * weights[0]
        for j in range(1, width):
            total += hashes[j : n + j] * weights[j]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[:n] == owner[width - 1 :]
    return mix(total[inside]), owner[:n][inside]
