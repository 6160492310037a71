"""Vectorised text primitives shared by the Arrow-batched operators.

Texts of one Arrow batch are handled as one byte buffer: word limits come from a
256-entry byte table, word hashes from differences of a prefix sum of
``table[byte] * BASE**position`` (mod 2**64), so there is no loop over words or documents.
A batch is cut into chunks of about ``CHUNK`` bytes (whole texts, never parts of one) to
bound the memory of a Python worker; a single longer text gets a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None

CHUNK = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240501)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]

#: ASCII white space splits words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Everything in ASCII that is neither letter nor digit splits words; other bytes are word bytes.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that their order is as good as random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 limits of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, limits, data = column.buffers()
    if len(column) == 0 or limits is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    limits = np.frombuffer(limits, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[limits[0] : limits[-1]], limits - limits[0]


def release() -> None:
    """Gives freed memory back to the system; workers live on between tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(limits: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or of one longer row; memory is given back after the last."""
    at, n = 0, len(limits) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(limits, limits[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to
    release()


def words(data: np.ndarray, limits: np.ndarray, split: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the n+1 limits, in words, of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(limits), np.int64)
    inside = ~split[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = limits[:-1][limits[:-1] < limits[1:]]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, limits)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the given byte ranges; fold: without ASCII case."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_FOLDED if fold else _BYTES)[data] * power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def grams(h: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """Hash of h[i], h[i+step], ..., n of them; shorter than h by (n-1)*step. Limits of texts are the caller's."""
    size = max(0, len(h) - (n - 1) * step)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[i * step : i * step + size]
    return mix(out)


def within(limits: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the starts of windows of n words that lie within one text; total windows are there."""
    ok = np.ones(total, bool)
    if total and n > 1:
        for back in range(1, n):
            at = limits[1:] - back
            at = at[(at >= limits[:-1]) & (at < total)]
            ok[at] = False
    return ok


def owner(limits: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(limits) - 1), np.diff(limits))
