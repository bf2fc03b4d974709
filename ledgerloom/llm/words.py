"""Words of many texts at once: spans and 64-bit hashes over the UTF-8 buffer of an Arrow column.

A word's hash is a polynomial over its bytes, read off prefix sums, then mixed; runs of words are
hashed from the words' hashes. Nothing here loops over words in Python.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; a longer text is handled alone.
CHUNK_BYTES = (1 << 20) - 64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-case letters and digits of ASCII (capitals are folded), and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work, after which the worker hands freed memory back: it is reused by tasks that share the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # one that gives back what is freed
        try:
            yield from work(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):  # where there is such a call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _letters(folded: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if folded:
        table[65:91] = table[97:123]
    return table


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        filled = 1
        while filled < n:
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
            filled += more
        return out

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    return _powers(1 << max((int(n) - 1).bit_length(), CHUNK_BYTES.bit_length()))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about limit bytes."""
    data, offsets = buffer(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and for each row the number of words before it (one more entry than rows)."""
    inside = kind[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool) -> np.ndarray:
    """A 64-bit hash of each word; folded: capitals of ASCII count as small letters."""
    power, inverse = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_letters(folded)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n consecutive hashes; runs over the ends of rows are for the caller to leave out."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    factors = mix(np.arange(1 + 1000 * seed, n + 1 + 1000 * seed, dtype=np.uint64)) | np.uint64(1)
    out = words[: len(words) - n + 1] * factors[0]
    for i in range(1, n):
        out += words[i : len(words) - n + 1 + i] * factors[i]
    return mix(out)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """The row of each item, from the running number of items before each row."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def whole_runs(bounds: np.ndarray, n: int) -> np.ndarray:
    """The positions at which n words of one row begin."""
    total = int(bounds[-1])
    if total < n:
        return np.empty(0, np.int64)
    fits = np.ones(total, bool)
    edge = (bounds[1:, None] - np.arange(1, n)[None, :]).ravel() if n > 1 else np.empty(0, np.int64)
    fits[edge[edge >= 0]] = False
    # a row shorter than n - 1 words marks positions of the row before, which end too late as well
    return np.flatnonzero(fits)
