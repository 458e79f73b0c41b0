"""Words, lines and their hashes over whole Arrow batches of text, vectorised.

Texts lie end to end in one byte array; a span is a pair of byte offsets. Hashes are 64 bits
wide: the value of a span as a polynomial, mixed. Where results must hold for any data
the operator that compares hashes says what a collision would do.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
#: For operators that share workers with others of a pipeline.
THRIFTY_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def give_back() -> None:
    """Return freed memory to the system: a worker that waits keeps none for tasks that are over."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, without this call
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about ``limit`` bytes, or are a single text."""
    for batch in batches:
        ends = text_offsets(batch.column(text))
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), n)
            yield batch.slice(start, stop - start)
            start = stop


def thrifty(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Small slices, and memory given back before the first and after the last."""
    give_back()
    yield from slices(batches, text, THRIFTY_BYTES)
    give_back()


def text_offsets(column: pa.Array) -> np.ndarray:
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        raise TypeError(f"text expected, not {column.type}")
    if not len(column):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and each text's offset, one more than rows."""
    if column.null_count:
        raise ValueError("fill null texts first")
    ends = text_offsets(column)
    data = column.buffers()[2] if len(column) else None
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes; a run ends with its text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    return starts, np.flatnonzero(inside & (~after | first[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the place of each text's first word."""
    starts, ends = runs(~SEPARATORS[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chain(hashes: np.ndarray) -> np.uint64:
    """A hash of a sequence of hashes."""
    value = 0x1234567
    for one in hashes.tolist():
        value = (value * 0xD6E8FEB86659FD93 + one) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([value], np.uint64))[0]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` hashes, texts not regarded."""
    n = max(0, len(hashes) - size + 1)
    value = np.zeros(n, np.uint64)
    for place in range(size):
        value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[place : place + n]
    return mix(value)


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's bigint."""
    return pa.array(values.view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)
