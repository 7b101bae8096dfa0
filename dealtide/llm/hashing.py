"""Words and word windows of many texts as 64-bit numbers, and the packed exchange of such numbers between tasks.

Texts are hashed from their UTF-8 bytes, whole batches at a time. Numbers travel in packets, one per batch of texts and part
of the number range, with fixed-width columns laid out by byte, which compress well. Within a batch a number
is sent a bounded number of times, so one that occurs in a third of all documents fills no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text makes a batch of its own.
GROUP_BYTES = 6 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
_BYTES = _random.integers(0, 2**64, 256, np.uint64)
_SMALL = _BYTES.copy()
_SMALL[65:91] = _BYTES[97:123]
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


#: Powers a worker keeps; more, for a very long text, are made anew each time, so that no task leaves large tables behind.
KEPT_POWERS = 1 << 20


def powers(count: int, inverse: bool = False) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64."""
    key = "inverse" if inverse else "base"
    held = _powers.get(key)
    if held is None or len(held) < count:
        held = np.full(max(count, KEPT_POWERS), _INVERSE if inverse else _BASE, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if len(held) == KEPT_POWERS:
            _powers[key] = held
    return held[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about GROUP_BYTES; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + GROUP_BYTES, "right")) - 1)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all words; ``fold`` takes A-Z for a-z."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_SMALL if fold else _BYTES)[data] * powers(len(data)), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(len(data), True)[starts])
    return np.searchsorted(offsets, starts, "right") - 1, hashes


def windows(texts: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all windows of ``width`` words that lie in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
    at = np.flatnonzero(texts[:n] == texts[width - 1 :])
    return at, mixed((sums[at + width] - sums[at]) * powers(len(hashes), True)[at] + np.uint64(width))


def planes(values: np.ndarray) -> bytes:
    """Fixed-width numbers with their equal-valued bytes side by side."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted ``values``: run number of each, start of each run, length of each run."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(first)
    return np.cumsum(first) - 1, starts, np.diff(np.append(starts, len(values)))


def by_part(part: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices in order) of every part that occurs."""
    order = np.argsort(part.astype(np.uint16 if count <= 65535 else np.uint32), kind="stable")
    edges = np.searchsorted(part[order], np.arange(count + 1))
    for n in range(count):
        if edges[n] < edges[n + 1]:
            yield n, order[edges[n] : edges[n + 1]]


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
