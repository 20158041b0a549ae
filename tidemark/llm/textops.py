"""Whole-batch numpy operations on UTF-8 texts: words, their hashes, and runs of rows with one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; the arrays for them take about 60 times as much.
SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_UP, _DOWN = [], []  # powers of _BASE and of its inverse modulo 2^64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together, and each one's start; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    large = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(starts, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(starts: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with ``most`` bytes together, or one longer text."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP or len(_UP[0]) < n:
        size = max(n, SLICE + 1)
        _UP[:], _DOWN[:] = [np.full(size, _BASE, np.uint64)], [np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)]
        for p in (_UP[0], _DOWN[0]):
            p[0] = 1
            np.cumprod(p, out=p)
    return _UP[0], _DOWN[0]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hashes modulo 2^64; those of a stretch come from its two ends."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def stretch(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, equal for equal bytes anywhere."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words don't cross texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    own = starts[:-1][starts[1:] > starts[:-1]]
    first[own] = word[own]
    ends = own[1:] - 1
    last[ends] = word[ends]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(starts, begin, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z made small, and its text's number. A long text goes in parts that end at white space."""
    found, at = [], 0
    while at < len(data) or not found:
        end = len(data)
        if end - at > 2 * SLICE:
            ends = np.flatnonzero(SPACE[data[at + SLICE : at + 2 * SLICE]])
            if len(ends):
                end = at + SLICE + int(ends[0])
        first, last = int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, end, "left"))
        begin, stop, text = words(data[at:end], np.clip(starts[first : last + 1], at, end) - at)
        found.append((stretch(prefix_hashes(LOWER[data[at:end]]), begin, stop), text + first))
        at = end
    return np.concatenate([h for h, _ in found]), np.concatenate([t for _, t in found])


def runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(key):
        return []
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True))


def whole_groups(batches, key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of a sorted stream cut anew so that no group of equal keys is divided; groups must be of bounded size."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        if kept and kept[-1].column(key)[0].as_py() == values[-1]:
            kept.append(batch)
            continue
        others = np.flatnonzero(values != values[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        head = [*kept, *([batch.slice(0, cut)] if cut else [])]
        if head:
            yield pa.Table.from_batches(head).combine_chunks().to_batches()[0]
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
