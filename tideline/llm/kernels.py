"""Vectorised text helpers that run inside tasks on slices of an Arrow batch.

Texts stay one byte buffer with offsets; words, hashes and n-gram windows are numpy arrays over
a slice of about ``SLICE`` bytes, so a task's memory follows its longest text, not its batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Whitespace that parts words: space and the five ASCII controls 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's body that gives its memory back to the machine when it ends: the worker stays for later tasks, and for other stages' peaks."""
    @functools.wraps(run)
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return body


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + SLICE // 4)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, _BASE, np.uint64))
            down = np.cumprod(np.full(size, _BASE_INVERSE, np.uint64))
        if size > 8 * SLICE:
            return up, down
        _powers["up"], _powers["down"] = up, down
    return _powers["up"], _powers["down"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``values[start:end]``, equal for equal spans wherever they lie."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of ``size`` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * _BASE + hashes[k : k + n]
    return mix(out)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    raw, offsets = buffers(col)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's first word as offsets."""
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = ~IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    here, before = solid[1:], solid[:-1]
    starts = np.flatnonzero(here[:-1] & (~before[:-1] | first[:-1]))
    ends = np.flatnonzero(before[1:] & (~here[1:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element, the index of the text it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their offsets by text.

    A text of 1 to ``size - 1`` words has one shingle, its whole word sequence; one without words has none.
    """
    starts, ends, first = word_spans(raw, offsets)
    hashes = span_hashes(raw, starts, ends)
    counts = np.diff(first)
    full = windows(hashes, size)
    owner = owners(first)
    inside = np.zeros(len(full), bool)
    if len(full):
        inside = owner[: len(full)] == owner[size - 1 :]
    short = np.flatnonzero((counts > 0) & (counts < size))
    values, texts = full[inside], owner[: len(full)][inside]
    if len(short):
        values = np.concatenate([values, span_hashes(hashes, first[short], first[short + 1])])
        texts = np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        values, texts = values[order], texts[order]
    return values, np.searchsorted(texts, np.arange(len(offsets)))
