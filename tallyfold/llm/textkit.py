"""Vectorised helpers for tasks that read whole texts as Arrow batches.

All functions work on the UTF-8 bytes of a batch at once, so no Python object
is made per word.  They hold a few arrays of eight bytes per text byte; callers
cut a batch into pieces with :func:`pieces` to bound that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word: blank and \\x09-\\x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.random.default_rng(977).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)

#: Text bytes handled at once; one longer text is handled alone.
PIECE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each begins (one more at the end). Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, or a single row."""
    starts = utf8(batch.column(column))[1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(starts, starts[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each text's words begin (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = ~SEPARATOR[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power = np.full(len(data), _MULT, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[LOWER[data] if lower else data] * power, out=total[1:])
    back = np.full(len(data), _MULT_INV, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, starts)


def spans(data: np.ndarray, starts: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and where each text's words begin (one more at the end). ``separator`` tells the bytes between words."""
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[starts] = True
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | cut[1:-1]
    begin = np.flatnonzero(fresh)
    fresh = inside
    fresh[:-1] &= ~inside[1:] | cut[1:-1]
    end = np.flatnonzero(fresh) + 1
    return begin, end, np.searchsorted(begin, starts)


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, each followed by ``gap`` blanks, and where each begins (one more at the end)."""
    size = end - begin + gap
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    index = np.ones(at[-1], np.int64)
    if len(begin):
        # Steps of one inside a span, and a jump at each beginning.
        index[0] = begin[0]
        index[at[1:-1]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
        np.cumsum(index, out=index)
    joined = data[np.minimum(index, len(data) - 1)] if len(index) else np.zeros(0, np.uint8)
    for k in range(gap):
        joined[at[1:] - 1 - k] = 0x20
    return joined, at


def coded(joined: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the words that stand one after the other in ``joined`` from ``at`` on, equal for equal words, and the distinct words by number."""
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(joined)])
    found = held.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def digests(held: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some words (large binary, none of them empty), the same wherever it is worked out."""
    if not len(held):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8)
    data = np.frombuffer(held.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    long = np.diff(at)
    power = np.full(int(long.max()), _MULT, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.add.reduceat(_BYTE_CODES[data] * power[np.arange(len(data)) - np.repeat(at[:-1], long)], at[:-1])
    return mix(total + long.astype(np.uint64) * _LANES[0])


def word_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the distinct words by number."""
    ids, distinct = coded(*gathered(data, begin, end))
    return ids.astype(np.int64), distinct


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; a shorter text is one run."""
    n = len(hashes)
    if n >= size:
        runs = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            runs += hashes[i : n - size + 1 + i] * _LANES[i]
        runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            short = np.sum(hashes[a:b] * _LANES[size : size + b - a], dtype=np.uint64, keepdims=True)
            yield mix(short + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
