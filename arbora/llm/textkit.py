"""Vectorised words, word hashes and shingles over Arrow string columns.

All functions work on whole texts as UTF-8 bytes.  A word's 64-bit hash is a
sum over its bytes, each one's random value times that of its place in the
word, taken from prefix sums, so a batch of texts costs a few passes over one
byte array instead of a Python object for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LENGTH = U64(0x9E3779B97F4A7C15)

#: ASCII upper case to lower case; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but space and U+0009 to U+000D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Words are runs of digits, lower-case ASCII letters and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_places = [np.zeros(0, U64)]


def _place_values(n: int) -> np.ndarray:
    """An odd pseudo-random multiplier for each place in a word."""
    if len(_places[0]) < n:
        _places[0] = mix(np.arange(max(n, 1 << 12), dtype=U64) + U64(0xD1B54A32D192ED03)) | U64(1)
    return _places[0]


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], U64))[0])


def parts(batch: pa.RecordBatch, text: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in slices with about ``limit`` bytes in the text column, so that copies made of a slice stay small beside it."""
    column = batch.column(text)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    for a, b in spans_of_rows(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), limit):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that a task no longer uses back to the machine: Python workers outlive their tasks.

    What a task's variables still hold stays, so it lets go of its last batch first.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_rows(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with about ``limit`` bytes; a longer text is a run alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, their hashes, each row's word offsets, and the prefix sums for :func:`slices`."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64), np.zeros(1, U64)
    low = LOWER[data]
    inside = chars[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = _prefix_sums(low, starts, ends)
    return starts, ends, slices(sums, starts, ends), np.searchsorted(starts, offsets), sums


def _prefix_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over the bytes of all ranges, each byte's value times that of its place in its range.

    Places have values of their own, no powers of a base: modulo 2^64 those have words that always agree.
    """
    value = np.zeros(len(data) + 1, U64)
    size = ends - starts
    if len(size):
        # Places in the range: running numbers less that of the range's first byte.
        place = np.arange(int(size.sum()), dtype=np.int32 if size.sum() < 1 << 31 else np.int64)
        own = place + np.repeat((starts - np.cumsum(size) + size).astype(place.dtype), size)
        place -= np.repeat((np.cumsum(size) - size).astype(place.dtype), size)
        value[own + 1] = _BYTE[data[own]] * _place_values(int(size.max()))[place]
    return np.cumsum(value, out=value)


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words or beginnings of words, equal to those of words with the same bytes."""
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(U64) * _LENGTH)


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of disjoint byte ranges as they stand, without lower-casing."""
    return slices(_prefix_sums(data, starts, ends), starts, ends)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k successive words; windows over a row's end are included and must be left out by the caller."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    m = len(hashes) - k + 1
    out = np.zeros(m, U64)
    for i in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[i : i + m]
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole short sequence, different from any window's by its length."""
    return mix(windows(hashes, len(hashes)) + U64(len(hashes)))[0]


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Each row's distinct shingles, ascending: k words each, the whole sequence if it has fewer, none without words."""
    rolled = windows(hashes, k)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield np.array([whole(hashes[a:b])], U64)
        else:
            yield np.zeros(0, U64)


def texts_in_runs(column: pa.Array, chars: np.ndarray = NOT_SPACE, limit: int = 1 << 19):
    """For runs of rows [a, b): (a, b, bytes, byte offsets, starts, ends, hashes, word offsets, prefix sums)."""
    data, offsets = utf8(column)
    for a, b in spans_of_rows(offsets, limit):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, part, own, *words(part, own, chars)
