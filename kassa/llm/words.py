"""Vectorised word handling on Arrow text batches (numpy, no per-word Python).

A batch of texts is one contiguous UTF-8 buffer plus offsets. Words are runs of
"word bytes"; every delimiter of the operators here is ASCII, so byte classes
give exactly the words a code-point pattern gives.

Hashes have no structure that a text could be written against: a word's hash
adds a pseudo-random number for each byte at its place, a window's hash mixes
the hashes of its two halves, and each is finished with its length. (A polynomial
modulo 2^64 has known pairs of equal value, whatever its base.)
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_U = np.uint64
_LENGTH = _U(0xD6E8FEB86659FD93)
_LEFT = _U(0x9E3779B97F4A7C15)
_RIGHT = _U(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(delimiters) -> np.ndarray:
    """Boolean table of word bytes: everything but the given byte values."""
    table = np.ones(256, dtype=bool)
    table[list(delimiters)] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = byte_class([0x20, *range(0x09, 0x0E)])
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z became a-z).
ALNUM_WORDS = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BLOCK = 1 << 17                          # bytes hashed at once


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end] for ranges in order that do not overlap; a block of
    ranges at a time, so the numbers of all bytes are never held together."""
    out = np.empty(len(starts), dtype=_U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _BLOCK)))
        a, b = int(starts[lo]), int(ends[hi - 1])
        first, last = starts[lo:hi] - a, ends[lo:hi] - a
        place = np.arange(b - a, dtype=_U)
        place -= np.repeat(first.astype(_U), np.diff(np.append(first, b - a)))
        place <<= _U(8)
        place |= buf[a:b]
        place += _LEFT
        sums = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(mix(place), out=sums[1:])
        out[lo:hi] = mix(sums[last] - sums[first] + (last - first).astype(_U) * _LENGTH)
        lo = hi
    return out


class Words:
    """The words of a slice of texts: byte bounds, hashes, and per-document bounds.

    ``first[d]:first[d + 1]`` are the words of document ``d``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        inside = table[self.buf]
        n = len(inside)
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < n]
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n_docs = len(offsets) - 1

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return byte_hashes(self.buf, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i]:self.ends[i]].tobytes()

    def doc_of(self) -> np.ndarray:
        """The document (position in the slice) of every word."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def left_in_doc(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def window_hashes(word_hash: np.ndarray, starts: np.ndarray, length) -> np.ndarray:
    """Hash of ``word_hash[s:s + length]`` for every start (length: scalar or array)."""
    if not np.ndim(length):
        return _windows(word_hash, starts, int(length))
    out = np.empty(len(starts), dtype=_U)
    for n in np.unique(length):
        rows = length == n
        out[rows] = _windows(word_hash, starts[rows], int(n))
    return out


def _windows(word_hash: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Halves are doubled up to the length; the last two may overlap."""
    if not len(starts):
        return np.empty(0, dtype=_U)
    if not length:
        return mix(np.zeros(len(starts), dtype=_U))
    first = int(starts.min())
    now, size = word_hash[first:int(starts.max()) + length], 1
    while size < length:
        step = min(size, length - size)
        now = mix(now[:-step] * _LEFT + mix(now[step:] + _RIGHT))
        size += step
    return mix(now[starts - first] + _U(length * int(_LENGTH) % (1 << 64)))


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(lo, hi, buffer, offsets)`` of a text column, null as empty.

    A slice holds at most ``max_bytes`` unless one text alone is longer, so the
    memory of the numpy passes follows the slice, not the batch.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, data[a:b], offsets[lo:hi + 1] - a
        lo = hi


def tidy(run: Callable) -> Callable:
    """A batch function that gives freed memory back when its task ends: Spark
    keeps the worker process, and with it what the allocators hold on to."""
    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass                                   # not glibc


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of every range, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
