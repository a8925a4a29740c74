"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes outside ``0x20, 0x09-0x0D``; in UTF-8 these bytes never
occur inside another character, so byte positions and words agree with the
character classes of the query contracts.  Everything works on the whole Arrow
buffer of a batch: no Python loop over words.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
SHORT = 64  # bytes of a word that is hashed eight bytes at a time; a longer one goes through BLAKE2


class Words(NamedTuple):
    """All words of a batch. ``row_first`` has one more entry than rows."""

    starts: np.ndarray  # byte offsets in ``data``
    ends: np.ndarray
    hashes: np.ndarray  # uint64
    row_first: np.ndarray  # index of each row's first word
    row_bytes: np.ndarray  # byte offset of each row's text
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """At every byte the eight bytes from there on as an integer (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def masked(blocks: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``left`` bytes of each block of eight (all if more are left)."""
    gone = np.uint64(8) * (np.uint64(8) - np.clip(left, 1, 8).astype(np.uint64))
    return blocks & (np.uint64(0xFFFFFFFFFFFFFFFF) >> gone)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes.

    Blocks of eight bytes pass one after the other through a nonlinear mixer, so no
    two strings collide by their structure, as they do for a polynomial modulo 2**64.
    """
    lengths = ends - starts
    blocks = eights(data)
    hashes = mix(lengths.astype(np.uint64) + np.uint64(BASE))
    alive, at = np.flatnonzero(lengths <= SHORT), 0
    while len(alive):
        hashes[alive] = mix(hashes[alive] ^ masked(blocks[starts[alive] + at], lengths[alive] - at))
        at += 8
        alive = alive[lengths[alive] > at]
    for i in np.flatnonzero(lengths > SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def releasing(f):
    """A function over batches that hands its freed memory back at its end.

    Spark keeps Python workers for later tasks; what an allocator holds on to
    would count against the executor all that time.
    """

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text (one row at least)."""
    if len(batch) == 0:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def spaces_table(also: bytes = b"") -> np.ndarray:
    """Which bytes separate words: white space and the bytes ``also``."""
    table = np.zeros(256, bool)
    table[[32, *range(9, 14), *also]] = True
    return table


SPACES = spaces_table()


def words_of(column: pa.Array, lower: bool = True, spaces: np.ndarray = SPACES) -> Words:
    """Words of every row with a 64-bit hash each; A-Z are lowered if asked."""
    data, offsets = text_buffer(column)
    if lower:
        upper = (data - np.uint8(65)) < np.uint8(26)
        data = data | (upper.view(np.uint8) << np.uint8(5))
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), offsets, data)
    inside = ~spaces[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    finish = inside
    finish[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, offsets), offsets, data)


def gram_hashes(words: Words, width: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, first word index, row_first)`` of all ``width``-word grams.

    A row with fewer words has no gram, or with ``whole_if_short`` one gram of
    its whole word sequence (none for a row without words).
    """
    first = words.row_first
    counts = np.diff(first)
    n = len(words.hashes)
    grams = np.zeros(n, np.uint64)
    factor = 1
    with np.errstate(over="ignore"):
        for j in range(min(width, n)):
            factor = factor * BASE % (1 << 64)
            grams[:n - j] += words.hashes[j:] * np.uint64(factor)
    rows = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(n) + width <= first[1:][rows]
    grams = mix(grams)
    if whole_if_short:
        for r in np.flatnonzero((counts > 0) & (counts < width)):
            own = words.hashes[first[r]:first[r + 1]]
            value, factor = len(own), 1
            for h in own.tolist():
                factor = factor * BASE % (1 << 64)
                value = (value + h * factor) % (1 << 64)
            grams[first[r]] = mix(np.array([value], np.uint64))[0]
            keep[first[r]] = True
    kept = np.flatnonzero(keep)
    return grams[kept], kept, np.searchsorted(kept, first)
