"""Vectorised word segmentation and hashing of UTF-8 text held in Arrow buffers.

Everything here runs inside Spark tasks on one Arrow batch at a time and keeps no state, so
a lost task is simply run again with the same result.  Word and shingle identities are 64-bit
hashes; two different words (or shingles) of a corpus share one with a chance of about 2**-64
per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240501)
#: A random 64-bit value for each byte, and powers of an odd base for each position.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOW = 1 << 16


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW_POWERS = _powers(_BASE, _LOW)
_HIGH_POWERS = _powers(pow(_BASE, _LOW, 2**64), _LOW)

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of words split at ASCII white space.
SPACE_WORDS = ~ASCII_SPACE
#: Bytes of words of ASCII letters and digits and of all characters beyond ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column one after another, and each text's bounds; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place where it can be."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def word_hashes(column: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, and each text's bounds among them."""
    data, bounds = utf8_buffers(column)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    word_bounds = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), word_bounds
    return segment_hashes(data, inside, starts), word_bounds


def segment_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash for each segment from one of ``starts`` to the next, A-Z lower-cased, of its bytes that are ``inside``, which come first."""
    lengths = np.diff(starts, append=len(data))
    values = BYTE_VALUES[LOWER[data[starts[0] :]]]
    values *= inside[starts[0] :]
    place = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, lengths)
    if lengths.max() <= _LOW:
        values *= _LOW_POWERS[place]
    else:
        values *= _LOW_POWERS[place & (_LOW - 1)]
        values *= _HIGH_POWERS[(place >> 16) & (_LOW - 1)]
    return mix(np.add.reduceat(values, starts - starts[0]))


def hash_of_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``word_hashes`` gives to these words, each given lower-cased."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return word_hashes(pa.array([b"\x20".join(words)], type=pa.large_binary()), SPACE_WORDS)[0]


_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words of one text; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    size = min(width, len(words))
    count = len(words) - size + 1
    out = words[:count].copy()
    for k in range(1, size):
        out *= _STEP
        out += words[k : k + count]
    return mix(out + np.uint64(size))
