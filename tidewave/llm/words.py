"""Words of many texts at once: their places in the UTF-8 bytes and a 64-bit hash of each.

Works on the buffers of an Arrow column. A-Z count as a-z. A word is a run of bytes that a table
marks; as bytes of 0x80 and more are marked or unmarked together, runs of bytes are runs
of characters. The hash is a sum of random table entries by place and byte, not a polynomial, whose
collisions repeat in any text: two different words share one with a chance of about 2**-64, whatever they spell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]
DIGIT_OR_LETTER = np.zeros(256, bool)
DIGIT_OR_LETTER[48:58] = DIGIT_OR_LETTER[97:123] = DIGIT_OR_LETTER[128:] = True
LETTERS = DIGIT_OR_LETTER.copy()
LETTERS[48:58] = False

# A random number for each byte at each of the first places; later places mix in the number of their round.
PLACES = 64
TABLE = np.random.default_rng(20240607).integers(0, 2**64, PLACES * 256, dtype=np.uint64)
ROUND = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words, given their bytes one after the other and their lengths."""
    start = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(start, size)
    parts = TABLE[(place & (PLACES - 1)) << 8 | letters]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        parts[far] = mixed(parts[far] + (place[far] // PLACES).astype(np.uint64) * ROUND)
    total = np.add.reduceat(parts, start) if len(start) else np.empty(0, np.uint64)
    return mixed(total + size.astype(np.uint64))


@dataclass
class Words:
    """Words of consecutive texts. ``first`` has the first word of each text and the total."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``limit`` bytes each, or of one longer row."""
    _, offsets = bytes_of(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_edges(data: np.ndarray, offsets: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lower-case bytes are of words, and where words start and end; no word spans two texts."""
    n = len(data)
    inside = marked[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    return inside, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words_of(column: pa.Array, marked: np.ndarray) -> Words:
    """The words of each row of a column of a few megabytes."""
    raw, offsets = bytes_of(column)
    data, n = LOWER[raw], len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.empty(0, np.uint64))
    inside, starts, ends = word_edges(data, offsets, marked)
    hashes = word_hashes(data[inside], ends - starts)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def plain_words(column: pa.Array, marked: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of each row as one column, and the first word of each row and the total."""
    raw, offsets = bytes_of(column)
    data = LOWER[raw]
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    inside, starts, ends = word_edges(data, offsets, marked)
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges.tobytes()), pa.py_buffer(data[inside].tobytes()))
    return words, np.searchsorted(starts, offsets)
