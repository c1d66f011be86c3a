"""Words of texts in Arrow batches: bounds, 64-bit hashes and n-grams in NumPy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes occur only as those characters. Null
texts count as empty ones. Equality of words, lines and n-grams is equality of their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = (1 << 19) - 16

#: Odd and 3 modulo 4, so that the powers of the base keep their order high.
BASE = 0x9E3779B97F4A7C17
GRAM = 0xC2B2AE3D27D4EB4F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection with good low bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: A 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return tuple(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n of each at least."""
    return _powers(max(19, (n - 1).bit_length()))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte span, whatever its place."""
    forward, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * forward[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


#: A key for each place of a block in its span.
PLACE_STEP = np.uint64(0xD6E8FEB86659FD93)


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte span, whatever its place: blocks of eight bytes, each mixed with a key of its number, are added up.

    Unlike a polynomial modulo 2^64, no order of equal words cancels out.
    """
    size = (ends - starts).astype(np.int64)
    blocks = (size + 7) >> 3
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(blocks, out=first[1:])
    if not first[-1]:
        return mix(size.astype(np.uint64))
    number = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    at = np.repeat(starts.astype(np.int64), blocks) + 8 * number
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    values = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    over = np.maximum(8 - (np.repeat(ends.astype(np.int64), blocks) - at), 0).astype(np.uint64) * np.uint64(8)
    values = (values << over) >> over  # bytes behind the end are not looked at
    total = np.zeros(first[-1] + 1, np.uint64)
    np.cumsum(mix(values ^ mix((number + 1).astype(np.uint64) * PLACE_STEP)), out=total[1:])
    return mix((total[first[1:]] - total[first[:-1]]) ^ mix(size.astype(np.uint64)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a string column, and the offsets of each text in them."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64) if len(offsets) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes and rows; a longer text is alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), low + rows, n)
        yield low, high
        low = high


@dataclass
class Words:
    """Words of a slice of texts; first[d] is the index of text d's first word, first[-1] the count of all."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return block_hashes(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Find the words; texts do not run into each other."""
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        starts[1:] &= ~inside[:-1]
        starts[borders] = inside[borders]
        ends[:-1] &= ~inside[1:]
        ends[borders - 1] = inside[borders - 1]
    begun = np.flatnonzero(starts)
    return Words(data, begun, np.flatnonzero(ends) + 1, np.searchsorted(begun, offsets))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of so many words, over the borders of texts too."""
    n = max(len(hashes) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for step in range(size if n else 0):
        total *= np.uint64(GRAM)
        total += hashes[step : step + n]
    return mix(total)


def inside(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the index of the first word of every run of so many words within one text."""
    n = max(int(first[-1]) - size + 1, 0)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    place = np.flatnonzero(np.arange(n) + size <= first[text + 1])
    return text[place], place


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of so many words within one text: its hash, the text, and the index of its first word."""
    text, place = inside(first, size)
    return runs(hashes, size)[place], text, place
