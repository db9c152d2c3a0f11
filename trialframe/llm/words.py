"""Words and word hashes of whole Arrow batches, with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 never uses those bytes inside a
character, so splitting the bytes splits the text. Texts are read straight from the Arrow buffers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Words:
    """The words of rows ``first`` to ``last`` (exclusive) of a batch; ``row`` counts from ``first``."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    #: Where each row's bytes begin, and at the end their number.
    offsets: np.ndarray
    #: Which rows a user of the words has marked.
    marked: np.ndarray | None = None

    @property
    def bounds(self) -> np.ndarray:
        """Where each row's words begin, and at the end their number."""
        return np.searchsorted(self.row, np.arange(self.last - self.first + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have


def text_words(column: pa.Array, most_bytes: int = 1 << 19) -> Iterator[Words]:
    """The words of a string column, a slice of rows of about ``most_bytes`` at a time; null is empty.

    A longer text is a slice of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    whole = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        last = min(last, n)
        data = whole[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        word = ~_SPACE[data]
        filled = at[:-1] < at[1:]
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        before[at[:-1][filled]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        after[at[1:][filled] - 1] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        yield Words(first, last, data, starts, ends, np.searchsorted(at, starts, "right") - 1, at)
        first = last


def byte_hashes(data: np.ndarray, lower: bool = False) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives a 64-bit hash of the bytes from each start to each end; A-Z lower-cased first if asked."""
    values = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(data))[: len(data)], out=sums[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        part = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
        return mix(part + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    return hashes


def word_hashes(words: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased first if asked."""
    return byte_hashes(words.data, lower)(words.starts, words.ends)


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values; len(hashes) - n + 1 of them."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + size])
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes (int64) of its ``n``-word shingles, words lower-cased A-Z.

    A row with fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    for words in text_words(column):
        hashes = word_hashes(words)
        runs = joined(hashes, n)
        bounds = words.bounds
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1].view(np.int64))
            elif b > a:
                yield joined(hashes[a:b], b - a).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
