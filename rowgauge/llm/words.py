"""Words and word hashes of whole texts, for code that runs inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

T = TypeVar("T")

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Entries after which a task forgets its word hashes; bounds memory, never changes a result.
CACHE_ENTRIES = 1_000_000

# Odd multipliers that give each place within a shingle its own weight.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
     0x85EBCA77C2B2AE63],
    dtype=np.uint64,
)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What this Python worker made under a name, kept from task to task.

    One thing is kept at a time, and none once a task has WordHashes, so that a worker which serves
    several operators one after another does not hold the memory of all.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


class WordHashes(dict):
    """Word to its 64-bit hash as eight bytes, remembered between texts."""

    def __init__(self) -> None:
        super().__init__()
        _KEPT.clear()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        made = self[word] = xxhash.xxh3_64_digest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.uint64)


_SHIFT, _FIRST, _SECOND = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits; one to one."""
    values = values ^ (values >> _SHIFT)
    values *= _FIRST
    values ^= values >> _SHIFT
    values *= _SECOND
    values ^= values >> _SHIFT
    return values


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """np.unique, by a sort alone: faster on the hashes of one text."""
    values = np.sort(values)
    return values if len(values) < 2 else values[np.concatenate([[True], values[1:] != values[:-1]])]


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words.

    Fewer words give one shingle, the whole sequence; no words give the empty set.
    """
    n = len(hashes)
    if n == 0:
        return hashes[:0]
    width = min(size, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for place in range(width):
        weight = _PLACES[place % 5] + np.uint64(2 * (place // 5))
        total += hashes[place : n - width + 1 + place] * weight
    if n < size:
        total += np.array([n], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return sorted_distinct(mix(total))


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or one row, to bound memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
