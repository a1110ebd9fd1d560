"""Benchmark passages in documents, found by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, free_names, send_package
from .words import WordHashes, byte_texts, mix, pieces

#: Fixed seeds: of so many words in a row, only those at a 1 are hashed, so that a substitution at
#: a 0 does no harm. Six shapes of seven words in eleven; with CLOSE, one of them fits every run of
#: MIN_WORDS words or more of which PERCENT or more agree, wherever the substitutions are.
MASKS = ("11110001011", "10101100111", "11100111001", "10111010011", "11011010101", "10011011011")
CLOSE = "1111111"
#: Overlaps of fewer words are not reported, unless the whole item is that short.
MIN_WORDS = 13
#: Overlaps of which fewer words agree are not reported.
PERCENT = 80
#: Items of fewer words, and overlaps of fewer equal words, are left out: they would occur anywhere.
MIN_ITEM = 5
#: Words of the benchmark that one pass over the documents looks for.
BLOCK_WORDS = 1 << 18
#: Leaking rows, of 16 bytes each, are broadcast where they are not more than these.
BROADCAST_ROWS = 1 << 20

_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_PLAIN = bytes.maketrans(
    _SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123))
)
_WEIGHTS = mix(np.arange(1, 33, dtype=np.uint64))
_TABLE_BITS = 22


def plain_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return text.translate(_PLAIN).split()


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash under a mask at every place where the whole mask fits."""
    room = len(hashes) - len(mask) + 1
    if room <= 0:
        return hashes[:0]
    total = np.full(room, len(mask), dtype=np.uint64)
    for place, kept in enumerate(mask):
        if kept == "1":
            total += hashes[place : place + room] * _WEIGHTS[place]
    total *= np.uint64(0xFF51AFD7ED558CCD)
    return total ^ (total >> np.uint64(32))


def masks_for(size: int, percent: int, min_words: int) -> tuple[str, ...]:
    """Masks of which one fits every overlap that an item of `size` words can have.

    Where MASKS don't answer for it, that is the longest stretch of equal words which substitutions
    leave at least: k of them cut n words into k + 1 stretches.
    """
    if size >= min_words >= MIN_WORDS and percent >= PERCENT:
        return (*MASKS, CLOSE)
    least = min(size, min_words)
    # A hundred lengths: beyond, the shares of substitutions come again and stretches only grow.
    shortest = size
    for n in range(least, min(size, least + 99) + 1):
        k = max(0, min(n * (100 - percent) // 100, n - MIN_ITEM))
        shortest = min(shortest, -(-(n - k) // (k + 1)))
    return ("1" * shortest,)


class Items:
    """A block of benchmark items: their words and, for each mask, the sorted seed hashes."""

    def __init__(self, items: list[tuple[int, list[bytes]]], percent: int, min_words: int) -> None:
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashes.of(w) for _, w in items]
        owned: dict[str, list[int]] = {}
        for k, words in enumerate(self.words):
            for mask in masks_for(len(words), percent, min_words):
                owned.setdefault(mask, []).append(k)
        self.seeds = []
        for mask, own in owned.items():
            keys = [seed_hashes(self.words[k], mask) for k in own]
            owners = [np.full(len(found), k, dtype=np.int64) for k, found in zip(own, keys)]
            places = [np.arange(len(found), dtype=np.int64) for found in keys]
            key, owner, place = map(np.concatenate, (keys, owners, places))
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _TABLE_BITS, dtype=bool)
            seen[key >> np.uint64(64 - _TABLE_BITS)] = True
            self.seeds.append((mask, key[order], owner[order], place[order], seen))

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(places in hashes, items, places in them, width of the mask) of equal seeds."""
        for mask, key, owner, place, seen in self.seeds:
            found = seed_hashes(hashes, mask)
            at = np.flatnonzero(seen[found >> np.uint64(64 - _TABLE_BITS)])
            low = np.searchsorted(key, found[at], side="left")
            n = np.searchsorted(key, found[at], side="right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            if len(at):
                each = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(at, n), owner[each], place[each], len(mask)


def best_run(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """Start and stop of the longest run of which `percent` or more agree, the first of equals."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    # A run ends at `stop` as it should if the gain before it is not higher: begin at the first such.
    start = np.searchsorted(-np.minimum.accumulate(gain), -gain, side="left")
    stop = int(np.argmax(np.arange(len(gain)) - start))
    return int(start[stop]), stop


def _overlaps(items: Items, words: np.ndarray, hits: np.ndarray, percent: int, min_words: int):
    """Verified overlaps of one document: best (item, place, item place, words, equal) per item."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for item, diagonal in np.unique(hits, axis=0):
        own = items.words[item]
        low, high = max(0, -diagonal), min(len(own), len(words) - diagonal)
        equal = words[low + diagonal : high + diagonal] == own[low:high]
        start, stop = best_run(equal, percent)
        n = int(equal[start:stop].sum())
        if stop - start < min(min_words, len(own)) or n < MIN_ITEM:
            continue
        if int(item) not in best or n > best[int(item)][3]:
            best[int(item)] = (int(low + start + diagonal), int(low + start), int(stop - start), n)
    return best


def _search(blocks: list[tuple[int, list[bytes]]], percent: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, memory = Items(blocks, percent, min_words), WordHashes()
        for batch in pieces(batches, "text"):
            docs = [plain_words(t) for t in byte_texts(batch.column("text"))]
            ends = np.cumsum([len(w) for w in docs])
            words = memory.of([w for own in docs for w in own])
            starts = ends - [len(w) for w in docs]
            found = []
            for at, owner, place, width in items.hits(words):
                doc = np.searchsorted(ends, at, side="right")
                inside = at + width <= ends[doc]
                found.append(np.stack([doc, owner, at - starts[doc] - place], axis=1)[inside])
            hits = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
            rows = []
            ids, texts = batch.column("doc_id"), batch.column("text_hash")
            for doc in np.unique(hits[:, 0]):
                own = hits[hits[:, 0] == doc, 1:]
                for item, run_ in _overlaps(items, words[starts[doc] : ends[doc]], own, percent, min_words).items():
                    rows.append((ids[int(doc)].as_py(), texts[int(doc)].as_py(), items.ids[item], *run_))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "text_hash", "item_id", "doc_word", "item_word", "n_words", "n_equal"]
                )

    return run


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): benchmark passages in documents.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Seeds of the
    documents and of the benchmark that agree under one of the fixed masks are joined; on each hit's
    diagonal, the longest run of which `percent` or more agree is reported if it has `min_words` words
    or more (or is the whole of a shorter item) and MIN_ITEM or more agree. Masks are chosen so that
    every such run has a seed. One row per document and item, of these runs that with most equal
    words (the earliest diagonal of equals), places counted in words from 0.

    Documents are read as they lie, without a shuffle. The benchmark is looked for in blocks of
    `block_words` words, each a pass over the documents, so that what a task holds is bounded
    whatever the benchmark's size; the driver reads it one block at a time.

    Null and empty texts, on either side, give no row; items of fewer than MIN_ITEM words are left
    out. Null ids are carried along. Repeated rows of documents give repeated rows, repeated items a
    row each. Other columns are not read. Empty tables give no rows.
    """
    return _found(docs, benchmark, percent, min_words, block_words).drop("text_hash")


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, whose text holds no passage of the benchmark.

    Rows go by doc_id and a hash of the text: a row that leaks takes no other text along, whatever
    its doc_id, null or shared. Ids and hashes of the rows that go are written and counted; BROADCAST_ROWS
    or fewer come to the texts, so that none is shuffled, more are joined by a shuffle of both sides.
    """
    doc_id, text_hash = free_names(docs, "leak_doc_id", "leak_text_hash")
    leaks = (
        _found(docs, benchmark, PERCENT, MIN_WORDS, BLOCK_WORDS)
        .select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash)).distinct()
    )
    leaks = Scratch(docs.sparkSession).keep(leaks, "leaks")
    if leaks.count() <= BROADCAST_ROWS:
        leaks = F.broadcast(leaks)
    same = docs["doc_id"].cast("long").eqNullSafe(leaks[doc_id]) & (_text_hash(docs["text"]) == leaks[text_hash])
    return docs.join(leaks, same, "left_anti")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _found(docs: DataFrame, benchmark: DataFrame, percent: int, min_words: int, block_words: int) -> DataFrame:
    """What `benchmark_overlaps` returns, with the hash of the document's text."""
    spark = docs.sparkSession
    send_package(spark)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        _text_hash(F.col("text")).alias("text_hash"),
    )
    blocks: list[list[tuple[int, list[bytes]]]] = []
    size = block_words
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        words = plain_words((row[1] or "").encode())
        if len(words) < MIN_ITEM:
            continue
        if size >= block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], words))
        size += len(words)
    schema = "doc_id long, text_hash long, item_id long, doc_word long, item_word long, n_words long, n_equal long"
    if not blocks:
        return spark.createDataFrame([], schema)
    found = [source.mapInArrow(_search(b, percent, min_words), schema) for b in blocks]
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result
