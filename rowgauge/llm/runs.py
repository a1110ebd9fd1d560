"""Periodic runs of words, from the Lyndon arrays that a suffix sorter's first phase gives under both orders."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import send_package
from .words import WordHashes, byte_texts, mix, pieces

#: A run has so many words at least, and twice its period.
MIN_RUN = 12
#: The places of words within a gram weigh differently in its hash.
_WEIGHT = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long, collapsed string"
)

Words = list[bytes]


def lyndon_array(symbols: list[int]) -> list[int]:
    """For every place the length of the longest Lyndon word that starts there.

    Phase one of grouping suffixes: groups begin as suffixes of equal first symbol and are taken
    from the greatest down. A suffix i of the group at hand, whose context u is a Lyndon word,
    hands u to the nearest suffix before it of a lower group; one that is handed u k times has its
    context lengthened by u^k and moves to the upper end of its group, the more u the higher, as a
    group of its own. When all groups have been taken, a suffix's context is its longest Lyndon
    prefix. Places and groups are intervals of one array, so a group's number is where it begins.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place = [0] * n
    group = [0] * n
    last = [0] * n
    context = [1] * n
    begin = 0
    for k, i in enumerate(order):
        if symbols[i] != symbols[order[begin]]:
            begin = k
        place[i], group[i], last[begin] = k, begin, k
    before = [-1] * n
    top = n - 1
    while top >= 0:
        now = group[order[top]]
        size = context[now]
        handed: dict[int, int] = {}
        for i in sorted(order[now : top + 1]) if top > now else (order[now],):
            j = i - 1
            while j >= 0 and group[j] >= now:
                j = before[j]
            before[i] = j
            if j >= 0:
                handed[j] = handed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in handed.items():
            moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            some = moved[times, old]
            end = last[old]
            low = end
            for j in some:
                other, at = order[low], place[j]
                order[at], place[other] = other, at
                order[low], place[j] = j, low
                low -= 1
            low += 1
            for j in some:
                group[j] = low
            last[old], last[low], context[low] = low - 1, end, context[old] + times * size
        top = now - 1
    return [context[g] for g in group]


class Matches:
    """Longest common extensions of places of one sequence, by names of its blocks of 1, 2, 4, ... symbols.

    Two blocks of a length have one name if they are equal, symbol by symbol; naming stops at the
    length at which all blocks differ.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.n, self.names = len(names), [names]
        width = 1
        while 2 * width <= self.n and len(np.unique(names)) < len(names):
            names = np.unique(names[:-width] * self.n + names[width:], return_inverse=True)[1].astype(np.int64)
            self.names.append(names)
            width *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and b on are equal; b is behind a."""
        a, b = a.copy(), b.copy()
        start = b.copy()
        for level in reversed(range(len(self.names))):
            names = self.names[level]
            while True:
                inside = np.flatnonzero(b < len(names))
                same = inside[names[a[inside]] == names[b[inside]]]
                a[same] += 1 << level
                b[same] += 1 << level
                if level < len(self.names) - 1 or not len(same):
                    break
        return b - start


def runs_of(parts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of symbols from 0 up, by start, then period.

    The sequences stand in one with a sign of its own before each, below all symbols, which no match
    can pass. Every run has a Lyndon root under one of the two orders of symbols that is the longest
    Lyndon word at its place; the longest common extensions of a root and its repetition to both
    sides make it the run.
    """
    if not parts:
        return []
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + 1) - lengths
    high = 1 + max(int(p.max()) if len(p) else 0 for p in parts)
    whole = np.full(int(starts[-1] + lengths[-1]), -1, dtype=np.int64)
    for at, part in zip(starts, parts):
        whole[at : at + len(part)] = part
    signs = starts - 1
    signed = whole.copy()
    signed[signs] = -1 - np.arange(len(parts))
    ahead, behind = Matches(signed), Matches(signed[::-1].copy())
    inside = np.ones(len(whole), dtype=bool)
    inside[signs] = False
    at = np.flatnonzero(inside)
    found = []
    for order in (whole, high - 1 - whole):
        ordered = order.copy()
        ordered[signs] = -1 - np.arange(len(parts))
        period = np.array(lyndon_array(ordered.tolist()), dtype=np.int64)[at]
        right = np.zeros(len(at), dtype=np.int64)
        fits = np.flatnonzero(at + period < len(whole))
        right[fits] = ahead.forward(at[fits], (at + period)[fits])
        # Backwards from the words before the root and before its repetition.
        n = len(whole)
        left = np.zeros(len(at), dtype=np.int64)
        back = np.flatnonzero(at > 0)
        left[back] = behind.forward(n - 1 - (at + period - 1)[back], n - 1 - (at - 1)[back])
        length = left + period + right
        long = length >= 2 * period
        found.append(np.stack([(at - left)[long], length[long], period[long]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    each: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    for k, (start, length, period) in zip(owner.tolist(), runs.tolist()):
        each[k].append((start - int(starts[k]), length, period))
    return each


def repeated_stretches(hashes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches covered by grams of `size` words that occur twice or more.

    A run of 2 * size words or more has each of its grams twice, a period apart, so it lies within
    one stretch, and so would any run that goes on beyond it.
    """
    n = len(hashes) - size + 1
    if n < 2:
        return []
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        grams = grams * _WEIGHT + hashes[k : n + k]
    grams = mix(grams)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    steps = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begins = np.flatnonzero(twice)
    steps[begins] += 1
    steps[begins + size] -= 1
    covered = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(int(b), int(e)) for b, e in edges.reshape(-1, 2)]


def word_runs(texts: list[Words], hashes: WordHashes, min_run: int = MIN_RUN) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of `min_run` words or more, and two periods, of each list of words."""
    places, parts = [], []
    codes: dict[bytes, int] = {}
    for k, words in enumerate(texts):
        if len(words) < min_run:
            continue
        for begin, end in repeated_stretches(hashes.of(words), max(1, min_run // 2)):
            places.append((k, begin))
            parts.append(np.array([codes.setdefault(w, len(codes)) for w in words[begin:end]], dtype=np.int64))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, begin), runs in zip(places, runs_of(parts)):
        found[k] += [(begin + start, length, period) for start, length, period in runs if length >= min_run]
    return found


def kept_words(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    stays = np.cumsum(steps[:-1]) == 0
    return [w for w, stay in zip(words, stays.tolist()) if stay]


def _detected(change: Callable[[int | None, Words], Words] | None, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            texts = [t.split() for t in byte_texts(batch.column("text"))]
            if change is not None:
                texts = [change(i, words) for i, words in zip(ids, texts)]
            rows = []
            for doc_id, words, runs in zip(ids, texts, word_runs(texts, hashes, min_run)):
                kept = kept_words(words, runs)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                left = b" ".join(kept)
                rows.append((
                    doc_id, len(runs), *longest, 1000 * longest[1] // longest[2] if runs else None,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
                    len(words), len(kept), left.decode() if runs else None,
                ))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            types = [pa.string() if "sha256" in c or c == "collapsed" else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types],
                names=names,
            )

    return run


def periodic_runs(
    docs: DataFrame, change: Callable[[int | None, Words], Words] | None = None, min_run: int = MIN_RUN
) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words,
    n_kept, collapsed): the periodic runs of words of every document.

    Words are what stands between ASCII white space, compared byte by byte. A run is a stretch of
    `min_run` words or more, and of two periods or more, whose words one smallest period apart are
    equal, and which neither neighbour goes on. `start` (from 0), `length`, `period` and
    `exponent_milli` are those of the longest run, then the first, then of the smallest period, and
    null where there is none. `runs_sha256` is of the lines `start,length,period` of all runs, by
    start and period; `collapsed_sha256` of the words that no run contains after its first period,
    joined by one space; `collapsed` is that text itself, null where no run was found.

    Only stretches of grams that occur twice in the text are sorted; a run of that length lies within
    one. `change` gives other words for a document's words before all this.

    One pass; nothing is shuffled, and a text is held with some megabytes of others at most. Null,
    empty and blank texts have no words and no runs. Every row has its result, rows with equal or null
    doc_id too. Other columns are not read. An empty table gives no rows.
    """
    send_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_detected(change, min_run), SCHEMA)


def with_planted_runs(doc_id: int | None, words: Words) -> Words:
    """The words with a periodic tail where the crc32 of the decimal doc_id ends in 0; a null id has none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    root = words[first : first + period]
    return words[:first] + (root * ((n - first) // period + 1))[: n - first]
