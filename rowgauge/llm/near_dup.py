"""Near duplicates by circulant MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .words import LOWER, WordHashes, byte_texts, mix, pieces, shingle_set

#: Places of the circle on which the two permutations work: 2 to this power.
CIRCLE_BITS = 22
#: A pair of similarity 0.8 shares a band of 7 coordinates with probability 0.8^7 = 0.21, so 50
#: bands miss it with probability 8e-6; at 0.85, with 4e-9.
BANDS, BAND_ROWS = 50, 7
#: Rounds in which each bucket's members meet one of them, before the rest meet by rare shingles.
STAR_ROUNDS = 2


@lru_cache(maxsize=1)
def _circle(width: int) -> np.ndarray:
    """The second permutation, with its first places repeated at the end, as rows of `width` places.

    Row i holds the permutation's values at i, i+1, ..., so it is what element i adds to all
    coordinates: coordinate k uses the permutation shifted by k places.
    """
    order = np.random.default_rng(20240229).permutation(1 << CIRCLE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:width]]), width)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes.

    The first permutation places each element on the circle (an odd multiplier and a shift-xor are
    one to one there); the second gives coordinate k the smallest value at place + k.
    """
    circle = _circle(coordinates)
    mask = np.uint64((1 << CIRCLE_BITS) - 1)
    place = shingles & mask
    place = (place * np.uint64(0x2C1B3C6D)) & mask
    place ^= place >> np.uint64(CIRCLE_BITS // 2)
    place = ((place * np.uint64(0x297A2D39)) & mask).astype(np.int64)
    best = np.full(coordinates, 1 << CIRCLE_BITS, dtype=np.uint32)
    for start in range(0, len(place), 2048):  # bounded memory for very long texts
        np.minimum(best, circle[place[start : start + 2048]].min(axis=0), out=best)
    return best


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    cells = found.reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        total = mix(total ^ (cells[:, k] + np.uint64(k << 32)))
    return total


def _signed(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            n, digests, keys, lengths = [], [], [], []
            for text in byte_texts(batch.column("text")):
                found = shingle_set(hashes.of(text.translate(LOWER).split()), size)
                n.append(len(found))
                if len(found):
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(signature(found, bands * rows), bands, rows))
                    lengths.append(bands)
                else:
                    digests.append(None)
                    lengths.append(0)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            sets = [shingle_set(hashes.of(t.translate(LOWER).split()), size)
                    for t in byte_texts(batch.column("text"))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "shingles"],
            )

    return run


def _order(round_: int) -> Column:
    """Another random order of ids in every round."""
    return F.xxhash64(F.lit(round_), F.col("id"))


def _prefix_pairs(classes: DataFrame, similarity: int) -> DataFrame:
    """(id, n, other, other_n): pairs of different components that may be similar enough.

    `classes` has (id, component, shingles). Two sets of similarity t or more share one of the first
    n - ceil(t * n) + 1 shingles of each, whatever order all sets are put in; here the rarest come
    first, so a set with many shingles of its own meets nobody. No pair is lost.
    """
    each = classes.select(
        "id", "component", F.xxhash64("shingles").alias("set"), F.size("shingles").alias("n"),
        F.explode("shingles").alias("shingle"),
    )
    counts = each.groupBy("shingle").agg(F.count("*").alias("sets"))
    rank = F.row_number().over(Window.partitionBy("id", "set").orderBy("sets", "shingle"))
    first = (
        each.join(counts, "shingle")
        .withColumn("rank", rank)
        .where(F.col("rank") <= F.col("n") - F.expr(f"(n * {similarity} + 99) div 100") + 1)
        .where("sets > 1")
        .select("shingle", "id", "component", "n", (F.col("n") - F.col("rank") + 1).alias("rest"))
    )
    mixed = first.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    first = first.join(mixed.where("low != high").select("shingle"), "shingle").checkpoint()
    other = first.select("shingle", F.col("id").alias("other"), F.col("component").alias("other_component"), F.col("n").alias("other_n"), F.col("rest").alias("other_rest"))
    return first.join(
        other,
        (first["shingle"] == other["shingle"]) & (first["id"] < other["other"])
        & (first["component"] != other["other_component"])
        & F.expr(f"100 * least(n, other_n) >= {similarity} * greatest(n, other_n)")
        & F.expr(f"{100 + similarity} * least(rest, other_rest) >= {similarity} * (n + other_n)"),
    ).select("id", "n", "other", "other_n")


def near_duplicates(
    docs: DataFrame,
    similarity: int = 80,
    size: int = 5,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate groups of documents.

    Texts are lower-cased in A-Z and split at ASCII white space; two documents are linked if
    100 * intersection >= similarity * union of their sets of `size`-word shingles. A group is all
    that links reach; its smallest doc_id is its `component_id`, and that document is `kept`.

    1. One pass makes for each document its number of shingles, a digest of its set, and band keys.
       Documents with equal sets are one class, so copies cost nothing further.
    2. Buckets of a band key with two classes or more propose pairs. In each of a few rounds every
       class of a bucket meets one of it, the first in that round's order; buckets whose classes
       are then in one component are done. The classes of all other buckets meet across components
       if they share one of their rarest shingles, which sets that similar must. So no link is lost
       and a hot bucket never meets itself in all pairs.
    3. Pairs are confirmed on the full sets of shingles, made again from the text for the classes
       concerned. Sets are of 64-bit hashes: two of n shingles agree by chance once in 2^64.

    Null and empty texts and texts without words have no shingle and link with nothing; texts of
    fewer than `size` words are one shingle. Rows that share a doc_id are one document: a link of
    one holds for all, so repeated rows share their result and stay. A row whose doc_id is null
    takes no part, is kept, and has a null component. Other columns are not read; an empty table
    gives no rows. Runs jobs; intermediate tables go to the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(
        source.mapInArrow(
            _signed(bands, rows, size),
            "doc_id long, n_shingles long, digest binary, keys array<long>",
        ),
        "signed",
    )
    part = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = part.groupBy("digest").agg(F.min("doc_id").alias("id"))
    first = part.join(classes, "digest").where("doc_id = id")
    entries = first.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key")).distinct()
    full = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = scratch.keep(entries.join(full, "key").select("key", "id", "n"), "members")
    sets = scratch.keep(
        source.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .mapInArrow(_sets(size), "id long, shingles array<long>")
        .distinct(),
        "sets",
    )
    fits = F.expr(f"100 * least(n, other_n) >= {similarity} * greatest(n, other_n) AND id != other")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
        both = F.size(F.array_intersect("left", "right"))
        union = F.size("left") + F.size("right") - both
        return (
            pairs.join(left, "a").join(right, "b")
            .where(100 * both >= similarity * union)
            .select("a", "b")
        )

    # A doc_id on rows of several texts ties their classes together.
    several = part.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    links = (
        part.join(several.where("low != high"), "doc_id").join(classes, "digest")
        .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    )
    groups, left = None, members
    for round_ in range(STAR_ROUNDS + 1):
        if round_ < STAR_ROUNDS:
            hubs = left.groupBy("key").agg(
                F.min(F.struct(_order(round_).alias("o"), F.col("id"), F.col("n"))).alias("hub")
            ).select("key", F.col("hub.id").alias("other"), F.col("hub.n").alias("other_n"))
            pairs = left.join(hubs, "key").where(fits)
        else:
            pairs = _prefix_pairs(left.select("id", "component").distinct().join(sets, "id"), similarity).where(fits)
        ordered = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        links = scratch.keep(links.union(confirmed(ordered)), f"links{round_}")
        groups = components(links)
        if round_ == STAR_ROUNDS:
            break
        named = members.join(groups, "id", "left").select(
            "key", "id", "n", F.coalesce("component", "id").alias("component")
        )
        split = (
            named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
            .where("low != high AND m > 2").select("key")
        )
        left = scratch.keep(named.join(split, "key"), f"left{round_}")
        if left.isEmpty():
            break
    named = classes.join(groups, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    whole = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return (
        whole.join(named, "digest", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )
