"""N-gram Jaccard joins by PartEnum signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .near_dup import _prefix_pairs as rare_shingle_pairs
from .scratch import Scratch, shuffles_dropped
from .words import LOWER, WordHashes, byte_texts, mix, pieces, shingle_set, sorted_distinct

#: Widest ratio of sizes within a band is the similarity's reciprocal to this power.
BAND_POWER = 2
#: Parts of a partition, all but one of which agree where a pair differs there in one element at most,
#: and elements that a choice of them has at least, unless too many partitions have such a choice.
PARTS, LEAST = 2, 1
#: For so much allowed difference there is one partition more, so that few empty parts can be left out.
SPARE = 64
#: Members of buckets that may all meet each other; of larger ones, each meets one of the bucket in so
#: many rounds, and what is open then meets by rare shingles.
SMALL, STAR_ROUNDS = 32, 2

_BAND = 0x9E3779B97F4A7C15


@lru_cache(maxsize=100_000)
def band_of(n: int, similarity: int) -> tuple[int, int, int]:
    """(number, largest size, next band's largest size) of the band of sizes that holds `n`.

    A set fits one of its own band or of a neighbouring one: the next band is as wide as any set's
    partners reach.
    """
    number, top = 0, 0
    while True:
        low = top + 1
        top = low
        for _ in range(BAND_POWER):
            top = max(top, 100 * top // similarity)
        if n <= top:
            break
        number += 1
    above = top + 1
    for _ in range(BAND_POWER):
        above = max(above, 100 * above // similarity)
    return number, top, above


@lru_cache(maxsize=1000)
def _names(band: int, parts: int) -> np.ndarray:
    """A hash for each part of a band, a row a partition; kept for sets up to some 10,000 elements."""
    names = np.arange(1, parts + 1, dtype=np.uint64).reshape(-1, PARTS) + (np.uint64(band + 1) << np.uint64(40))
    return mix(names)


def banded_signatures(elements: np.ndarray, similarity: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(band, 64-bit signatures, least) of a set of 64-bit hashes, for each band that it signs.

    Sets a and b of sizes up to r that fit differ in at most k = 2r * (100 - t) / (100 + t) elements.
    The domain of hashes falls into k/2 + 1 partitions, and some more: in one at least, a and b differ
    in one element or none, so of its PARTS parts all but one agree, and every choice of all but one
    part is a signature. A set takes part in its own band, where r is the band's largest size, and in
    the next, as the smaller set of a pair.

    Choices with fewer than LEAST elements of the set are left out: the spare partitions make up for
    those of a set that has few of them. A set that has more signs them too, so two such sets meet by
    them.

    `least` is how many signatures of the band the set shares at least with any set that fits it there:
    most sets are smaller than r, so they differ from those that fit them in fewer elements than k, of
    which each partition without a common choice holds two, and the spare partitions agree as well.
    """
    n = len(elements)
    if not n:
        return
    number, top, above = band_of(n, similarity)
    widest = 100 * n // similarity
    for band, largest in ((number, top), (number + 1, above)):
        if band > number and 100 * n < similarity * (top + 1):
            continue  # too small for any set of the next band
        k = 2 * largest * (100 - similarity) // (100 + similarity)
        if k == 0:
            continue  # only equal sets fit
        spare = 1 + k // SPARE
        parts = PARTS * (k // 2 + 1 + spare)
        spread = mix(elements + np.uint64((band + 1) * _BAND % (1 << 64)))
        # Sixteen bits are sorted by radix.
        part = (spread % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(spread[order]))])
        ends = np.cumsum(counts)
        value = (sums[ends] - sums[ends - counts]).reshape(-1, PARTS)
        size = counts.reshape(-1, PARTS)
        # All but one part of each partition.
        chosen = value.sum(axis=1, dtype=np.uint64, keepdims=True) - value
        empty = size.sum(axis=1, keepdims=True) - size < LEAST
        keys = mix(mix(chosen) ^ (_names if parts < 2048 else _names.__wrapped__)(band, parts))
        bare = int(empty.any(axis=1).sum())
        partner = widest if band > number else min(widest, top)
        differ = (n + partner) * (100 - similarity) // (100 + similarity)
        # A common choice that is empty is no signature of the set, or else none of its partner's.
        least = parts // PARTS - differ // 2 - min(bare, spare)
        yield band, keys[~empty] if bare <= spare else keys.ravel(), least


def signatures(elements: np.ndarray, similarity: int) -> np.ndarray:
    """Sorted distinct signatures of all bands (see `banded_signatures`)."""
    found = [keys for _, keys, _ in banded_signatures(elements, similarity)]
    return sorted_distinct(np.concatenate(found)) if found else elements[:0]


def marked_signatures(elements: np.ndarray, similarity: int) -> tuple[np.ndarray, list[int | None]]:
    """Sorted distinct signatures, the last bit that of their band's number, and `least` by that bit.

    A set signs two bands at most, one after the other.
    """
    found, least = [elements[:0]], [None, None]
    for band, keys, fewest in banded_signatures(elements, similarity):
        found.append(keys & ~np.uint64(1) | np.uint64(band & 1))
        least[band & 1] = fewest
    return sorted_distinct(np.concatenate(found)), least


def parities(elements: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls on each bit of a power of two, n/2 bits or more, 64 at least.

    Bits that differ between two sets are not more than the elements in which the sets differ.
    """
    words = 1
    while 128 * words < len(elements):
        words *= 2
    spread = mix(elements ^ np.uint64(_BAND))
    place = (spread >> np.uint64(6)) % np.uint64(words) * np.uint64(64) + spread % np.uint64(64)
    bits = np.bincount(place.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _shingled(size: int, similarity: int, full: bool):
    """Batches of (doc_id, text) as (doc_id, n_shingles, digest, keys, least, odd), or as (id, shingles) if `full`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            sets = [shingle_set(hashes.of(t.translate(LOWER).split()), size) for t in byte_texts(batch.column("text"))]
            if full:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(sets)], names=["id", "shingles"])
                continue
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signed = [marked_signatures(s, similarity) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 _lists([keys for keys, _ in signed]), pa.array([least for _, least in signed], pa.list_(pa.int64())),
                 _lists([parities(s) for s in sets])],
                names=["doc_id", "n_shingles", "digest", "keys", "least", "odd"],
            )

    return run


def _several(entries: DataFrame) -> DataFrame:
    """The keys that stand in entries (key, id) with more than one id.

    Asks for both columns, so that it shares the exchange of a join with the entries.
    """
    ends = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return ends.where("low != high").select("key")


def _enough(entries: DataFrame, needs: DataFrame) -> DataFrame:
    """Those of distinct entries (key, id, ...) whose id has as many keys of their band here as `needs` has for it.

    `needs` has (id, least): a set shares so many signatures of a band with any set that fits it there.
    So if the entries have all keys in which pairs of a kind agree, they still do.
    """
    bit = F.col("key").bitwiseAND(F.lit(1)).cast("int")
    counted = entries.join(needs, "id").select(
        *entries.columns, F.get("least", bit).alias("least"), F.count("*").over(Window.partitionBy("id", bit)).alias("keys")
    )
    return counted.where("keys >= least").select(*entries.columns)


def _split(named: DataFrame) -> DataFrame:
    """(key, m): the keys of entries (key, id, component) in more components than one, and their number of entries."""
    ends = named.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")
    )
    return ends.where("low != high").select("key", "m")


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of (id, other) whose sizes and parities let them fit: all that do, and few others.

    The longer parities are folded to the shorter, a bit being odd if an odd number of its bits are.
    """
    left = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    right = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    ordered = pairs.where("id != other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    folded = "aggregate(sequence(k, size({0}) - 1, least(size(odd_a), size(odd_b))), 0L, (x, j) -> x ^ {0}[j])"
    differ = F.expr(
        "aggregate(sequence(0, least(size(odd_a), size(odd_b)) - 1), 0, (sum, k) -> sum + bit_count("
        f"{folded.format('odd_a')} ^ {folded.format('odd_b')}))"
    )
    return (
        ordered.distinct().join(left, "a").join(right, "b")
        .where(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
        .where((100 + similarity) * differ <= (100 - similarity) * (F.col("n_a") + F.col("n_b")))
        .select("a", "b").distinct()
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The links among pairs (a, b), by their whole sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * common >= similarity * (F.size("left") + F.size("right") - common))
        .select("a", "b")
    )


def linked_sets(docs: DataFrame, similarity: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by the similarity of their shingles.

    Texts are lower-cased in A-Z and split at ASCII white space; two documents are linked if
    100 * intersection >= similarity * union of their sets of `size`-word shingles. `component_id` is
    the smallest doc_id that links reach, the document's own included.

    1. One pass makes for each document its number of shingles, a digest of its set and its PartEnum
       signatures (see `signatures`). Documents with equal sets are one class. Two classes that fit
       have a signature in common, always.
    2. Signatures of two classes or more are buckets. First every class of a bucket meets the smallest
       of it; buckets of one component are done. Of the others, the classes of different components
       meet each other where there are SMALL or fewer; in larger ones, each meets a random one.
       Classes that fit share more signatures than one, the more the longer they are; one that has
       fewer in the buckets still open fits none there and leaves them (see `_enough`).
    3. Classes of large buckets still in several components meet by their rarest shingles, which sets
       that similar must share, so a hot bucket never meets itself in all pairs and no link is lost.
    4. Pairs pass by their sizes and by parities (see `parities`), which no link fails, and are then
       confirmed on the full sets, made again from the texts of the classes concerned.

    Sets are of 64-bit hashes: two of n shingles agree by chance once in 2^64.

    Null and empty texts and texts without words have no shingle and link with nothing; texts of
    fewer than `size` words are one shingle. Rows that share a doc_id are one document: a link of one
    holds for all. A row whose doc_id is null takes no part and has a null component. Other columns
    are not read; an empty table gives no rows. Runs jobs; intermediate tables go to the shared folder.
    """
    if not 1 <= similarity <= 100:
        raise ValueError("similarity is a percentage from 1 to 100")
    with shuffles_dropped(docs.sparkSession):
        narrow, classes, groups = _joined(docs, similarity, size)
    named = classes.join(groups, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    whole = narrow.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return whole.join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def _joined(docs: DataFrame, similarity: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept (doc_id, n_shingles, digest, least, odd) of all rows, (digest, id) of the classes and (id, component) of the linked."""
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(
        source.mapInArrow(
            _shingled(size, similarity, False),
            "doc_id long, n_shingles long, digest binary, keys array<long>, least array<long>, odd array<long>",
        ),
        "signed",
    )
    # Signatures are most of it, and needed once; the rest is read again and again.
    narrow = scratch.keep(signed.drop("keys"), "narrow")
    part, keyed = (t.where("n_shingles > 0 AND doc_id IS NOT NULL") for t in (narrow, signed))
    classes = part.groupBy("digest").agg(F.min("doc_id").alias("id"))
    # Dealt by signature once, for counting and joining: of a document's many signatures, one key has few.
    entries = keyed.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")).repartition("key")
    met = scratch.keep(entries.join(_several(entries), "key").select("key", "id"), "met")
    scratch.drop("signed")
    # Copies leave only now: before, the signatures would be dealt for both sides apart.
    own = scratch.keep(
        met.join(classes.select("id").distinct(), "id", "left_semi").select("key", "id").distinct(), "own"
    )
    # Of texts under one doc_id, the least of all.
    needs = scratch.keep(
        part.groupBy(F.col("doc_id").alias("id")).agg(F.array(*[F.min(F.col("least")[bit]) for bit in (0, 1)]).alias("least")),
        "needs",
    )
    shared = scratch.keep(_enough(own.join(_several(own), "key").select("key", "id"), needs), "shared")
    members = scratch.keep(_enough(shared.join(_several(shared), "key").select("key", "id"), needs), "members")
    scratch.drop("met", "own", "shared")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    again = source.join(ids, "doc_id", "left_semi").withColumn("text_hash", F.xxhash64("text"))
    sets = scratch.keep(
        again.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text")
        .mapInArrow(_shingled(size, similarity, True), "id long, shingles array<long>"),
        "sets",
    )
    sketches = scratch.keep(
        part.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "odd").distinct(),
        "sketches",
    )
    # A doc_id on rows of several texts ties their classes together.
    several = part.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    links = (
        part.join(several.where("low != high"), "doc_id").join(classes, "digest")
        .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    )
    left = members
    for round_ in range(STAR_ROUNDS + 1):
        if round_ < STAR_ROUNDS:
            rank = F.col("id") if round_ == 0 else F.xxhash64(F.lit(round_), F.col("id"))
            hubs = left.groupBy("key").agg(F.min_by("id", rank).alias("other"))
            pairs = left.join(hubs, "key").select("id", "other")
        else:
            open_ = left.select("id", "component").distinct()
            pairs = rare_shingle_pairs(open_.join(sets, "id"), similarity).select("id", "other")
        if round_ == 1:
            small = named.join(split.where(F.col("m") <= SMALL).select("key"), "key")
            other = small.select("key", F.col("id").alias("other"), F.col("component").alias("other_component"))
            each = small.join(other, "key").where("id < other AND component != other_component")
            pairs = pairs.union(each.select("id", "other"))
        likely = _likely(pairs, sketches, similarity)
        links = scratch.keep(links.union(_confirmed(likely, sets, similarity)), f"links{round_}")
        groups = components(links)
        if round_ == STAR_ROUNDS:
            break
        named = scratch.keep(
            left.select("key", "id").join(groups, "id", "left")
            .select("key", "id", F.coalesce("component", "id").alias("component")),
            f"named{round_}",
        )
        # All of two have met.
        open_ = named.join(_split(named).where("m > 2").select("key"), "key")
        named = scratch.keep(_enough(open_, needs), f"open{round_}")
        split = _split(named)
        if split.isEmpty():
            break
        # Later, a bucket may be small only for those that have left it.
        left = named.join(split.where(F.col("m") > (SMALL if round_ == 0 else 0)).select("key"), "key")
    return narrow, classes, groups
