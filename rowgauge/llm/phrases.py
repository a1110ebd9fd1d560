"""Phrases of words that stand together more often than apart, from a weighted de Bruijn graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import LOWER, byte_texts, mix, pieces

#: Bytes of text whose grams are counted together: of a batch, and of a part of all grams.
BATCH_BYTES, PART_BYTES = 4 << 20, 16 << 20
#: Shares into which a language's phrases are dealt before the best of all are taken.
SHARES = 64
#: Language of rows that have none.
NO_LANG = "und"

# Signs that end a piece, and a byte that no UTF-8 text has, which stands for them.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"\xff"
_CUT = bytes(0xFF if c in _ENDS else LOWER[c] for c in range(256))

_PACKED = "part int, grams binary"
_COUNTED = f"{_PACKED}, lang string, phrase string, words int, n long"


class _Codes(dict):
    """Numbers of words in order of appearance; 0 is no word."""

    def __init__(self) -> None:
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def summed(grams: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers below `size`, and the sums of their counts."""
    if not len(grams):
        return grams, counts
    key, bound = grams[:, 0], size
    for column in grams.T[1:]:
        if bound > (1 << 62) // size:
            names, key = np.unique(key, return_inverse=True)
            bound = len(names)
        key = key * size + column
        bound *= size
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return grams[order[first]], np.add.reduceat(counts[order], first)


def grams_of(texts: list[bytes], longest: int, codes: _Codes) -> np.ndarray:
    """The gram that begins at every word of the texts' pieces, as rows of numbers.

    It has `longest` words, or all that are left of its piece; the rest of its row is 0.
    """
    marked = (b" " + _MARK + b" ").join(t.translate(_CUT).replace(_MARK, b" " + _MARK + b" ") for t in texts)
    found = np.concatenate([codes.of(marked.split()), np.zeros(longest, np.int64)])
    at = np.flatnonzero(found)
    columns = [found[at]]
    for k in range(1, longest):
        columns.append(np.where(columns[-1] > 0, found[at + k], 0))
    return np.stack(columns, axis=1)


def _dealt(grams: np.ndarray, counts: np.ndarray, names: list[bytes], parts: int) -> Iterator[tuple[int, bytes]]:
    """The grams packed by part, a gram's part being a hash of its words; each pack has the words it needs."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    hashes[0] = 0
    total = np.zeros(len(grams), dtype=np.uint64)
    for column in grams.T:
        total = mix(total + hashes[column])
    part = (total % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    numbers, begins = np.unique(part[order], return_index=True)
    for number, begin, end in zip(numbers.tolist(), begins, [*begins[1:], len(order)]):
        some = order[begin:end]
        local, used = pd.factorize(grams[some].ravel())
        words = [names[k] for k in used.tolist()]
        local = local.astype(np.uint16 if len(words) < 1 << 16 else np.uint32)
        head = np.array([len(words), len(some), grams.shape[1]], np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.uint32, count=len(words))
        packed = [head, lengths, local, counts[some].astype(np.int64)]
        yield number, zstandard.compress(b"".join([*(x.tobytes() for x in packed), *words]), 1)


def _unpacked(blobs: list[bytes], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """The grams and counts of packs, in numbers of `codes`."""
    grams, counts = [], []
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n_words, n, width = np.frombuffer(raw, np.uint32, 3).tolist()
        at = 12 + 4 * n_words
        ends = np.cumsum(np.frombuffer(raw, np.uint32, n_words, 12), dtype=np.int64)
        local = np.frombuffer(raw, np.uint16 if n_words < 1 << 16 else np.uint32, n * width, at)
        at += local.nbytes
        counts.append(np.frombuffer(raw, np.int64, n, at))
        at += 8 * n
        ends = (ends + at).tolist()
        words = [raw[b:e] for b, e in zip([at, *ends], ends)]
        grams.append(codes.of(words)[local].reshape(n, width))
    return np.concatenate(grams), np.concatenate(counts)


def _counted(longest: int, parts: int):
    """Batches of (lang, text) as their grams, packed by part; a gram's first number is its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), byte_texts(batch.column("text"))):
                by_lang.setdefault(lang, []).append(text)
            codes, found = _Codes(), []
            for lang, texts in by_lang.items():
                own = grams_of(texts, longest, codes)
                found.append(np.insert(own, 0, codes[_MARK + lang.encode()], axis=1))
            grams = np.concatenate(found)
            grams, counts = summed(grams, np.ones(len(grams), np.int64), len(codes))
            rows = list(_dealt(grams, counts, list(codes), parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["part", "grams"],
            )

    return run


def _level(words: int, least: int, parts: int):
    """Sum the grams of one part; give those of `words` words seen `least` times, and hand all down.

    A gram of `words` words hands its count to the node that it starts from, its first words; one
    that its piece's end cut shorter is the correction of its own node and handed on as it is. At one
    word, the sum of all is given for each language.
    """

    def run(table: pa.Table) -> pa.Table:
        codes = _Codes()
        grams, n = _unpacked(table.column("grams").to_pylist(), codes)
        grams, n = summed(grams, n, len(codes))
        names, rows = list(codes), []
        for k in np.flatnonzero((grams[:, words] > 0) & (n >= least)).tolist():
            lang, *own = (names[c] for c in grams[k].tolist())
            rows.append((None, None, lang[1:].decode(), b" ".join(own).decode(), words, int(n[k])))
        nodes, n = summed(grams[:, :-1], n, len(codes))
        if words == 1:
            rows += [(None, None, names[c][1:].decode(), None, 0, count) for c, count in zip(nodes[:, 0].tolist(), n.tolist())]
        else:
            rows += [(part, blob, None, None, None, None) for part, blob in _dealt(nodes, n, names, parts)]
        types = [pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        fields = ["part", "grams", "lang", "phrase", "words", "n"]
        columns = zip(*rows) if rows else [()] * 6
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=fields)

    return run


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, words, n): phrases of 1 to `longest` words that occur `least` times or more, and
    for each language a row without a phrase, of 0 words, with the number of all words.

    Only the longest grams are counted in the texts: the edges of a de Bruijn graph whose nodes are
    grams of one word less, an edge's first and last words. Counts of shorter phrases follow from it:
    what flows out of a node, plus the pieces that end in it, is the node's count; nodes are the edges
    of the next level. Grams are packed by batch and part, so that a part's grams, some megabytes of
    text, are summed by one task; a gram's part is a hash of all of it, so a common word or node lies
    in all parts. Runs jobs; intermediate tables go to the shared folder.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")
    )
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size) // PART_BYTES
    packed = source.mapInArrow(_counted(longest, parts), _PACKED)
    counts = None
    for words in range(longest, 0, -1):
        level = scratch.keep(packed.groupBy("part").applyInArrow(_level(words, least, parts), _COUNTED), f"words{words}")
        packed = level.where("part IS NOT NULL").select("part", "grams")
        found = level.where("part IS NULL").select("lang", "phrase", "words", "n")
        counts = found if counts is None else counts.union(found)
    totals = counts.where("words = 0").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counts.where("words > 0").union(totals)


def _words(column: str, first: str, count: str) -> Column:
    """So many words of a phrase, from `first` on, counted from 1."""
    return F.expr(f"array_join(slice(split({column}, ' '), {first}, {count}), ' ')")


def _followed(state: DataFrame) -> DataFrame:
    """Follow `ahead` of every row (lang, gram, ahead, hops, low) to the row that is its own, if any.

    Doubles the steps in every round: (..., done) has the row at the end and the hops to it, or, on
    circles, done = false and in `low` the circle's smallest gram.
    """
    state = state.withColumn("done", F.col("ahead") == F.col("gram")).checkpoint()
    before = None
    while True:
        target = state.select(
            "lang", F.col("gram").alias("ahead"), F.col("ahead").alias("next"), F.col("hops").alias("more"),
            F.col("low").alias("next_low"), F.col("done").alias("next_done"),
        )
        moved = state.where("NOT done").join(target, ["lang", "ahead"]).select(
            "lang", "gram", F.col("next").alias("ahead"), (F.col("hops") + F.col("more")).alias("hops"),
            F.least("low", "next_low").alias("low"), F.col("next_done").alias("done"),
        )
        state = state.where("done").select(*moved.columns).union(moved).checkpoint()
        now = state.where("NOT done").agg(F.count("*"), F.sum(F.crc32("low"))).first()
        if now[0] == 0 or now == before:
            return state
        before = now


def unary_paths(edges: DataFrame) -> DataFrame:
    """(lang, steps): the edges (lang, phrase, n) of a de Bruijn graph, compacted.

    A node with one edge in and one edge out joins them. `steps` holds a path's edges in order as
    structs (hops, phrase, n), the first at 0; every edge is on one path. A circle of such nodes is
    cut before its smallest edge. Steps are found by doubling, in as many rounds as the logarithm of
    the longest path. Runs jobs.
    """
    ends = edges.select(
        "lang", F.col("phrase").alias("gram"), "n", _words("phrase", "1", "size(split(phrase, ' ')) - 1").alias("source"),
        _words("phrase", "2", "size(split(phrase, ' ')) - 1").alias("target"),
    )
    out = ends.groupBy("lang", F.col("source").alias("node")).agg(F.count("*").alias("n_out"), F.min("gram").alias("gram"))
    into = ends.groupBy("lang", F.col("target").alias("node")).agg(F.count("*").alias("n_in"), F.min("gram").alias("ahead"))
    joins = out.where("n_out = 1").join(into.where("n_in = 1"), ["lang", "node"]).select("lang", "gram", "ahead")
    ahead = F.coalesce("ahead", "gram")
    start = ends.join(joins, ["lang", "gram"], "left").select(
        "lang", "gram", ahead.alias("ahead"), F.col("ahead").isNotNull().cast("long").alias("hops"),
        F.least("gram", ahead).alias("low"),
    )
    # An edge that is its own successor is a circle of one: its first is itself.
    start = start.withColumn("hops", F.when(F.col("ahead") == F.col("gram"), F.lit(0)).otherwise(F.col("hops")))
    start = start.checkpoint()
    followed = _followed(start)
    circles = followed.where("NOT done").select("lang", "gram", "low")
    if not circles.isEmpty():
        first = F.col("gram") == F.col("of_low")
        cut = start.join(circles.withColumnRenamed("low", "of_low"), ["lang", "gram"]).select(
            "lang", "gram", F.when(first, F.col("gram")).otherwise(F.col("ahead")).alias("ahead"),
            F.when(first, F.lit(0)).otherwise(F.col("hops")).alias("hops"), "low",
        )
        followed = followed.where("done").union(_followed(cut))
    return (
        followed.join(ends.select("lang", "gram", "n"), ["lang", "gram"])
        .groupBy("lang", F.col("ahead").alias("start"))
        .agg(F.sort_array(F.collect_list(F.struct("hops", F.col("gram").alias("phrase"), "n"))).alias("steps"))
        .select("lang", "steps")
    )


def path_phrases(paths: DataFrame) -> DataFrame:
    """(lang, phrase, words, least, most): the words along each path, and its edges' range of counts."""
    phrase = F.expr(
        "concat_ws(' ', steps[0].phrase, array_join(transform(slice(steps, 2, size(steps)),"
        " s -> substring_index(s.phrase, ' ', -1)), ' '))"
    )
    return paths.select(
        "lang", F.rtrim(phrase).alias("phrase"), F.array_min("steps.n").alias("least"), F.array_max("steps.n").alias("most")
    ).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "least", "most")


def _node_reach(paths: DataFrame) -> DataFrame:
    """(lang, phrase, reach): the largest count of an edge at each node.

    Inner nodes of a path have no other edges; only those at its ends meet the ends of other paths.
    """
    head = "array_join(slice(split({0}, ' '), 1, size(split({0}, ' ')) - 1), ' ')"
    tail = "array_join(slice(split({0}, ' '), 2, size(split({0}, ' ')) - 1), ' ')"
    inner = paths.where("size(steps) > 1").select(
        "lang",
        F.explode(F.expr(
            "transform(sequence(1, size(steps) - 1), k -> struct("
            + head.format("steps[k].phrase") + " AS phrase, greatest(steps[k - 1].n, steps[k].n) AS reach))"
        )).alias("x"),
    ).select("lang", "x.phrase", "x.reach")
    last = "steps[size(steps) - 1]"
    outer = paths.select(
        "lang",
        F.explode(F.expr(
            f"array(struct({head.format('steps[0].phrase')} AS phrase, steps[0].n AS reach),"
            f" struct({tail.format(last + '.phrase')} AS phrase, {last}.n AS reach))"
        )).alias("x"),
    ).groupBy("lang", "x.phrase").agg(F.max("x.reach").alias("reach"))
    return inner.union(outer.select("lang", "phrase", "reach")).groupBy("lang", "phrase").agg(F.max("reach").alias("reach"))


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, most: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of 2 to `longest` words.

    Texts are lower-cased in A-Z and cut into pieces at `.,;:!?` and line breaks, these into words at
    blanks and tabs. A candidate occurs `least` times or more; `a` is its count, `n` that of all words.
    Cut after its first words it has `l` and `r`, the counts of both parts, and a score of
    floor(10^6 * a * a / (l * r)); the cut with the lowest counts, the first of equal ones. Candidates
    inside a longer one with at least `percent` of their count are dropped. Phrases are ranked by
    score, then count, both falling, then by their bytes.

    Counts come from a de Bruijn graph (see `phrase_counts`), whose frequent edges are compacted into
    unary paths: a node inside a path knows its longer phrases by its place there. Products are
    decimals of 38 digits, exact up to counts of 10^15.

    Rows without a language are of language `und`. Null and empty texts have no words. Repeated rows
    count as often as they stand there, whatever their doc_id. Other columns are not read. An empty
    table gives no rows. Runs jobs; intermediate tables go to the shared folder.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    counts = phrase_counts(docs, longest, least).checkpoint()
    found = counts.where("words > 0").select("lang", "phrase", "words", "n")
    candidates = found.where("words > 1")
    paths = unary_paths(candidates.where(F.col("words") == longest).select("lang", "phrase", "n"))
    reach = _node_reach(paths)
    # Of shorter phrases, levels below the graph's nodes, by what one word more makes of them.
    shorter = candidates.where((F.col("words") > 2) & (F.col("words") < longest)).select(
        "lang", F.explode(F.array(
            _words("phrase", "1", "words - 1"), _words("phrase", "2", "words - 1")
        )).alias("phrase"), "n",
    ).groupBy("lang", "phrase").agg(F.max("n").alias("reach"))
    inside = reach.union(shorter)
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(
        F.col("reach").isNull() | (100 * F.col("reach") < percent * F.col("n"))
    )
    cuts = kept.select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut", _words("phrase", "1", "cut").alias("left"),
        _words("phrase", "cut + 1", "words - cut").alias("right"),
    )
    left = found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    scored = (
        cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * (exact["a"] * exact["a"]))
        .withColumn("bottom", exact["l"] * exact["r"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "cut", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order)))
    ranked = first.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    whole = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    return ranked.where(F.col("rank") <= most).join(whole, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
