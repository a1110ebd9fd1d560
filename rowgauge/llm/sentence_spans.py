"""Repeated passages across documents, found as runs of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, free_names, send_package
from .words import byte_texts, pieces

#: A run of two sentences or more has so many words at least, one of a single sentence twice as many.
RUN_WORDS = 15

# A sentence ends after . ! ? and what closes quotes, before white space, or at a line's end.
_END = re.compile(rb"[.!?]+[\"')\]]*(?=\s)|\n+")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """(start, stop) in bytes of the sentences of a text, without white space around them."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    found = []
    for start, stop in zip(cuts, cuts[1:]):
        part = text[start:stop]
        start += len(part) - len(part.lstrip())
        stop -= len(part) - len(part.rstrip())
        if start < stop:
            found.append((start, stop))
    return found


def runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last), sorted, of the shortest runs from and up to every sentence, and of long sentences.

    Any sentence of a longer run lies in one of these that the run holds: so whatever of a text is
    repeated as a run is repeated as some of these, and nothing else is.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(len(words))
    # The last sentence of the run is the first whose total reaches what is wanted.
    last = np.maximum(np.searchsorted(total, total[:-1] + least, side="left") - 1, at + 1)
    # The first sentence of the run is the last from which the total is what is wanted.
    first = np.minimum(np.searchsorted(total, total[1:] - least, side="right") - 1, at - 1)
    found = {(k, k) for k in at[np.asarray(words, dtype=np.int64) >= 2 * least].tolist()}
    found.update(zip(at[last < len(words)].tolist(), last[last < len(words)].tolist()))
    found.update(zip(first[first >= 0].tolist(), at[first >= 0].tolist()))
    return sorted(found)


def _normal(sentence: bytes) -> bytes:
    return b" ".join(sentence.lower().split())


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, texts, hashes, firsts, lasts = [], [], [], [], []
            columns = (batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist())
            for doc_id, text_hash, text in zip(*columns, byte_texts(batch.column("text"))):
                own = [_normal(text[a:b]) for a, b in sentences(text)]
                for first, last in runs([s.count(b" ") + 1 for s in own], least):
                    ids.append(doc_id)
                    texts.append(text_hash)
                    hashes.append(xxhash.xxh3_64_intdigest(b"\n".join(own[first : last + 1])))
                    firsts.append(first)
                    lasts.append(last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()),
                 pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                 pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                names=["doc_id", "text_hash", "run", "first", "last"],
            )

    return run


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def repeated_runs(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """(doc_id, text_hash, first, last, kept_doc_id): runs of sentences that are no first occurrence.

    A run is known by the hash of its sentences, ASCII lower-cased with white space made one blank;
    its first occurrence is that of smallest doc_id, then hash of the text, then place. Runs are found in one pass and
    kept; first occurrences are combined before the shuffle, so that a run in a third of all
    documents costs one row per task, and only runs that do occur twice are joined back.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
            _text_hash().alias("text_hash"),
        )
        .where("doc_id IS NOT NULL")
        .mapInArrow(_runs(least), "doc_id long, text_hash long, run long, first int, last int"),
        "runs",
    )
    place = F.struct("doc_id", "text_hash", "first")
    firsts = (
        found.groupBy("run")
        .agg(F.min(place).alias("at"), F.max(place).alias("end"))
        .where("at != end")
        .select("run", "at")
    )
    return (
        found.join(firsts, "run")
        .where(place != F.col("at"))
        .select("doc_id", "text_hash", "first", "last", F.col("at.doc_id").alias("kept_doc_id"))
    )


def _without(text: str | None, spans: np.ndarray) -> tuple[str, int, int]:
    """The text without the sentences of the spans (first * 2^32 + last), and how many it has and loses."""
    raw = (text or "").encode("utf-8", "replace")
    places = sentences(raw)
    gone = np.zeros(len(places) + 1, dtype=np.int64)
    for span in spans:
        gone[int(span) >> 32] += 1
        gone[(int(span) & 0xFFFFFFFF) + 1] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    left, at = [], 0
    for k, (start, stop) in enumerate(places):
        if covered[k]:
            left.append(raw[at:start])
            at = stop
    left.append(raw[at:])
    return b"".join(left).decode("utf-8", "replace"), len(places), int(covered.sum())


def _cut(text: Column, spans: Column) -> Column:
    @F.pandas_udf("text string, n_sentences int, n_removed int")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [_without(t, s) for t, s in zip(texts, found)]
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])

    return cut(text, spans)


def remove_repeats(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """The documents that lose sentences, with (n_sentences, n_removed, first_doc_ids) added.

    Of every run of several consecutive sentences with `least` words or more that occurs more than
    once, in one or in several documents, the first occurrence stays and all sentences that another
    occurrence covers are removed from `text`. A single sentence of 2 * `least` words or more is a
    run too. Hashed are the shortest runs from and up to every sentence, which cover every sentence
    of the longer ones. `first_doc_ids` lists, sorted, the documents that hold the first occurrences
    of the hashed runs. Documents without repeated runs are not in the result.

    Null and empty texts have no sentence. Text without ends of sentences is one sentence. Rows
    whose doc_id is null take no part. Rows that share doc_id and text are one document: a run at one
    place of both is one occurrence, so copies with the same doc_id don't remove each other. Rows with
    one doc_id and different texts are documents of their own. Other columns are carried along; added
    names that clash get an underscore. An empty table gives no rows.
    """
    send_package(docs.sparkSession)
    key, text_key, spans, cut, count, removed, firsts = free_names(
        docs, "span_doc_id", "span_text_hash", "spans", "cut", "n_sentences", "n_removed", "first_doc_ids"
    )
    found = (
        repeated_runs(docs, least).groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key))
        .agg(F.collect_set(F.col("first").cast("long") * (1 << 32) + F.col("last")).alias(spans),
             F.array_sort(F.collect_set("kept_doc_id")).alias(firsts))
    )
    joined = docs.join(found, (docs["doc_id"] == found[key]) & (_text_hash() == found[text_key])).withColumn(
        cut, _cut(F.col("text").cast("string"), F.col(spans))
    )
    columns = [F.col(f"{cut}.text").alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(
        *columns, F.col(f"{cut}.n_sentences").alias(count), F.col(f"{cut}.n_removed").alias(removed), firsts
    )
