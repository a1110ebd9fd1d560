"""Token-ID files: texts as ids of a public tokenizer, entropy coded in blocks."""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter, itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rans import FrequencyTable, decode, encode
from .scratch import Scratch, send_package
from .words import LOWER, byte_texts, kept, pieces

#: A block is closed when it holds so many ids; it always holds whole documents.
BLOCK_TOKENS = 1 << 20
#: Rows of one doc_id are dealt by so many characters of their text.
DEALT_CHARS = 256

_TABLE = "id long, frequency long, bits int, vocabulary long"
_BLOCK = "start long, n_tokens long, doc_ids array<long>, lengths array<long>, block binary"
_ROWS = "part long, start long, n_tokens long, doc_ids array<long>, lengths array<long>"


_FIRST, _ID = itemgetter(0), attrgetter("id")
# ASCII signs that end a piece; the apostrophe is not among them, since it starts tokens of its own.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class PieceIds:
    """Piece between ASCII white space to its ids as little-endian 32-bit integers.

    White space ends every token of a tokenizer that drops it, so the ids of a text are those of
    its pieces one after another; pieces seen before are not encoded again. Where the tokenizer
    lower-cases and splits letters from signs, a piece such as `word,` is put together from `word`
    and `,`. Of what was seen, the last MOST pieces at least are remembered, twice as many at most.
    """

    MOST = 500_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.now: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        # Whether these hold is asked of the tokenizer, with every sign and two kinds of letters.
        self.folds_case = self._whole(b"ABC xYz \xc3\xa9A") == self._whole(b"abc xyz \xc3\xa9a")
        self.splits_signs = all(
            self._whole(x + bytes([c]) * n) == self._whole(x) + self._whole(bytes([c]) * n)
            for x in (b"the", b"caf\xc3\xa9", b"7") for c in _SIGNS for n in (1, 3)
        )
        letters = [bytes([c]) for c in range(97, 123)]
        self.letters_whole = all(
            self._whole(x) == self._of_model(x)
            for x in (b"the", b"fluffiest", b"ijsselmeer", b"llm", b"qzxvkjw" * 50, *letters, *(b"re" + x + b"st" for x in letters))
        )

    def _whole(self, piece: bytes) -> bytes:
        return array("I", self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _of_model(self, word: bytes) -> bytes:
        return array("I", map(_ID, self.model.tokenize(word.decode()))).tobytes()

    def _parts(self, piece: bytes) -> tuple[bytes, ...]:
        """A word and the signs behind it, if the tokenizer surely cuts between them."""
        word = piece.rstrip(_SIGNS)
        if self.splits_signs and 0 < len(word) < len(piece) and b"<|" not in piece:
            if word[-1:].isalnum():  # ASCII
                return word, piece[len(word) :]
            # Case folding can leave a mark at the end, which belongs to the signs.
            last = unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower()[-1]
            if last.isalpha():
                return word, piece[len(word) :]
        return (piece,)

    def learn(self, wanted: set[bytes]) -> None:
        """Have the ids of all wanted pieces in `now`."""
        if len(self.now) > self.MOST:
            self.earlier, self.now = self.now, {}
        now, earlier = self.now, self.earlier
        missing = wanted.difference(now)
        for piece in missing.intersection(earlier):
            now[piece] = earlier[piece]
        missing.difference_update(earlier)
        signed = [piece for piece in missing if piece[-1] in _SIGNS]
        cut = [(piece, parts) for piece, parts in zip(signed, map(self._parts, signed)) if len(parts) > 1]
        missing.difference_update(piece for piece, _ in cut)
        missing.update(x for _, parts in cut for x in parts if x not in now)
        if self.letters_whole:
            # A word of small letters goes to the tokenizer's model as it is.
            words = [piece for piece in missing if piece.islower() and piece.isalpha()]
            missing.difference_update(words)
            now.update(zip(words, map(self._of_model, words)))
        new = list(missing)
        for start in range(0, len(new), 2048):
            some = new[start : start + 2048]
            # One call for many pieces between blanks; a token belongs to the piece it starts in.
            text = b" ".join(some).decode("utf-8", "replace")
            found = self.tokenizer.encode(text, add_special_tokens=False)
            begins = np.fromiter(map(_FIRST, found.offsets), np.int64, len(found.offsets))
            after = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32) + 1
            ids, cuts = array("I", found.ids).tobytes(), [0, *(4 * np.searchsorted(begins, after)).tolist(), 4 * len(begins)]
            now.update(zip(some, map(ids.__getitem__, map(slice, cuts, cuts[1:]))))
        now.update((piece, now[word] + now[signs]) for piece, (word, signs) in cut)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        # Special tokens are told by their case, so texts that may hold one stay as they are.
        split = [(t.translate(LOWER) if self.folds_case and b"<|" not in t else t).split() for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.now.__getitem__, words))


def _chunks(path: str, end_id: int, block_tokens: int, kind: str):
    """Tokenize documents in the order given and pack them into future blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = kept(path, lambda: PieceIds(path)), TaskContext.get().partitionId()
        end = array("I", [end_id]).tobytes()
        start, names, lengths, held, size = 0, [], [], [], 0

        def packed() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), np.uint32).astype(kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([tokens.tobytes()], pa.binary())],
                names=["part", "start", "n_tokens", "doc_ids", "lengths", "ids"],
            )

        for batch in pieces(batches, "text"):
            gc.disable()  # no cycles here, only long lists of words that the collector would walk again and again
            try:
                found = list(ids.encode(byte_texts(batch.column("text"))))
            finally:
                gc.enable()
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), found):
                names.append(doc_id)
                held.append(tokens + end)
                lengths.append(len(tokens) // 4 + 1)
                size += lengths[-1]
                if size >= block_tokens:
                    yield packed()
                    start, names, lengths, held, size = start + size, [], [], [], 0
        if names:
            yield packed()

    return run


def _counts(kind: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(ids, kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _blocks(kind: str, scaled: np.ndarray, bits: int, offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(scaled, bits)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                part, start = one.column("part")[0].as_py(), one.column("start")[0].as_py()
                block = encode(np.frombuffer(one.column("ids")[0].as_py(), kind), table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([offsets[part] + start], pa.int64()), one.column("n_tokens"),
                     one.column("doc_ids"), one.column("lengths"), pa.array([block], pa.binary())],
                    names=["start", "n_tokens", "doc_ids", "lengths", "block"],
                )

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write the ids of all texts, in ascending doc_id order, as a token table under `path`.

    `path/table` has the shared frequency table, one row for each id that occurs; `path/blocks` has
    one row per block: `start` (ids before it in the whole corpus), its documents and their numbers
    of ids, and the encoded block, which can be decoded by itself, or from its checkpoints, and
    carries a checksum. Every document ends with `end_id`. `tokenizer` is a file of the tokenizers
    library, at the same path on all workers, of a kind that drops white space.

    Documents are dealt into ranges of doc_id and the text's beginning, so that rows of one doc_id, or of
    none, are spread as well (copies of one such row are not), tokenized once, and kept as raw ids; two passes over
    these count and encode. The driver receives the counts (as many as the vocabulary) and one
    number per range.

    Null text is empty: its document has `end_id` only. A null doc_id comes first. Rows that share a
    doc_id follow each other, ordered by text. Other columns are not read. An empty table gives an
    empty token table. Raises an error if `path` has data already.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id", F.substring("text", 1, DEALT_CHARS))
        .sortWithinPartitions("doc_id", "text")
    )
    chunks = scratch.keep(
        ordered.mapInArrow(_chunks(tokenizer, end_id, block_tokens, kind), f"{_ROWS}, ids binary"), "chunks"
    )
    counted = (
        chunks.select("ids").mapInArrow(_counts(kind, vocabulary), "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.zeros(vocabulary, dtype=np.int64)
    for row in counted:
        counts[row.id] = row.n
    offsets, total = {}, 0
    for row in sorted(chunks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        offsets[row.part], total = total, total + row.n
    table = FrequencyTable.from_counts(counts)
    scaled = table.scaled.astype(np.uint32)
    spark.createDataFrame(
        [(int(i), int(scaled[i]), table.bits, vocabulary) for i in np.flatnonzero(scaled)],
        _TABLE,
    ).coalesce(1).write.parquet(f"{path}/table")
    chunks.mapInArrow(
        _blocks(kind, scaled, table.bits, offsets),
        _BLOCK,
    ).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")
    scratch.drop("chunks")


def _documents(scaled: np.ndarray, bits: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(scaled, bits)
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = decode(batch.column("block")[row].as_py(), table).astype("<u4")
                lengths = np.array(batch.column("lengths")[row].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                if digest:
                    values = pa.array([zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64())
                else:
                    values = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(starts + batch.column("start")[row].as_py()),
                     pa.array(lengths), values],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def _read(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    send_package(spark)
    table = spark.read.schema(_TABLE).parquet(f"{path}/table").collect()  # at most as many rows as the vocabulary
    scaled = np.zeros(table[0].vocabulary if table else 1, dtype=np.uint32)
    for row in table:
        scaled[row.id] = row.frequency
    last = "ids_crc32 long" if digest else "ids array<int>"
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(
        _documents(scaled, table[0].bits if table else 16, digest),
        f"doc_id long, start long, n_tokens long, {last}",
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token table."""
    return _read(spark, path, digest=False)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): read_tokens with the ids summed up while decoding.

    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    return _read(spark, path, digest=True)
