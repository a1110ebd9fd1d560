from __future__ import annotations

import zlib

import numpy as np
import pytest

from rowgauge.llm.queries import END_ID, QUERIES, tokenizer_path
from rowgauge.llm.rans import CHECKPOINT_STEPS, LANES, FrequencyTable, decode, encode
from rowgauge.llm.tokens import PieceIds, read_digests, read_tokens, write_tokens
from rowgauge.llm.words import WordHashes, kept

from .helpers import SCHEMA, SF, docs, odd_texts, prose


def expected(rows):
    """(doc_id, start, n_tokens, crc) of texts encoded whole, one at a time."""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_registered_query_equals_whole_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = QUERIES["op3_token_blocks"](spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_odd_texts_round_trip(spark, tmp_path):
    texts = odd_texts() + ["a<|endoftext|>b", "it's  we'll x", "é ́a", None, prose(9)]
    path = str(tmp_path / "t")
    write_tokens(docs(spark, texts), path, tokenizer_path(), END_ID, block_tokens=1000)
    assert [tuple(r) for r in read_digests(spark, path).orderBy("start").collect()] == expected(list(enumerate(texts)))
    for r in read_tokens(spark, path).collect():
        assert len(r.ids) == r.n_tokens and r.ids[-1] == END_ID


def test_null_and_repeated_ids_come_in_order(spark, tmp_path):
    df = docs(spark, ["c", "b", "a", "b", None, "z z"], [2, 1, None, 1, 0, None]).withColumnRenamed("lang", "ids")
    path = str(tmp_path / "t")
    write_tokens(df.selectExpr("*", "1 AS part", "2 AS start"), path, tokenizer_path(), END_ID)
    got = read_digests(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([(None, "a"), (None, "z z"), (0, None), (1, "b"), (1, "b"), (2, "c")])


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_tokens(spark.createDataFrame([], SCHEMA), path, tokenizer_path(), END_ID)
    assert read_tokens(spark, path).collect() == []


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 16 * LANES - 1, 16 * LANES, 3 * CHECKPOINT_STEPS * LANES + 5])
def test_blocks_decode_whole_and_from_checkpoints(n):
    tokens = np.minimum(np.random.default_rng(n).zipf(1.3, max(n, 1)), 40_000).astype(np.uint16)
    table = FrequencyTable.from_counts(np.bincount(tokens, minlength=49_408))
    tokens = tokens[:n]
    block = encode(tokens, table)
    assert np.array_equal(decode(block, table), tokens)
    for first in {0, n // 3, n - n // 5, max(0, n - 1)}:
        assert np.array_equal(decode(block, table, first, first + 700), tokens[first : first + 700])


def test_one_symbol_and_rare_symbols():
    for counts in ([0, 7, 0], [1] * 30_000 + [10**12]):
        table = FrequencyTable.from_counts(np.array(counts))
        assert int(table.scaled.sum()) == 1 << table.bits
        tokens = np.flatnonzero(counts)
        assert np.array_equal(decode(encode(tokens, table), table), tokens)


def test_damage_and_foreign_tables_are_found():
    tokens = np.arange(1000) % 7
    table = FrequencyTable.from_counts(np.bincount(tokens))
    block = bytearray(encode(tokens, table))
    with pytest.raises(ValueError, match="table"):
        decode(bytes(block), FrequencyTable.from_counts(np.arange(1, 8)))
    block[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        decode(bytes(block), table)


def test_blocks_are_near_the_entropy():
    tokens = np.minimum(np.random.default_rng(1).zipf(1.4, 250_000), 40_000)
    counts = np.bincount(tokens)
    share = counts[counts > 0] / len(tokens)
    bits = -(share * np.log2(share)).sum() * len(tokens)
    assert len(encode(tokens, FrequencyTable.from_counts(counts))) * 8 < bits * 1.2


def test_rows_without_doc_id_are_dealt_to_several_tasks(spark, tmp_path):
    texts = [f"{i * 7919 % 400} words of row {i}" for i in range(400)]
    df = docs(spark, texts, [None if i < 300 else i for i in range(400)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        write_tokens(df, str(tmp_path / "t"), tokenizer_path(), END_ID)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "t/blocks")).selectExpr("_metadata.file_name AS f", "size(doc_ids) AS n")
    assert max(r["sum(n)"] for r in files.groupBy("f").sum("n").collect()) < 120
    rows = [(None, t) for t in sorted(texts[:300])] + list(enumerate(texts))[300:]
    got = read_digests(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_words_of_letters_go_to_the_model(monkeypatch):
    ids = PieceIds(tokenizer_path())
    sent = []
    monkeypatch.setattr(ids, "tokenizer", None)  # whole texts are not asked for
    monkeypatch.setattr(ids, "_of_model", lambda word, of=ids._of_model: sent.append(word) or of(word))
    found = list(ids.encode([b"Quovadis the QUOVADIS", b"the"]))
    whole = PieceIds(tokenizer_path())
    assert found == [whole._whole(b"quovadis the quovadis"), whole._whole(b"the")]
    assert sorted(sent) == [b"quovadis", b"the"]


def test_a_worker_keeps_the_pieces_of_one_operator():
    made = kept("pieces", list)
    assert kept("pieces", list) is made
    WordHashes()
    assert kept("pieces", list) is not made
    other = kept("others", list)
    assert kept("others", list) is other and kept("pieces", list) is not made
