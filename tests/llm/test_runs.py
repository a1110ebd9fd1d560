from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from rowgauge.llm.queries import QUERIES
from rowgauge.llm.runs import Matches, lyndon_array, periodic_runs, runs_of, word_runs
from rowgauge.llm.words import WordHashes

from .helpers import SCHEMA, SF, docs, odd_texts


def brute_lyndon(s):
    """Longest Lyndon word at each place: up to the next smaller suffix."""
    n = len(s)
    return [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i for i in range(n)]


def brute_runs(words, least=12):
    """Maximal stretches for every period, without those that have a smaller one."""
    n, found = len(words), []
    codes = np.array([hash(w) for w in words]) if n else np.zeros(0)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for begin, end in edges.tolist():
            if end - begin < q or end - begin + q < least:
                continue
            part = words[begin : end + q]
            if not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((begin, len(part), q))
    return sorted(found)


def brute_document(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (
        doc_id, len(found), *longest, longest[1] * 1000 // longest[2] if found else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_registered_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r)[:8] for r in QUERIES["op11_word_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_document(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > len(got) // 20


@pytest.mark.parametrize("symbols", [1, 2, 3, 8])
def test_lyndon_array(symbols):
    rng = random.Random(symbols)
    for n in (*range(12), 30, 60, 200):
        for _ in range(20):
            s = [rng.randrange(symbols) for _ in range(n)]
            assert lyndon_array(s) == brute_lyndon(s)


def test_lyndon_array_of_long_sequences_is_fast():
    n = 200_000
    for s in ([0] * n, list(range(n)), list(range(n, 0, -1)), [0, 1] * (n // 2), [0, 0, 1] * (n // 3)):
        assert len(lyndon_array(s)) == len(s)


def test_longest_common_extensions():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 50):
        s = rng.integers(0, 2, n)
        a, b = (x.ravel() for x in np.triu_indices(n, 1))
        want = [next((k for k in range(n - j) if s[i + k] != s[j + k]), n - j) for i, j in zip(a, b)]
        assert Matches(s).forward(a, b).tolist() == want


def test_runs_of_many_sequences_at_once():
    rng = random.Random(7)
    parts = []
    for _ in range(200):
        base = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        parts.append(base * rng.randrange(1, 5) + [rng.randrange(3) for _ in range(rng.randrange(9))])
    got = runs_of([np.array(p) for p in parts])
    assert got == [brute_runs(p, 2) for p in parts]


def test_short_periods_long_texts_and_neighbouring_runs():
    rng = random.Random(3)
    texts = []
    for k in range(60):
        words = [b"w%d" % rng.randrange(40) for _ in range(rng.randrange(80))]
        for _ in range(3):
            at, root = rng.randrange(len(words) + 1), [b"r%d" % rng.randrange(3) for _ in range(rng.randrange(1, 7))]
            words[at:at] = root * rng.randrange(2, 9)
        texts.append(words)
    texts += [[b"a"] * 3000, [b"a", b"b"] * 6, [b"a", b"b"] * 5 + [b"a"], [], [b"x"] * 11, [b"x"] * 12]
    assert word_runs(texts, WordHashes()) == [brute_runs(t) for t in texts]


def test_odd_texts_repeats_nulls_and_clashing_columns(spark):
    df = docs(spark, odd_texts() + ["a b " * 20, "a b " * 20], [None, 1, 2, 3, 4, 5, 6, 7, 8, 8])
    rows = periodic_runs(df.selectExpr("*", "1 AS start", "2 AS n_runs", "3 AS Words")).collect()
    assert len(rows) == 10
    (one, two) = [r for r in rows if r.doc_id == 8]
    assert one == two and (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (1, 0, 40, 2, 20_000)
    assert one.collapsed == "a b" and one.n_kept == 2
    empty = next(r for r in rows if r.doc_id == 1)
    assert empty.n_runs == 0 and empty.start is None and empty.collapsed is None
    assert empty.runs_sha256 == empty.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
