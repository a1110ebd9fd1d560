from __future__ import annotations

import collections
import re

import numpy as np
import pytest

from rowgauge.llm.graph import components
from rowgauge.llm.near_dup import near_duplicates, signature
from rowgauge.llm.queries import QUERIES
from rowgauge.llm.words import mix

from .helpers import SCHEMA, SF, docs, odd_texts, prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_force(rows, similarity):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[doc_id] = set(runs)
    holders = collections.defaultdict(list)
    for doc_id, own in sets.items():
        for shingle in own:
            holders[shingle].append(doc_id)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for doc_id, own in sets.items():
        shared = collections.Counter(j for s in own for j in holders[s] if j > doc_id)
        for other, n in shared.items():
            if 100 * n >= similarity * (len(own) + len(sets[other]) - n):
                a, b = sorted((find(doc_id), find(other)))
                root[b] = a
    return {i: (len(own), find(i)) for i, own in sets.items()}


def result(df, similarity=85):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, similarity).collect()}


def check(df, similarity=85):
    want = brute_force([(r.doc_id, r.text) for r in df.collect()], similarity)
    got = result(df, similarity)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_registered_query_equals_brute_force(spark):
    want = brute_force([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 85)
    got = QUERIES["op5_minhash_near_dedup"](spark, SF).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (i, n, c, c == i) for i, (n, c) in want.items()
    }
    assert len(got) == len(want)


def test_group_of_near_copies_whose_members_are_not_all_linked(spark):
    base = prose(1, 140).split()
    texts = []
    for k in range(150):
        own = list(base)
        for j in range(k % 8):
            own[(k * 37 + j * 29) % len(own)] = f"new{k}y{j}"
        texts.append(" ".join(own))
    check(docs(spark, texts + [texts[0]] * 40 + [texts[7]] * 5))


def test_odd_texts_and_shorter_than_a_shingle(spark):
    check(docs(spark, odd_texts() + ["A b C", "a B c", "a b c d", "word", "", None, prose(5, 30_000) + " end"]))


def test_boundary_of_similarity_is_exact(spark):
    words = [f"u{k}" for k in range(104)]
    longer = words + [f"v{k}" for k in range(20)]
    shorter = words[:84]
    for similarity in (80, 84):
        check(docs(spark, [" ".join(words), " ".join(longer), " ".join(shorter)]), similarity)


def test_null_ids_repeated_ids_and_clashing_columns(spark):
    rows = [(None, prose(1), "a"), (3, prose(1), "b"), (3, prose(2), "c"), (5, prose(2), "d"), (2, prose(2), None), (5, prose(2), "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumnsRenamed({})
    df = df.selectExpr("*", "1 AS component_id", "2 AS n_shingles", "3 AS digest", "4 AS Key")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, 85).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 2, False), (3, 2, False), (5, 2, False), (5, 2, False), (2, 2, True)], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = mix(rng.integers(1, 2**63, 4000).astype(np.uint64))
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    agree = (signature(a, 1024) == signature(b, 1024)).mean()
    assert agree == pytest.approx(0.5, abs=0.06)


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)} | {2000: 2000, 2001: 2000}
