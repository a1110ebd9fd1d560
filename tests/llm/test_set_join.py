from __future__ import annotations

import random
import time

import numpy as np
import pytest

from rowgauge.llm.queries import QUERIES
from rowgauge.llm import set_join
from rowgauge.llm.set_join import band_of, linked_sets, parities, signatures
from rowgauge.llm.words import mix

from .helpers import SCHEMA, SF, docs, odd_texts, prose
from .test_near_dup import LOWER


def brute_force(rows, similarity, size):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().translate(LOWER).split()
        sets[doc_id] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) * 100 < similarity * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if common and 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {(i, len(own), find(i)) for i, own in sets.items()}


def check(df, similarity=85, size=4):
    got = linked_sets(df, similarity, size).collect()
    assert {tuple(r) for r in got} == brute_force([(r.doc_id, r.text) for r in df.collect()], similarity, size)


def test_registered_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = QUERIES["op12_ngram_join"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_force([(r.doc_id, r.text) for r in rows], 85, 4)


@pytest.mark.parametrize("similarity", [50, 80, 85, 99, 100])
def test_sizes_that_fit_lie_in_one_band_or_neighbours(similarity):
    for n in range(1, 700):
        number, top, above = band_of(n, similarity)
        most = 100 * n // similarity
        assert n <= top and band_of(most, similarity)[0] <= number + 1 and most <= above
        if most > top:
            assert band_of(most, similarity)[1] == above


@pytest.mark.parametrize("similarity", [60, 80, 85, 95])
def test_sets_that_fit_share_a_signature(similarity):
    """At the very boundary, for all sizes, with differences on either or both sides."""
    rng = np.random.default_rng(similarity)
    for n in [*range(1, 80), 150, 333, 1000, 4000]:
        for _ in range(6):
            pool = mix(rng.integers(1, 2**63, 2 * n + 10).astype(np.uint64))
            only_b = int(rng.integers(0, n + 1))
            # The largest number of own elements of a that still fits.
            only_a = max((x for x in range(n) if 100 * (n - x) >= similarity * (n + only_b)), default=None)
            if only_a is None:
                only_b, only_a = 0, n - -(-n * similarity // 100)
            a, b = np.unique(pool[:n]), np.unique(pool[only_a : n + only_b])
            if only_a or only_b:
                assert len(np.intersect1d(signatures(a, similarity), signatures(b, similarity)))


def test_sets_with_empty_partitions_meet():
    """Elements that all fall into few partitions."""
    pool = mix(np.arange(1, 400_000, dtype=np.uint64))
    band = band_of(40, 85)[0]
    spread = mix(pool + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    k = 2 * band_of(40, 85)[1] * 15 // 185
    narrow = pool[spread % np.uint64(set_join.PARTS * (k // 2 + 2)) < 3][:44]
    for cut in range(1, 4):
        a, b = np.unique(narrow[:40]), np.unique(narrow[cut : 40 + cut])
        assert len(np.intersect1d(signatures(a, 85), signatures(b, 85)))


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (1, 5, 64, 129, 700):
        pool = mix(rng.integers(1, 2**63, 3 * n).astype(np.uint64))
        a, b = pool[:n], pool[n // 3 : n // 3 + n + n // 4]
        x, y = (np.unpackbits(parities(s).view(np.uint8), bitorder="little") for s in (a, b))
        bits = min(len(x), len(y))
        x, y = (v.reshape(-1, bits).sum(axis=0) % 2 for v in (x, y))
        differ = len(np.setxor1d(a, b))
        assert (x != y).sum() <= differ and (x != y).sum() % 2 == differ % 2


@pytest.mark.parametrize("small", [0, 2, 32])
def test_chains_hubs_and_copies(spark, monkeypatch, small):
    monkeypatch.setattr(set_join, "SMALL", small)
    base = prose(1, 140).split()
    texts = []
    for k in range(150):
        own = list(base)
        for j in range(k % 6):
            own[(k * 37 + j * 29) % len(own)] = f"new{k}y{j}"
        texts.append(" ".join(own))
    rng = random.Random(4)
    short = [" ".join(f"s{rng.randrange(6)}" for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    check(docs(spark, texts + [texts[0]] * 40 + [texts[7]] * 5 + short))


def test_passage_in_all_texts(spark):
    """Short texts that share most of their words, but are not similar enough."""
    passage = prose(9, 30)
    check(docs(spark, [f"{passage} {prose(k, 3 + k % 9)}" for k in range(300)]))


def test_boundary_of_similarity_is_exact(spark):
    words = [f"u{k}" for k in range(103)]
    longer = words + [f"v{k}" for k in range(20)]
    for similarity in (83, 84, 85):
        check(docs(spark, [" ".join(words), " ".join(longer), " ".join(words[:83])]), similarity)


def test_odd_texts_and_shorter_than_a_shingle(spark):
    check(docs(spark, odd_texts() + ["A b C", "a B c", "a b c d", "word", "", None, prose(5, 30_000) + " end"]))


def test_null_ids_repeated_ids_and_clashing_columns(spark):
    rows = [(None, prose(1), "a"), (3, prose(1), "b"), (3, prose(2), "c"), (5, prose(2), "d"), (2, prose(2), None), (5, prose(2), "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string")
    df = df.selectExpr("*", "1 AS component_id", "2 AS n_shingles", "3 AS digest", "4 AS Id")
    got = sorted(((r.doc_id, r.component_id) for r in linked_sets(df, 85, 4).collect()), key=str)
    assert got == sorted([(None, None), (3, 2), (3, 2), (5, 2), (5, 2), (2, 2)], key=str)


def test_empty_table(spark):
    assert linked_sets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shuffle_files_go_as_their_queries_end(spark):
    """Not when the driver next collects garbage: until then the disk would hold those of all queries."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in held.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before = shuffled()
    found = linked_sets(docs(spark, [prose(k % 30, 40 + k % 3) for k in range(120)]), 85, 4)
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left
    assert found.count() == 120
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_cheaper_hashing_gives_the_same_signatures():
    """Against sums, names and sorting by the plain rules, for narrow and wide parts."""
    rng = np.random.default_rng(3)
    for n in (3, 40, 700, 30_000, 500_000):
        elements = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        number, top, above = band_of(len(elements), 85)
        plain = []
        for band, largest in ((number, top), (number + 1, above)):
            k = 2 * largest * 15 // 185
            if k == 0 or band > number and 100 * len(elements) < 85 * (top + 1):
                continue
            parts = 2 * (k // 2 + 2 + k // set_join.SPARE)
            spread = mix(elements + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            value, size = np.zeros(parts, np.uint64), np.zeros(parts, np.int64)
            np.add.at(value, spread % np.uint64(parts), mix(spread))
            np.add.at(size, spread % np.uint64(parts), 1)
            chosen, empty = value.reshape(-1, 2)[:, ::-1], size.reshape(-1, 2)[:, ::-1] < set_join.LEAST
            names = np.arange(1, parts + 1, dtype=np.uint64).reshape(-1, 2) + (np.uint64(band + 1) << np.uint64(40))
            keys = mix(mix(chosen) ^ mix(names))
            plain.append(keys[~empty] if empty.any(axis=1).sum() <= 1 + k // set_join.SPARE else keys.ravel())
        want = np.unique(np.concatenate(plain)) if plain else elements[:0]
        assert np.array_equal(signatures(elements, 85), want)


@pytest.mark.parametrize("similarity", [60, 85, 95])
def test_sets_that_fit_share_as_many_signatures_as_each_needs(similarity):
    """At the very boundary, in the band of the larger set, also where elements fall into few parts."""
    rng = np.random.default_rng(similarity)
    for n in [*range(2, 60), 150, 333, 1000, 4000]:
        for few in (False, False, True):
            pool = mix(rng.integers(1, 2**63, (40 if few and n < 500 else 2) * n + 10).astype(np.uint64))
            if few:
                band, top, _ = band_of(n, similarity)
                k = 2 * top * (100 - similarity) // (100 + similarity)
                parts = np.uint64(set_join.PARTS * (k // 2 + 2 + k // set_join.SPARE))
                spread = mix(pool + np.uint64((band + 1) * set_join._BAND % (1 << 64)))
                pool = pool[spread % parts < max(3, k // 2)]
            only_b = int(rng.integers(0, n // 2 + 1))
            only_a = max((x for x in range(n) if 100 * (n - x) >= similarity * (n + only_b)), default=None)
            if only_a is None or len(pool) < n + only_b or not only_a + only_b:
                continue
            a, b = np.unique(pool[:n]), np.unique(pool[only_a : n + only_b])
            band = band_of(max(len(a), len(b)), similarity)[0]
            (keys, least), (other, other_least) = (set_join.marked_signatures(x, similarity) for x in (a, b))
            common = np.intersect1d(keys, other)
            shared = (common % np.uint64(2) == band % 2).sum()
            assert shared >= max(least[band % 2], other_least[band % 2], 1)


def test_texts_with_a_passage_in_common_leave_large_buckets(spark, monkeypatch):
    """They fit none by it: their sets are neither made again nor dealt by all their shingles."""
    monkeypatch.setattr(set_join, "SMALL", 2)
    kept = {}
    keep = set_join.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(set_join.Scratch, "keep", counted)
    passage = prose(3, 40)
    apart = [f"{prose(100 + k, 200)} {passage}" for k in range(60)]
    check(docs(spark, [*apart, apart[0] + " one more"]))
    assert kept["sets"] < 20 and "links2" not in kept


def test_signatures_are_dealt_once(spark, monkeypatch):
    """Counted and joined alike, so one exchange of them serves both sides."""
    plans = {}
    keep = set_join.Scratch.keep

    def planned(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(set_join.Scratch, "keep", planned)
    linked_sets(docs(spark, [prose(k % 30, 40 + k % 3) for k in range(60)]), 85, 4)
    assert "explode(keys" in plans["met"] and "LeftSemi" not in plans["met"]
