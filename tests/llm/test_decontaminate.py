from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from rowgauge.llm import decontaminate
from rowgauge.llm.decontaminate import CLOSE, MASKS, benchmark_overlaps, best_run, masks_for, plain_words, without_overlaps
from rowgauge.llm.queries import QUERIES

from .helpers import SCHEMA, SF, docs, odd_texts, prose


def brute_force(texts, items, percent=80, least=13):
    """{(doc, item)} by trying every diagonal of every pair."""
    found = set()
    for doc, text in texts:
        words = plain_words((text or "").encode())
        for item, other in items:
            own = plain_words((other or "").encode())
            if len(own) < 5:
                continue
            for diagonal in range(1 - len(own), len(words)):
                low, high = max(0, -diagonal), min(len(own), len(words) - diagonal)
                equal = np.array([words[i + diagonal] == own[i] for i in range(low, high)])
                if not equal.sum() >= min(5, len(own)):
                    continue
                start, stop = best_run(equal, percent)
                n = equal[start:stop].sum()
                if stop - start >= min(least, len(own)) and 100 * n >= percent * (stop - start):
                    found.add((doc, item))
    return found


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_registered_query_equals_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    short = [(i, t) for i, t in texts if len(t) < 3000]
    got = pairs(QUERIES["op8_benchmark_overlaps"](spark, SF))
    known = {i for i, _ in short}
    assert {p for p in got if p[0] in known} == brute_force(short, items)
    assert got


def test_substitutions_up_to_a_fifth_are_found(spark):
    item = prose(3, 60)
    words = item.split()
    changed = [w if k % 6 != 5 else f"other{k}" for k, w in enumerate(words)]
    many = [w if k % 3 else f"other{k}" for k, w in enumerate(words)]
    texts = [f"{prose(4)} {' '.join(changed)} {prose(5)}", f"{prose(6)} {' '.join(many)}", prose(7), item.upper().replace(" ", " -- ")]
    rows = {(r.doc_id, r.item_id): r for r in benchmark_overlaps(docs(spark, texts), bench(spark, [item])).collect()}
    assert set(rows) == {(0, 0), (3, 0)}
    hit = rows[(0, 0)]
    assert (hit.doc_word, hit.item_word) == (120, 0) and hit.n_words >= 59 and hit.n_equal == 50
    assert rows[(3, 0)].n_equal == 60


def test_short_items_and_blocks(spark):
    items = ["one two three four", "five six seven eight nine", prose(1, 12), prose(2, 13), prose(3, 40), None, "", prose(3, 40)]
    texts = [" ".join(t or "" for t in items), "five six seven eight ten", prose(3, 40)[40:], prose(2, 12), "x five six seven eight nine"]
    whole = pairs(benchmark_overlaps(docs(spark, texts), bench(spark, items)))
    blocked = pairs(benchmark_overlaps(docs(spark, texts), bench(spark, items), block_words=20))
    assert whole == blocked == brute_force(list(enumerate(texts)), list(enumerate(items)))
    assert (4, 1) in whole and (1, 1) not in whole


def test_odd_texts_nulls_repeats_and_clashing_columns(spark):
    item = prose(8, 30)
    df = docs(spark, odd_texts() + [item, item], [None, 1, 2, 3, 4, 5, 6, 7, None, 9])
    df = df.union(df.where("doc_id = 9")).selectExpr("*", "1 AS item_id", "2 AS n_words")
    found = benchmark_overlaps(df, bench(spark, [item]).selectExpr("*", "5 AS doc_id"))
    assert sorted(str(r.doc_id) for r in found.collect()) == ["9", "9", "None"]
    none = spark.createDataFrame([], SCHEMA)
    assert benchmark_overlaps(none, bench(spark, [item])).collect() == []
    assert benchmark_overlaps(df, bench(spark, [item]).limit(0)).collect() == []


def test_a_word_repeated_without_end(spark):
    df = docs(spark, ["the " * 20_000, prose(1)])
    found = benchmark_overlaps(df, bench(spark, ["the " * 40, prose(2)])).collect()
    assert [(r.doc_id, r.item_id, r.n_equal) for r in found] == [(0, 0, 40)]


def test_masks_are_of_one_shape():
    assert all(re.fullmatch("1[01]{9}1", m) and m.count("1") == 7 for m in MASKS)


@pytest.mark.parametrize("equal,want", [([1, 1, 1], (0, 3)), ([0, 0, 1, 1, 0], (2, 4)), ([1] * 8 + [0] + [1] * 8, (0, 17))])
def test_best_run(equal, want):
    assert best_run(np.array(equal, dtype=bool), 80) == want


def by_the_rule(text, item, percent=80, least=13):
    """Whether any run on any diagonal has words enough of which enough agree; every run is tried."""
    words, own = plain_words(text.encode()), plain_words(item.encode())
    least = min(least, len(own))
    for diagonal in range(1 - len(own), len(words)):
        low, high = max(0, -diagonal), min(len(own), len(words) - diagonal)
        total = [0, *itertools.accumulate(words[i + diagonal] == own[i] for i in range(low, high))]
        for start in range(len(total)):
            for stop in range(start + least, len(total)):
                n = total[stop] - total[start]
                if n >= 5 and 100 * n >= percent * (stop - start):
                    return True
    return False


def substituted(item, places):
    return " ".join(f"other{k}" if k in places else w for k, w in enumerate(item.split()))


def test_every_run_that_meets_the_rule_is_found(spark):
    rng = random.Random(1)
    texts, items = [], []
    for k in range(300):
        size = rng.choice([*range(5, 31), 40, 60])
        item = prose(1000 + k, size)
        some = rng.sample(range(size), min(size, size // 5 + (k % 7 == 0)))
        if k % 5 == 0:
            some = range(k % 4, size, 5)
        items.append(item)
        texts.append(f"before {substituted(item, set(some))} after")
    want = {(k, k) for k in range(300) if by_the_rule(texts[k], items[k])}
    assert len(want) > 200
    assert pairs(benchmark_overlaps(docs(spark, texts), bench(spark, items))) == want


@pytest.mark.parametrize("size,changed", [(13, 2), (15, 3), (20, 4), (25, 5)])
def test_a_mask_fits_wherever_the_substitutions_are(size, changed):
    """Every longer run that meets the rule holds one of these lengths that does."""
    masks = [(int(m[::-1], 2) << at) for m in (*MASKS, CLOSE) for at in range(size - len(m) + 1)]
    for places in itertools.combinations(range(size), changed):
        gone = sum(1 << p for p in places)
        assert any(not gone & mask for mask in masks), places


@pytest.mark.parametrize("size,percent,least", [(6, 80, 13), (10, 80, 13), (12, 80, 13), (14, 70, 9), (16, 60, 13)])
def test_masks_of_short_items_and_other_shares(size, percent, least):
    (mask,) = masks_for(size, percent, least)
    for n in range(min(size, least), size + 1):
        for places in itertools.combinations(range(n), min(n * (100 - percent) // 100, n - 5)):
            assert "1" * len(mask) in "".join("0" if k in places else "1" for k in range(n))


@pytest.mark.parametrize("equal,want", [([1] * 3 + [0] + [1] * 9, (0, 13)), ([0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1], (0, 5)), ([0, 0], (0, 0)), ([], (0, 0))])
def test_best_run_is_the_longest(equal, want):
    assert best_run(np.array(equal, dtype=bool), 80) == want


def test_both_ways_to_drop_leaking_rows_agree(spark, monkeypatch):
    table, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    # A third of the rows have no doc_id.
    table = table.selectExpr("if(doc_id % 3 = 0, null, doc_id) AS doc_id", "text", "source")
    near = without_overlaps(table, benchmark)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    far = without_overlaps(table, benchmark)
    assert 0 < near.count() < table.count()
    assert near.exceptAll(far).isEmpty() and far.exceptAll(near).isEmpty()
