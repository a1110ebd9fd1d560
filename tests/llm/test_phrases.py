from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from rowgauge.llm import phrases
from rowgauge.llm.phrases import collocations, path_phrases, phrase_counts, summed, unary_paths
from rowgauge.llm.queries import QUERIES

from .helpers import SCHEMA, SF, docs, odd_texts


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_counts(rows, longest):
    counts = collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                counts.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    return counts


def brute_force(rows, longest=3, least=10, percent=50, most=2000):
    counts = brute_counts(rows, longest)
    found = {g: n for g, n in counts.items() if len(g) > 2 and n >= least}
    dropped = set()
    for longer, n in found.items():
        words = longer[1:]
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (longer[0], *words[i : i + k])
                if 100 * n >= percent * found[part]:
                    dropped.add(part)
    by_lang = collections.defaultdict(list)
    for gram, a in found.items():
        if gram in dropped:
            continue
        lang, words = gram[0], gram[1:]
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(words).encode(), l, r))
    n = collections.Counter()
    for gram, f in counts.items():
        n[gram[0]] += f if len(gram) == 2 else 0
    return {
        (lang, k + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, own in by_lang.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:most])
    }


def texts_of(df):
    return [(r.lang, r.text) for r in df.collect()]


def test_registered_query_equals_brute_force(spark):
    want = brute_force(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    got = QUERIES["op13_phrases"](spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_counts_of_all_lengths_follow_from_the_longest_grams(spark, monkeypatch, longest):
    """Over several batches and parts."""
    monkeypatch.setattr(phrases, "PART_BYTES", 2000)
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["a", "B", "c.", "d,e", "é f", "g\th\n", "i"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(t, ["en", None, "x y", "und"][k % 4]) for k, t in enumerate(texts)], "text string, lang string")
    want = brute_counts(texts_of(df), longest)
    got = phrase_counts(df, longest, 3).collect()
    phrases_found = {(r.lang, *r.phrase.split(" ")): r.n for r in got if r.words}
    assert phrases_found == {g: n for g, n in want.items() if n >= 3}
    totals = collections.Counter()
    for gram, n in want.items():
        totals[gram[0]] += n if len(gram) == 2 else 0
    assert {r.lang: r.n for r in got if not r.words} == totals


def test_rows_of_large_numbers_are_summed_exactly():
    """More numbers than fit three to 64 bits."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 40, (500, 3))[rng.integers(0, 500, 4000)]
    got, counts = summed(rows, np.arange(4000), 1 << 40)
    want = collections.Counter()
    for k, row in enumerate(rows.tolist()):
        want[tuple(row)] += k
    assert dict(zip(map(tuple, got.tolist()), counts.tolist())) == want


def brute_paths(edges):
    """Walk from every edge whose source is no unary node; what is left are circles."""
    out, into = collections.defaultdict(list), collections.defaultdict(list)
    for e in edges:
        words = e.split(" ")
        out[tuple(words[:-1])].append(e)
        into[tuple(words[1:])].append(e)

    def unary(node):
        return len(out[node]) == 1 and len(into[node]) == 1

    left, found = set(edges), []

    def walk(e):
        path = []
        while e in left:
            path.append(e)
            left.remove(e)
            node = tuple(e.split(" ")[1:])
            if not unary(node):
                break
            e = out[node][0]
        found.append(tuple(path))

    for e in sorted(edges):
        if not unary(tuple(e.split(" ")[:-1])):
            walk(e)
    while left:
        walk(min(left))
    return set(found)


@pytest.mark.parametrize("seed", range(3))
def test_unary_paths(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    edges = {" ".join(rng.choices(words[: 5 + 10 * seed], k=3)) for _ in range(40)}
    chain = [f"c{k}" for k in range(70)]
    edges |= {" ".join(chain[k : k + 3]) for k in range(len(chain) - 2)}
    circle = [f"r{k % 7}" for k in range(9)]
    edges |= {" ".join(circle[k : k + 3]) for k in range(7)} | {"s s s", "p q p", "q p q"}
    df = spark.createDataFrame([("en", e, 10 + len(e)) for e in edges] + [("de", "c0 c1 c2", 5)], "lang string, phrase string, n long")
    paths = unary_paths(df)
    rows = paths.collect()
    assert all([s.hops for s in r.steps] == list(range(len(r.steps))) for r in rows)
    assert {tuple(s.phrase for s in r.steps) for r in rows if r.lang == "en"} == brute_paths(edges)
    whole = {r.phrase: (r.words, r.least) for r in path_phrases(paths).where("lang = 'en'").collect()}
    assert whole[" ".join(chain)] == (70, 18)


def test_longer_phrases_ties_and_limit(spark):
    rng = random.Random(2)
    base = [[f"t{rng.randrange(12)}" for _ in range(rng.randrange(2, 6))] for _ in range(25)]
    texts = [" ".join(rng.choice(base) + [f"u{rng.randrange(200)}"] + rng.choice(base)) + "; " for _ in range(600)]
    df = docs(spark, texts)
    for longest, least, percent, most in ((3, 4, 50, 2000), (5, 5, 60, 30), (2, 3, 50, 10)):
        got = collocations(df, longest, least, percent, most).collect()
        assert {tuple(r) for r in got} == brute_force(texts_of(df), longest, least, percent, most)


def test_odd_texts_nulls_repeats_and_clashing_columns(spark):
    texts = odd_texts() + ["A b, a B! a b?"] * 6 + ["ÀB x:y z"] * 12
    df = docs(spark, texts).selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN lang END AS lang", "1 AS n", "2 AS Phrase", "3 AS part")
    got = collocations(df, least=6)
    assert {tuple(r) for r in got.collect()} == brute_force(texts_of(df), least=6)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark, monkeypatch):
    rows = [("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12 + 1), ("en", "a b", 2, 10**12), ("en", None, 0, 10**14)]
    made = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *args: made)
    got = collocations(docs(spark, ["a"])).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 10**12, 3 * 10**12, 10**12 + 1, 10**14, 10**30 // (3 * 10**12 * (10**12 + 1)))]


def test_empty_table_and_no_words(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(docs(spark, [None, "", " . , "])).collect() == []
