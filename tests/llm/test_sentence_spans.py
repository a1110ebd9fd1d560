from __future__ import annotations

import random

import pytest

from rowgauge.llm.queries import QUERIES
from rowgauge.llm.sentence_spans import RUN_WORDS, remove_repeats, runs, sentences

from .helpers import SCHEMA, SF, docs, odd_texts, prose


def normal(text):
    return [b" ".join(text[a:b].lower().split()) for a, b in sentences(text)]


def brute_force(rows, least=RUN_WORDS):
    """{doc_id: (removed sentence numbers, documents of first occurrences)} by all runs in order.

    The shortest run from every sentence on and the shortest up to every sentence cover whatever any
    repeated run does: what neither end's run reaches has a run of its own before the end.
    """
    seen, out = {}, {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        own = normal((text or "").encode())
        words = [len(s.split()) for s in own]

        def fits(first, last):
            return sum(words[first : last + 1]) >= (least if last > first else 2 * least)

        places = set()
        for k in range(len(own)):
            places.add(next(((k, b) for b in range(k, len(own)) if fits(k, b)), None))
            places.add(next(((a, k) for a in range(k, -1, -1) if fits(a, k)), None))
        for first, last in sorted(places - {None}):
            run = tuple(own[first : last + 1])
            at = seen.setdefault(run, (doc_id, first))
            if at != (doc_id, first):
                gone, firsts = out.setdefault(doc_id, (set(), set()))
                gone.update(range(first, last + 1))
                firsts.add(at[0])
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, texts = brute_force(rows), dict(rows)
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert set(got) == set(want)
    for doc_id, (gone, firsts) in want.items():
        r, own = got[doc_id], normal(texts[doc_id].encode())
        assert r.first_doc_ids == sorted(firsts) and r.n_removed == len(gone) and r.n_sentences == len(own)
        left = [s for k, s in enumerate(own) if k not in gone]
        assert b" ".join(r.text.encode().lower().split()) == b" ".join(left)


def test_registered_query_equals_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert QUERIES["op7_sentence_spans"](spark, SF).columns == ["doc_id", "first_doc_ids", "n_sentences", "n_removed", "text"]


def test_passages_within_and_across_documents(spark):
    passage = prose(50, 60)
    texts = [
        f"{prose(1)} {passage} {prose(2)}", f"{prose(3)}\n{passage.upper()}\n{prose(4)}", prose(5), passage,
        f"{prose(6)} {passage} {prose(7)} {passage}", prose(5), "Short one. Short two.", "Short one. Short two.",
        f"{prose(8)}\n{' '.join(prose(9, 40).replace('.', '').split())}.", f"{prose(10)}\n{prose(9, 40).replace('.', '')}.",
    ]
    check(docs(spark, texts))
    got = {r.doc_id for r in remove_repeats(docs(spark, texts)).collect()}
    assert got == {1, 3, 4, 5, 9}


def test_a_passage_in_many_documents(spark):
    passage = prose(60, 55)
    df = docs(spark, [f"{prose(100 + k, 40)}\n{passage}" for k in range(300)])
    got = remove_repeats(df).collect()
    assert len(got) == 299 and all(r.first_doc_ids == [0] for r in got)


def test_odd_texts_null_and_repeated_ids_and_clashing_columns(spark):
    check(docs(spark, odd_texts() + odd_texts()))
    text = prose(70)
    df = docs(spark, [text, text, text, text], [None, 4, 4, 6]).selectExpr("*", "1 AS spans", "2 AS n_removed", "3 AS first")
    got = remove_repeats(df).collect()
    assert [r.doc_id for r in got] == [6] and got[0].n_removed == 2 and got[0].n_removed_ == 12


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("text,want", [
    (b"", []), (b" \n ", []), (b"no end", [b"no end"]), (b'A b. C d! "E f?" G\nH', [b"A b.", b"C d!", b'"E f?"', b"G", b"H"]),
    (b"3.5 is a number. Yes", [b"3.5 is a number.", b"Yes"]),
])
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


def test_runs_of_nothing():
    assert runs([], 15) == [] and runs([3], 15) == [] and runs([30], 15) == [(0, 0)] and runs([14, 1], 15) == [(0, 1)]


def by_the_rule(rows, least=RUN_WORDS):
    """{row number: removed sentence numbers}: every repeated run, however long, by (doc_id, text) and place."""
    first, places = {}, []
    for k, (doc_id, text) in sorted(enumerate(rows), key=lambda r: r[1]):
        own = normal(text.encode())
        for a in range(len(own)):
            for b in range(a, len(own)):
                n = sum(len(s.split()) for s in own[a : b + 1])
                if b > a and n >= least or n >= 2 * least:
                    run = tuple(own[a : b + 1])
                    first.setdefault(run, (doc_id, text, a))
                    places.append((k, doc_id, text, a, b, run))
    gone = {}
    for k, doc_id, text, a, b, run in places:
        if first[run] != (doc_id, text, a):
            gone.setdefault(k, set()).update(range(a, b + 1))
    return gone


def spans(seed, *sizes):
    """One sentence of made-up words for every size."""
    return " ".join(prose(seed * 100 + k, n).replace(".", "") + "." for k, n in enumerate(sizes))


@pytest.mark.parametrize("sizes", [(35, 25), (10, 10, 3), (35, 10, 3), (8, 6, 8), (1, 1, 40, 1, 1), (3, 14, 2, 2)])
def test_the_whole_of_a_passage_goes(spark, sizes):
    passage = spans(7, *sizes)
    texts = [f"{prose(1)}\n{passage}\n{prose(2)}", f"{prose(3)}\n{passage}\n{prose(4)}"]
    (r,) = remove_repeats(docs(spark, texts)).collect()
    assert (r.doc_id, r.n_removed, r.text.split()) == (1, len(sizes), f"{prose(3)} {prose(4)}".split())


def test_every_repeated_run_goes_and_nothing_else(spark):
    rng = random.Random(3)
    known = [spans(k, n) for k, n in enumerate([1, 2, 3, 5, 8, 9, 14, 15, 16, 29, 30, 31, 40])]
    texts = [" ".join(rng.choice(known) if rng.random() < 0.7 else spans(500 + 20 * k + j, rng.randrange(1, 20)) for j in range(8)) for k in range(40)]
    want = by_the_rule(list(enumerate(texts)))
    got = {r.doc_id: r for r in remove_repeats(docs(spark, texts)).collect()}
    assert set(got) == set(want) and len(want) > 10
    for k, gone in want.items():
        own = normal(texts[k].encode())
        assert got[k].text.lower().encode().split() == b" ".join(s for j, s in enumerate(own) if j not in gone).split()


def test_given_documents_by_the_rule(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
    assert got == {rows[k][0]: len(gone) for k, gone in by_the_rule(rows).items()}


def test_one_doc_id_on_different_texts(spark):
    passage = spans(8, 12, 12, 12)
    rows = [
        (4, f"{prose(1)}\n{passage}"), (4, "Short. Text."), (4, f"{passage}\n{prose(2)}"), (4, f"{passage}\n{prose(3)}"),
        (4, f"{prose(1)}\n{passage}"), (5, prose(4)), (5, f"{passage}\n{prose(5)}"),
    ]
    got = remove_repeats(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    # The first of the three texts of document 4 with the passage keeps it, with its copy if it has one.
    assert sorted(r.doc_id for r in got) in ([4, 4, 5], [4, 4, 4, 5])
    assert {r.n_removed for r in got} == {3} and all(r.first_doc_ids == [4] for r in got)
    texts = {" ".join(t.split()) for _, t in rows}
    assert all(f"{r.text.strip()} {passage}" in texts or f"{passage} {r.text.strip()}" in texts for r in got)
