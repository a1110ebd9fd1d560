from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgauge.llm.mixing import TOPICS, draw, mixed, n_words, rake, sample_mixture, topic_of
from rowgauge.llm.queries import MIXTURE, QUERIES

from .helpers import SCHEMA, SF, docs, odd_texts


def brute_force(cells, targets, rounds=50):
    """Weights of cells {(values): tokens} raked in numpy; '*' takes the values without a target."""
    keys, margins = list(cells), list(targets)
    kinds = [[k[m] if k[m] in targets[name] else "*" for k in keys] for m, name in enumerate(margins)]
    tokens = np.array([cells[k] for k in keys], dtype=float)
    weights = np.ones(len(keys))
    for _ in range(rounds):
        for kind, name in zip(kinds, margins):
            present = {v for v, t in zip(kind, tokens) if t > 0}
            whole = sum(targets[name].get(v, 0.0) for v in present)
            total = (tokens * weights).sum()
            factor = {
                v: targets[name].get(v, 0.0) / whole / ((tokens * weights)[[x == v for x in kind]].sum() / total)
                for v in present
            }
            weights = weights * np.array([factor.get(v, 1.0) for v in kind])
    return dict(zip(keys, weights))


def test_registered_query_equals_brute_force(spark):
    rows = QUERIES["op2_mix_to_targets"](spark, SF).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    cells = rows.groupby(["source", "lang", "topic"]).n_tokens.sum().to_dict()
    want = brute_force(cells, MIXTURE)
    found = rows.groupby(["source", "lang", "topic"]).weight.first().to_dict()
    ratio = np.array([found[k] / want[k] for k in want])
    assert ratio.max() / ratio.min() == pytest.approx(1, abs=1e-4)
    assert (rows.n_tokens * rows.probability).sum() == pytest.approx(rows.n_tokens.sum() / 2, rel=1e-4)
    draw_shares(rows, MIXTURE, 0.5)


def draw_shares(rows, targets, fraction):
    """Check the draw's shares: a value has its goal, or all of its tokens are taken."""
    expected, total = rows.n_tokens * rows.probability, rows.n_tokens.sum() * fraction
    for name, shares in targets.items():
        kinds = rows[name].where(rows[name].isin([v for v in shares if v != "*"]), "*")
        there, have = rows.n_tokens.groupby(kinds).sum(), expected.groupby(kinds).sum()
        open_ = {v: shares.get(v, 0.0) for v in there.index if there[v] > 0}
        goals, left = {}, total
        while open_:
            whole = sum(open_.values())
            short = [v for v, s in open_.items() if left * s / whole >= there[v]]
            goals |= {v: there[v] for v in short} if short else {v: left * s / whole for v, s in open_.items()}
            left -= sum(there[v] for v in short)
            open_ = {v: s for v, s in open_.items() if v not in short} if short else {}
        for v, goal in goals.items():
            assert have[v] == pytest.approx(goal, abs=total * 1e-4)


def test_margins_are_met(spark):
    df = spark.range(4000).select(
        F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("a"),
        F.concat(F.lit("l"), F.col("id") % 4).alias("b"), (F.col("id") % 5 + 1).alias("t"),
    )
    targets = {"a": {"s0": 0.1, "s1": 0.3, "*": 0.6}, "b": {"l0": 0.4, "l1": 0.3, "l2": 0.2, "l3": 0.1}}
    margins = {"a": F.col("a"), "b": F.col("b")}
    mixture = rake(df, margins, F.col("t"), targets, fraction=0.2)
    assert mixture.gap < 1e-6
    weighed = df.withColumn("w", F.col("t") * mixture.weight(margins)).toPandas()
    total = weighed.w.sum()
    for value, share in targets["b"].items():
        assert weighed.w[weighed.b == value].sum() / total == pytest.approx(share, abs=1e-5)
    assert weighed.w[weighed.a == "s1"].sum() / total == pytest.approx(0.3, abs=1e-5)


def test_the_draw_follows_its_probabilities(spark):
    df = docs(spark, [f"a b c {k}" for k in range(3000)])
    rows = mixed(df, {"source": {"src0": 0.6, "*": 0.4}, "lang": {"*": 1.0}, "topic": {"*": 1.0}}, fraction=0.3).toPandas()
    taken = rows.groupby("source").kept.mean()
    expected = rows.groupby("source").probability.mean()
    assert taken["src0"] == pytest.approx(expected["src0"], abs=0.05)
    assert taken["src1"] == pytest.approx(expected["src1"], abs=0.05)
    again = mixed(df.repartition(7), {"source": {"src0": 0.6, "*": 0.4}, "lang": {"*": 1.0}, "topic": {"*": 1.0}}, fraction=0.3)
    assert set(rows.doc_id[rows.kept]) == {r.doc_id for r in again.where("kept").collect()}


def test_nulls_repeats_and_clashing_columns(spark):
    df = docs(spark, odd_texts() + ["x y", "x y"], [None, 1, 2, 3, 4, 5, 6, 7, 8, 8])
    df = df.withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.col("lang")))
    df = df.withColumn("source", F.when(F.col("doc_id") == 4, None).otherwise(F.col("source")))
    targets = {"source": {"src0": 0.5, "*": 0.5}, "lang": {"*": 1.0}, "topic": {"*": 1.0}}
    rows = mixed(df.selectExpr("*", "1 AS tokens", "2 AS topic", "3 AS weight", "4 AS kept"), targets).collect()
    assert len(rows) == 10 and all(0 <= r.probability <= 1 for r in rows)
    assert len({(r.probability, r.kept) for r in rows if r.doc_id == 8}) == 1
    assert sample_mixture(df, targets).columns == df.columns


def test_empty_table_and_no_tokens(spark):
    assert mixed(spark.createDataFrame([], SCHEMA), MIXTURE).collect() == []
    assert [r.kept for r in mixed(docs(spark, ["", None]), MIXTURE).collect()] == [False, False]


def test_words_and_topics(spark):
    rows = [(None, 0, "prose"), ("", 0, "prose"), ("  a\tb\n", 2, "prose"), ("MIT License", 2, "legal"), ("mail x@y.org now", 3, "contact"), ("a | b | c", 5, "table")]
    df = spark.createDataFrame(rows, "t string, n long, topic string")
    assert [tuple(r) for r in df.select(n_words(F.col("t")), topic_of(F.col("t"))).collect()] == [r[1:] for r in rows]


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9])
def test_the_draw_meets_the_targets(spark, fraction):
    """Of source `rare` there is too little for its target in a draw of half."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 25 == 0, "rare").otherwise("often").alias("a"),
        F.concat(F.lit("l"), F.when(F.col("id") % 7 < 4, 0).otherwise(F.col("id") % 3)).alias("b"), F.lit(10).alias("t"), "id",
    )
    targets = {"a": {"rare": 0.15, "*": 0.85}, "b": {"l0": 0.4, "l1": 0.3, "l2": 0.3}}
    margins = {"a": F.col("a"), "b": F.col("b")}
    mixture = rake(df, margins, F.col("t"), targets, fraction)
    rows = df.select("a", "b", mixture.probability(margins).alias("p"), (draw(F.col("id"), 42) < mixture.probability(margins)).alias("kept")).toPandas()
    rare = min(0.15, 0.04 / fraction)
    assert mixture.fraction == pytest.approx(rows.p.mean()) == pytest.approx(fraction, rel=1e-4)
    assert (rows.p <= 1).all()
    assert mixture.shortfall["a"]["rare"] == pytest.approx(0.15 - rare, abs=1e-4)
    draw_shares(rows.assign(n_tokens=10, probability=rows.p), targets, fraction)
    for name, shares in mixture.shares.items():
        for value, share in shares.items():
            held = rows[name] == value if value != "*" else rows[name] == "often"
            assert rows.p[held].sum() / rows.p.sum() == pytest.approx(share, abs=1e-4)
            assert (rows.kept & held).sum() / rows.kept.sum() == pytest.approx(share, abs=0.03)


@pytest.mark.parametrize("rare", [0, 1, 10])
def test_a_value_of_few_documents_changes_the_draw_by_them_only(spark, rare):
    texts = [f"some prose number {k} of many words" for k in range(3000)]
    texts += [f"write to mail{k}@example.org or not" for k in range(rare)]
    df = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    targets = {"source": {"src0": 0.3, "*": 0.7}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.95, "contact": 0.05}}
    rows = mixed(df, targets, fraction=0.4).toPandas()
    draw_shares(rows, targets, 0.4)
    assert (rows.n_tokens * rows.probability).sum() == pytest.approx(0.4 * rows.n_tokens.sum(), rel=1e-4)
    assert rows.kept.mean() == pytest.approx(0.4, abs=0.04)
    assert rows.probability[rows.topic == "contact"].min() == 1 if rare else True


def test_targets_that_no_draw_can_meet(spark):
    """One source has one language only, the other another."""
    df = docs(spark, ["a b c"] * 300).withColumn("source", F.when(F.col("doc_id") < 30, "src0").otherwise("src1"))
    df = df.withColumn("lang", F.when(F.col("doc_id") < 30, "en").otherwise("de"))
    targets = {"source": {"src0": 0.5, "*": 0.5}, "lang": {"en": 0.1, "de": 0.9}, "topic": {"*": 1.0}}
    rows = mixed(df, targets, fraction=0.5).toPandas()
    assert rows.probability.between(0, 1).all() and rows.kept.sum() > 75


def test_topics_need_what_is_looked_for_first(spark):
    """The quick tests before the patterns rule out no match."""
    texts = ["LICENSE", "x licence", "relicense", "CopyRight 1", "lIcEnCe", "a@b.c", "@b.c", "a@b", "+@b-c.d e", "x | y z | ", "x |y | z", "\u212aopy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = None
    for name, pattern in reversed(TOPICS):
        found = F.when(F.col("t").rlike(pattern), name).otherwise(F.lit("prose") if found is None else found)
    assert all(a == b for a, b in df.select(topic_of(F.col("t")), found).collect())
