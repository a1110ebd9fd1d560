from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgauge.llm import quality
from rowgauge.llm.quality import FEATURES, document_features, fit_logistic, fit_quality, judged, keep_good, text_features
from rowgauge.llm.queries import QUERIES

from .helpers import SCHEMA, SF, docs, odd_texts, prose

MEDIUM = "/root/testdata/sf0.01"


def test_registered_query_judges_every_document(spark):
    got = QUERIES["op10_site_quality"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.posterior.between(0, 1).all() and (got.kept == (got.posterior >= 0.5)).all()


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    known = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = judged(documents, labels.where(known)).join(labels.where(~known), "doc_id").toPandas()
    bad, good = got[got.quality == 0], got[got.quality == 1]
    assert len(bad) > 15 and (~bad.kept).mean() >= 0.85
    assert good.kept.mean() >= 0.98


def test_posterior_equals_brute_force(spark):
    """Sites, shrinkage and Bayes' rule again in numpy, from the fitted weights."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    features = document_features(documents)
    model = fit_quality(features, labels)
    x = features.toPandas()
    log_odds = np.clip(np.stack(x.features) @ np.array(model.weights[:-1]) + model.weights[-1] - model.base_log_odds, -30, 30)
    x["p"] = 1 / (1 + np.exp(-(log_odds + model.base_log_odds)))
    x["evidence"] = log_odds

    def strength(groups, mean):
        many = groups[groups.n > 1]
        m = many[mean]
        spread = (many.n * (many.total / many.n - m) ** 2).sum()
        within = ((many.squares - many.total**2 / many.n) / (many.n - 1)).sum()
        whole = max((many.n * m * (1 - m)).sum() / many.n.sum(), 1e-9)
        between = max(0.0, (spread - within) / many.n.sum())
        return min(1e6, max(1.0, whole / max(between, 1e-9) - 1))

    def sums(keys):
        g = x.groupby(keys).p
        return g.agg(total="sum", squares=lambda p: (p * p).sum(), n="count").reset_index()

    whole = x.p.mean()
    hosts = sums(["source"]).assign(mean=whole)
    pull = strength(hosts, "mean")
    hosts["host"] = (hosts.total + pull * whole) / (hosts.n + pull)
    paths = sums(["source", "lang"]).merge(hosts[["source", "host"]], on="source")
    pull = strength(paths, "host")
    x = x.merge(paths[["source", "lang", "total", "n", "host"]], on=["source", "lang"])
    prior = (pull * x.host + np.maximum(0, x.total - x.p)) / (pull + np.maximum(0, x.n - 1))
    held = np.clip(prior, 1e-6, 1 - 1e-6)
    x["want"] = 1 / (1 + np.exp(-(x.evidence + np.log(held / (1 - held)))))
    got = judged(documents, labels).toPandas()
    both = got.merge(x[["doc_id", "want"]], on="doc_id")
    assert len(both) == len(got) and np.allclose(both.posterior, both.want, atol=1e-6)


def test_sparse_sites_are_drawn_to_the_whole_and_hot_ones_are_not(spark):
    junk = "### $$$ | " * 30
    texts = [junk if k % 2 else prose(k) for k in range(60)] + [prose(k) for k in range(60, 300)]
    df = docs(spark, texts).withColumn(
        "source", F.when(F.col("doc_id") < 60, "bad").when(F.col("doc_id") == 299, "new").otherwise("good")
    )
    labels = spark.createDataFrame([(k, 0 if k < 60 and k % 2 else 1) for k in range(0, 300, 3)], "doc_id long, quality int")
    sites = {r.source: r.q for r in judged(df, labels).groupBy("source").agg(F.avg("site_quality").alias("q")).collect()}
    assert sites["bad"] < 0.65 < 0.85 < sites["new"] < sites["good"]


def test_odd_texts_nulls_repeats_and_clashing_columns(spark):
    df = docs(spark, odd_texts() + [prose(1), prose(1), "| ### " * 50], [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9])
    df = df.withColumn("source", F.when(F.col("doc_id") > 4, F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(8, 1), (9, 0), (4, 1), (9, None), (77, 1), (None, 0)], "doc_id long, quality int")
    clash = df.selectExpr("*", "1 AS features", "2 AS posterior", "3 AS evidence", "4 AS host", "5 AS total")
    got = judged(clash, labels).collect()
    assert len(got) == 11 and all(0 <= r.posterior <= 1 for r in got)
    kept = keep_good(clash, labels)
    assert kept.columns == clash.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert "9" not in {str(r.doc_id) for r in kept.collect()}


def test_no_labels_and_empty_tables(spark):
    df, labels = docs(spark, [prose(1), None]), spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert [r.kept for r in judged(df, labels).collect()] == [True, True]
    assert keep_good(df, labels.limit(0)).count() == 2
    assert judged(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_logistic_regression_finds_known_weights():
    rng = np.random.default_rng(0)
    x = rng.random((20_000, 2))
    y = rng.random(20_000) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] + 0.5)))
    assert fit_logistic(x, y.astype(float), ridge=1e-6) == pytest.approx([3, -2, 0.5], abs=0.2)


def test_features_are_of_the_whole_text():
    assert text_features(None)[11] == text_features(" \n")[11] == 1
    assert len(text_features("a")) == FEATURES
    late = text_features(prose(1, 5000) + " ###" * 100)
    assert late[3] > text_features(prose(1, 5000))[3]


def test_both_ways_to_drop_the_rejected_agree(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    # A third of the rows have no doc_id and one site.
    hot = F.col("doc_id") % 3 == 0
    docs = docs.withColumn("source", F.when(hot, "hot").otherwise(F.col("source")))
    docs = docs.withColumn("doc_id", F.when(~hot, F.col("doc_id")))
    near = keep_good(docs, labels)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    far = keep_good(docs, labels)
    assert 0 < near.count() < docs.count()
    assert near.exceptAll(far).isEmpty() and far.exceptAll(near).isEmpty()
