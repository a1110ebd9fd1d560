from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowgauge.operators import classifier, evaluate, labels, sampling, vectors

DIMS = "completeness int, consistency int, validity int, accuracy int, final_label int"


@pytest.fixture(scope="module")
def good(spark):
    return spark.createDataFrame(
        [(1, 1, 1, 1, 0, 1), (2, 0, 0, 1, 1, 0), (3, 1, 1, 1, 1, 1)], f"id int, {DIMS}"
    )


def checks(frame):
    return {r.check: (r.status, r.violations) for r in frame.collect()}


def test_good_labels_pass(good):
    assert {s for s, _ in checks(labels.verify_labels(good, "id", 3)).values()} == {"pass"}
    assert labels.label_violations(good).isEmpty()


def test_bad_labels_are_all_reported(spark):
    bad = spark.createDataFrame(
        [(1, 1, 1, 1, 0, 0), (2, None, 0, 1, 1, 0), (3, 2, 1, 1, 1, 1)], f"id int, {DIMS}"
    )
    found = checks(labels.verify_labels(bad, "id", 5))
    assert found["row_count"] == ("fail", 2)
    assert found["no_nulls:completeness"] == ("fail", 1)
    assert found["zero_or_one:completeness"] == ("fail", 1)
    assert found["label_rule"] == ("fail", 1)
    assert sorted(r.id for r in labels.label_violations(bad).collect()) == [1, 2, 3]


def test_missing_column_skips_its_checks(good):
    found = checks(labels.verify_labels(good.drop("validity"), "id"))
    assert found["required_columns"] == ("fail", 1)
    assert found["no_nulls:validity"] == ("skipped", None)
    assert found["label_rule"] == ("skipped", None)


def test_join_repeats_rows_and_renames(spark):
    raw = spark.createDataFrame([(1, "a"), (2, "b")], "id int, note string")
    marks = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id int, note string")
    found = labels.label_join(raw, marks, "id")
    assert found.columns == ["id", "note_x", "note_y"]
    assert sorted(map(tuple, found.collect())) == [(1, "a", "x"), (1, "a", "y")]


def test_single_class(spark):
    ones = spark.createDataFrame([(1, 1, 0.9), (1, 1, 0.8)], "t int, p int, s double")
    (row,) = evaluate.evaluate(ones, "t", "p", "s").collect()
    assert (row.tn, row.fp, row.fn, row.tp) == (0, 0, 0, 2)
    assert (row.precision, row.recall, row.auc_roc) == (1.0, 1.0, 0.0)
    zeros = ones.select(F.lit(0).alias("t"), F.lit(0).alias("p"), "s")
    (row,) = evaluate.evaluate(zeros, "t", "p", "s").collect()
    assert (row.precision, row.recall, row.f1_score, row.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_weighted_metrics_of_three_classes(spark):
    frame = spark.createDataFrame(
        [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2)], "t int, p int"
    )
    (row,) = evaluate.weighted_metrics(frame, "t", "p").collect()
    assert row.samples == 6
    assert row.weighted_recall == pytest.approx(4 / 6)
    assert row.weighted_precision == pytest.approx((1 / 2 + 2 / 3 + 1) / 3)


def test_gate(spark):
    frame = spark.createDataFrame([(0.8, 0.75, 0.77), (0.79, 1.0, 1.0)], "p double, r double, f double")
    found = [r.accepted for r in evaluate.acceptance_gate(frame, "p", "r", "f").collect()]
    assert found == [True, False]


def test_exact_size_sample(spark):
    frame = spark.range(500).select("id", (F.col("id") % 7).alias("g"))
    sample = sampling.stratified_sample(frame, "g", "id", 100)
    assert sample.count() == sample.distinct().count() < 100
    redrawn = sampling.exact_size_sample(frame, "g", "id", 100)
    assert redrawn.count() == 100
    assert redrawn.columns == frame.columns
    assert redrawn.distinct().exceptAll(sample).isEmpty()


def test_every_stratum_is_sampled_and_null_is_none(spark):
    frame = spark.range(1000).select(
        "id", F.when(F.col("id") == 0, "rare").when(F.col("id") > 10, "usual").alias("g")
    )
    found = sampling.stratified_sample(frame, "g", "id", 50).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in found} == {"rare": 1, "usual": 49}


def test_folds_and_split(spark):
    frame = spark.range(1003)
    sizes = [
        r["count"]
        for r in sampling.assign_folds(frame, "id", exact=True).groupBy("fold_id").count().collect()
    ]
    assert sorted(sizes) == [200, 200, 201, 201, 201]
    train, test = sampling.train_test_split(frame, "id")
    assert train.count() + test.count() == 1003
    assert 750 < train.count() < 850
    again, _ = sampling.train_test_split(frame.repartition(11), "id")
    assert again.exceptAll(train).isEmpty()


def test_vectors(spark):
    frame = spark.createDataFrame([(3.0, 4.0, 5.0), (0.0, 0.0, 5.0)], "a double, `b.c` double, k double")
    found = vectors.normalize_features(frame, ["a", "b.c"]).collect()
    assert [list(r.normalized_features) for r in found] == [[0.6, 0.8], [0.0, 0.0]]
    scaled = vectors.standardize_features(frame, ["a", "k"]).collect()
    assert [r.standardized_features[1] for r in scaled] == [0.0, 0.0]
    assert scaled[0].standardized_features[0] == pytest.approx(2**-0.5)


@pytest.fixture(scope="module")
def records(spark):
    frame = spark.range(600).select(
        F.col("id").alias("key"),
        (F.col("id") % 17).alias("a"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 13).cast("string")).alias("b.text"),
        F.lit("word").alias("c"),
    )
    return frame.withColumn("ground_truth", (F.col("a") > 8).cast("int"))


def test_classifier(records):
    train, test = sampling.train_test_split(records, "key")
    model = classifier.train_random_forest(
        train, num_trees=5, max_depth=4, exclude=["key"]
    )
    assert model.features == ["a", "b.text", "c"]
    report = model.evaluate(test).first()
    assert report.samples == test.count()
    assert report.weighted_f1 > 0.95 and report.auc_roc > 0.95 and report.accepted
    importance = model.importance()
    assert importance.first().feature == "a"
    again = classifier.train_random_forest(train, num_trees=5, max_depth=4, exclude=["key"])
    assert again.predict(test).exceptAll(model.predict(test)).isEmpty()


def test_cross_validation_reports_spread(records):
    found = classifier.cross_validate(records, "key", folds=3, num_trees=3, max_depth=3)
    rows = {r.metric: r for r in found.collect()}
    assert set(rows) == {"f1_score", "precision", "recall", "auc_roc"}
    assert all(r.folds == 3 and 0.8 < r["mean"] <= 1 and r["stddev"] >= 0 for r in rows.values())


def test_nan_rows_are_skipped(spark):
    frame = spark.createDataFrame(
        [(1.0, 1), (float("nan"), 0), (None, 0), (2.0, 1)], "x double, ground_truth int"
    )
    prepared, names = classifier.prepare_features(frame)
    assert names == ["x"]
    assert sorted(r.features[0] for r in prepared.collect()) == [0.0, 1.0, 2.0]


def test_correlation(spark):
    frame = spark.range(100).select(
        F.col("id").alias("a"), F.lit(1).alias("flat"), F.lit("x").alias("text"),
        (F.col("id") >= 50).cast("int").alias("y"),
    )
    found = {r.feature: r for r in labels.correlation_importance(frame, "y").collect()}
    assert set(found) == {"a", "flat"}
    assert found["flat"].correlation is None and found["flat"].importance == 0.0
    assert found["a"].importance == pytest.approx(0.866156, abs=1e-4)
    assert labels.feature_kinds(frame, "y") == {
        "n_total_features": 3, "n_numeric": 2, "n_categorical": 1
    }


def test_association_of_text_and_numbers(spark):
    frame = spark.range(120).select(
        (F.col("id") % 7).alias("noise"), F.concat(F.lit("g"), F.col("id") % 4).alias("the.group"),
        F.concat(F.lit("u"), F.col("id") % 3).alias("other"), F.lit("x").alias("flat"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") < 116, (F.col("id") % 4 < 2).cast("int")).alias("y"),
    )
    found = {r.feature: r for r in labels.association_importance(frame, "y").collect()}
    assert found["the.group"].association == 1 and found["the.group"].kind == "text"
    assert found["other"].association < 0.1 and found["noise"].kind == "numeric"
    assert found["flat"].association == 0 and found["none"].association is None and found["none"].importance == 0
    # For two classes, Cramer's V.
    table = frame.where("y IS NOT NULL").toPandas()
    counts = table.groupby(["other", "y"]).size().unstack().to_numpy()
    expected = counts.sum(1, keepdims=True) * counts.sum(0) / counts.sum()
    assert found["other"].association == pytest.approx((((counts - expected) ** 2 / expected).sum() / counts.sum()) ** 0.5, abs=2e-6)
    with pytest.raises(ValueError, match="no numeric or text"):
        labels.association_importance(frame.select("y"), "y")


def test_text_in_a_label_file_is_a_violation(spark):
    rows = [("1", "1", "1", "1", "0", "1"), ("2", "yes", "1", "1", "1", "1"), ("3", "1", None, "1", "1", "maybe")]
    texts = spark.createDataFrame(rows, ["id", *(part.split()[0] for part in DIMS.split(", "))])
    found = checks(labels.verify_labels(texts, "id", 3))
    assert found["zero_or_one:completeness"] == ("fail", 1)
    assert found["no_nulls:consistency"] == ("fail", 1)
    assert found["zero_or_one:final_label"] == ("fail", 1)
    assert sorted(r.id for r in labels.label_violations(texts).collect()) == ["2", "3"]
    assert labels.dimension_pass_rates(texts).filter("dimension = 'completeness'").first().passed == 2


def test_every_row_is_predicted_and_names_may_have_dots(spark):
    rows = [(float(i % 10), i, i % 10 > 4) for i in range(200)] + [(float("nan"), 1000, True), (None, 1001, False)]
    frame = spark.createDataFrame(rows, "`x.y` double, key int, good boolean").selectExpr(
        "`x.y`", "key", "cast(good AS int) AS `the.label`"
    )
    model = classifier.train_random_forest(frame, "the.label", num_trees=3, max_depth=3, exclude=["key"])
    assert model.predict(frame).count() == 202
    assert model.evaluate(frame).first().samples == 202
