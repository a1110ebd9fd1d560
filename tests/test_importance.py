"""Permutation importance on held-out rows against a brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rowgauge.operators import classifier, sampling


@pytest.fixture(scope="module")
def rows(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(97)).cast("double")
    y = (F.col("id") % 3 == 0).cast("int")
    return spark.range(400).select(
        "id",
        F.when(F.col("id") % 17 == 0, 1 - y).otherwise(y).cast("double").alias("tells.much"),
        F.when(F.col("id") % 4 == 0, F.lit("none")).when(y == 1, "yes").otherwise("no").alias("text"),
        F.when(F.col("id") % 5 != 0, noise).alias("noise"),
        y.alias("ground_truth"),
    )


@pytest.fixture(scope="module")
def model(rows):
    return classifier.train_random_forest(rows.filter("id < 300"), num_trees=10, max_depth=5, exclude=["id"])


def test_equals_brute_force(spark, rows, model):
    held_out = rows.filter("id >= 300")
    found = {r.feature: r for r in classifier.permutation_importance(model, held_out, "id", seed=5).collect()}
    order = sampling.numbered(held_out.select("id"), "id", 5, "place").toPandas().set_index("place").sort_index()["id"]
    table = held_out.toPandas().set_index("id").loc[order.to_numpy()]
    right = np.mean([r.prediction == r.ground_truth for r in model.predict(held_out).collect()])
    want = {}
    for name in ("tells.much", "text", "noise"):
        step = 1 + spark.range(1).select(F.pmod(F.xxhash64(F.lit(name), F.lit(5)), F.lit(len(table) - 1))).first()[0]
        moved = table.copy()
        moved[name] = np.roll(table[name].to_numpy(), step)
        moved = spark.createDataFrame(
            [(int(i), *[None if v != v else v for v in r]) for i, r in zip(moved.index, moved.to_numpy(dtype=object))],
            held_out.schema,
        )
        want[name] = np.mean([r.prediction == r.ground_truth for r in model.predict(moved).collect()])
    assert {k: r.permuted_accuracy for k, r in found.items()} == pytest.approx(want)
    assert all(r.samples == 100 and r.accuracy == pytest.approx(right) for r in found.values())
    ranked = sorted(found, key=lambda k: -found[k].importance)
    assert ranked[-1] == "noise" and found[ranked[0]].importance > 0.1
    again = classifier.permutation_importance(model, held_out.repartition(7), "id", seed=5)
    assert {r.feature: r for r in again.collect()} == found


def test_few_rows_and_no_rows(rows, model):
    def measures(df):
        return [(r.samples, r.accuracy, r.importance) for r in classifier.permutation_importance(model, df, "id").collect()]

    assert [(n, i) for n, _, i in measures(rows.limit(1))] == [(1, 0.0)] * 3
    assert measures(rows.limit(0)) == [(0, None, None)] * 3
    assert measures(rows.withColumn("ground_truth", F.lit(None).cast("int"))) == [(0, None, None)] * 3
    assert {n for n, _, _ in measures(rows.withColumn("id", F.lit(None).cast("bigint")).limit(50))} == {50}


def test_vector_columns_are_refused(spark, model):
    frame = spark.createDataFrame([(1, 1.0, "a", Vectors.dense(1.0), 1)], ["id", "tells.much", "text", "noise", "ground_truth"])
    with pytest.raises(ValueError):
        classifier.permutation_importance(model, frame, "id")
