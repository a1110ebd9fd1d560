from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowgauge.operators import classifier, encode


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("few"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("name "), F.pmod(F.xxhash64("id"), F.lit(400)))).otherwise("hot").alias("the.name"),
        (F.col("id") % 90).cast("string").alias("number"),
        (F.pmod(F.xxhash64("id"), F.lit(400)) < 200).cast("int").alias("y"),
    )


def test_few_values_have_codes_by_number_of_rows(spark):
    df = spark.createDataFrame([("b",), ("b",), ("c",), ("a",), ("",), (None,)], "x string")
    text = encode.fit_text(df, ["x"])
    assert text.codes == {"x": {"b": 1.0, "": 2.0, "a": 3.0, "c": 4.0}} and not text.means
    new = spark.createDataFrame([("c",), ("unseen",), (None,)], "x string")
    assert [r.x for r in text.apply(new).collect()] == [4.0, 0.0, 0.0]


def test_numbers_as_text_stay_numbers(rows):
    text = encode.fit_text(rows, ["few", "number"], few=5)
    assert set(text.codes) == {"few"} and not text.means


def test_many_values_have_means_of_other_rows(rows):
    text = encode.fit_text(rows, ["few", "the.name"], "y")
    assert list(text.means) == ["the.name"]
    table = rows.withColumn("part", encode._part(["few", "the.name"])).toPandas()
    whole = table.y.mean()
    fitted = {r.id: r["the.name"] for r in text.apply(rows, training=True).collect()}
    new = {r.id: r["the.name"] for r in text.apply(rows).collect()}
    for r in table.iloc[::97].to_dict("records"):
        same = table[table["the.name"] == r["the.name"]]
        others = same[same.part != r["part"]]
        assert fitted[r["id"]] == pytest.approx((others.y.sum() + 10 * whole) / (len(others) + 10))
        assert new[r["id"]] == pytest.approx((same.y.sum() + 10 * whole) / (len(same) + 10))


def test_a_unique_value_tells_nothing_about_its_own_row(spark):
    df = spark.range(500).select(F.concat(F.lit("u"), "id").alias("x"), (F.col("id") % 2).alias("y"))
    text = encode.fit_text(df, ["x"], "y")
    assert {r.x for r in text.apply(df, training=True).collect()} == {0.5}
    assert {r.x for r in text.apply(spark.createDataFrame([("new",), (None,)], "x string")).collect()} == {0.5}


def test_without_a_target_values_have_their_share(spark):
    df = spark.range(400).select(F.concat(F.lit("v"), F.col("id") % 100).alias("x"))
    assert {round(r.x, 9) for r in encode.fit_text(df, ["x"]).apply(df).collect()} == {0.01}


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "x string, y int")
    assert encode.fit_text(empty, ["x"], "y").apply(empty).collect() == []
    df = spark.createDataFrame([("a", 1, 2)], "x string, count int, y int")
    assert encode.fit_text(df, ["x", "count"], "y").apply(df).collect() == [(1.0, 1, 2)]


def test_forest_learns_from_text(rows):
    """Test rows take the codes and means of the training rows, so labels of their own reach no feature."""
    train, test = rows.where("id % 5 != 0"), rows.where("id % 5 = 0")
    model = classifier.train_random_forest(train, "y", num_trees=10, max_depth=5, exclude=["id"])
    assert model.importance().first().feature == "the.name"
    known = test.where("`the.name` != 'hot'")
    assert model.evaluate(known).first().weighted_f1 > 0.9
    wrong = known.withColumn("y", 1 - F.col("y"))
    assert model.predict(wrong).select("id", "score").exceptAll(model.predict(known).select("id", "score")).isEmpty()


def test_prepared_features_of_text(rows):
    prepared, names = classifier.prepare_features(rows, "y", ["id"])
    assert names == ["few", "the.name", "number"]
    first = prepared.where("id = 3").first()
    assert first.few == "g0" and first.features[0] in (1.0, 2.0, 3.0) and first.features[2] == 3.0
