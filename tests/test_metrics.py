from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from rowgauge.operators import features, metrics, profile, rows, validate
from rowgauge.plans.assess import assess


def values(frame, level="column"):
    return {r["column_name"]: r["value"] for r in frame.collect() if r["level"] == level}


def single(frame):
    (row,) = frame.collect()
    return row["value"]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "a", 1.5), (1, "a", 1.5), (2, None, None), (3, "b", None), (2, None, None)],
        "id int, `name.first` string, score double",
    )


def test_completeness(people):
    assert values(metrics.completeness_column(people)) == {
        "id": 100.0, "name.first": 60.0, "score": 40.0
    }
    assert single(metrics.completeness_dataset(people)) == pytest.approx(66.67)
    assert sorted(r["row_completeness"] for r in rows.row_completeness(people).collect()) == (
        pytest.approx([100 / 3, 100 / 3, 200 / 3, 100, 100])
    )


def test_completeness_is_the_rest_of_the_null_share(people):
    filled = values(metrics.completeness_column(people))
    nulls = {r[0]: r[1] for r in features.null_percentages(people).collect()}
    assert all(filled[c] + nulls[c] == pytest.approx(100) for c in filled)


def test_distinct_values_count_null_once(people):
    assert values(metrics.consistency_column(people)) == {
        "id": 60.0, "name.first": 60.0, "score": 40.0
    }


def test_duplicates_with_nulls(people):
    (report,) = validate.validate_duplicates(people).collect()
    assert (report.total_rows, report.distinct_rows, report.duplicate_count) == (5, 3, 2)
    assert report.exceeds_threshold and not report.is_valid
    flagged = rows.duplicate_flag(people)
    assert flagged.agg(F.sum("is_duplicate")).first()[0] == report.duplicate_count
    assert flagged.drop("is_duplicate").exceptAll(people).isEmpty()
    assert people.exceptAll(flagged.drop("is_duplicate")).isEmpty()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string, d date")
    found = metrics.as_dict(metrics.all_metrics(empty, "2024-01-01"))
    assert found["completeness"] == {"dataset": 0.0, "columns": {"a": 0.0, "b": 0.0, "d": 0.0}}
    assert found["consistency"] == {"dataset": 0.0, "columns": {"a": 0.0, "b": 0.0, "d": 0.0}}
    assert found["timeliness"]["dataset"] == 100.0
    assert all(r.is_valid for r in validate.validate_all(empty).collect())
    assert rows.row_metrics(empty).count() == 0
    (dataset,) = features.dataset_features(empty).collect()
    assert (dataset.row_count, dataset.data_density) == (0, 0.0)
    assert assess(empty).rows.count() == 0


def test_one_row_and_all_null(spark):
    one = spark.createDataFrame([(None, 7)], "a string, b int")
    assert values(metrics.completeness_column(one)) == {"a": 0.0, "b": 100.0}
    assert values(metrics.consistency_column(one)) == {"a": 100.0, "b": 100.0}
    (stats,) = features.numeric_stats(one).collect()
    assert (stats["count"], stats["mean"], stats["stddev"], stats["min"]) == (1, 7.0, None, 7.0)


def test_nan_is_no_null_and_equals_itself(spark):
    frame = spark.createDataFrame(
        [(float("nan"),), (float("nan"),), (float("inf"),), (0.0,), (-0.0,)], "x double"
    )
    assert values(metrics.completeness_column(frame)) == {"x": 100.0}
    assert values(metrics.consistency_column(frame)) == {"x": 60.0}
    assert single(metrics.consistency_dataset(frame)) == 60.0


def test_map_columns(spark):
    frame = spark.sql(
        "SELECT map('a', 1, 'b', 2) AS m, 1 AS id UNION ALL SELECT map('b', 2, 'a', 1), 1 "
        "UNION ALL SELECT NULL, 1"
    )
    assert single(metrics.consistency_dataset(frame)) == pytest.approx(66.67)
    assert values(metrics.consistency_column(frame)) == {"m": 66.67, "id": 33.33}
    flagged = rows.duplicate_flag(frame)
    assert flagged.schema["m"].dataType == frame.schema["m"].dataType
    assert sorted(r.is_duplicate for r in flagged.collect()) == [0, 0, 1]
    assert rows.drop_duplicates(frame).count() == 2


def test_nested_values_round_trip(spark):
    frame = spark.sql(
        "SELECT named_struct('m', map('k', map('x', 1)), 'l', array(map('y', 2))) AS s "
        "UNION ALL SELECT NULL UNION ALL SELECT named_struct('m', NULL, 'l', NULL)"
    )
    back = rows.drop_duplicates(frame)
    assert back.schema["s"].dataType.simpleString() == frame.schema["s"].dataType.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    assert values(metrics.consistency_column(frame)) == {"s": 100.0}


def test_timeliness_of_all_date_types(spark):
    day = datetime.datetime(2024, 3, 1, 12)
    frame = spark.createDataFrame(
        [(day.date(), day, day, "x"), (None, None, None, "y")],
        "d date, t timestamp, n timestamp_ntz, s string",
    )
    found = values(metrics.timeliness_column(frame, "2024-03-04 11:00:00"))
    # The date is three full days old, the moments at noon only two.
    assert found == {"d": 70.0, "t": 80.0, "n": 80.0, "s": 100.0}
    assert single(metrics.timeliness_dataset(frame, "2024-03-04 11:00:00")) == 76.67
    by_row = rows.row_timeliness(frame, "2024-03-04 11:00:00").collect()
    assert sorted(r.row_timeliness for r in by_row) == [70.0, 100.0]


def test_timeliness_stays_within_bounds(spark):
    frame = spark.createDataFrame([(datetime.date(2024, 1, 1),)], "d date")
    assert single(metrics.timeliness_dataset(frame, "2020-01-01")) == 100.0
    assert single(metrics.timeliness_dataset(frame, "2024-12-31")) == 0.0
    nothing = spark.createDataFrame([(None,)], "d date")
    assert single(metrics.timeliness_dataset(nothing, "2024-12-31")) == 100.0


def test_rounding_is_half_up(spark):
    # 1 of 800 rows is null: 0.125 percent.
    frame = spark.range(800).select(F.when(F.col("id") > 0, F.col("id")).alias("x"))
    (row,) = features.null_percentages(frame).collect()
    assert row["null_percentage"] == 0.13


def test_wide_table_is_scanned_once_for_distinct_values(spark):
    wide = spark.range(50).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(60)])
    found = profile.distinct_profile(wide).collect()
    assert {r.column_name: r.distinct_values for r in found} == {
        f"c{i}": min(i + 1, 50) for i in range(60)
    }


def test_report_order(people):
    report = metrics.metrics_report(metrics.all_metrics(people), people.columns).collect()
    assert [r.position for r in report] == list(range(1, 17))
    assert [(r.metric, r.column_name) for r in report[:3]] == [
        ("completeness", None), ("completeness", "id"), ("completeness", "name.first")
    ]


def test_null_threshold_is_strict(spark):
    frame = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    found = {r.column_name: r.exceeds_threshold for r in validate.validate_nulls(frame).collect()}
    assert found == {"a": False, "b": True}


def test_validate_all_runs_chosen_checks(people):
    report = validate.validate_all(people, ["nulls", "duplicates"], run_at="2024-01-01").collect()
    assert [(r.check, r.is_valid, r.violations) for r in report] == [
        ("nulls", False, 5), ("duplicates", False, 2)
    ]
    with pytest.raises(ValueError):
        validate.validate_all(people, ["colors"])


def test_unknown_column(people):
    with pytest.raises(ValueError):
        metrics.completeness_column(people, ["nobody"])


def test_null_ratio_label(people):
    found = rows.null_ratio_label(people).collect()
    assert sorted(r.ground_truth for r in found) == [0, 0, 0, 1, 1]


def test_assessment(people):
    found = assess(people, "2024-01-01")
    row = found.rows.filter("id = 3").first()
    assert list(row.quality_feature_vector) == pytest.approx(
        [200 / 3, 200 / 3, 0.0, 100.0, 66.67, 66.67, 60.0, 100.0]
    )
    assert found.rows.count() == 5
    assert found.metrics.count() == 16
    assert found.validation.count() == 4
    assert found.features.filter("level = 'dataset'").count() == 4


def test_row_operators_work_on_streams(spark, people, tmp_path):
    people.withColumnRenamed("name.first", "name").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, name string, score double").parquet(
        str(tmp_path / "in")
    )
    measured = rows.row_features(rows.row_accuracy(rows.row_completeness(stream)), ["id", "name"])
    writing = measured.writeStream.format("memory").queryName("measured").start()
    writing.processAllAvailable()
    writing.stop()
    assert spark.table("measured").agg(F.sum("null_count")).first()[0] == 2


def test_nested_timestamps_a_microsecond_apart_are_distinct(spark):
    frame = spark.range(10).select(
        F.struct(F.timestamp_micros(F.col("id") + 1_700_000_000_000_000).alias("at")).alias("s"),
        F.array(F.timestamp_micros(F.col("id") + 1_700_000_000_000_000).cast("timestamp_ntz")).alias("a"),
    )
    for scans in ("shared", "per_column"):
        found = profile.distinct_profile(frame, scans=scans)
        assert {r.distinct_values for r in found.collect()} == {10}
