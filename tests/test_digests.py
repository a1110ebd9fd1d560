"""Rows and values counted by digests, and validation by file in one scan."""

from __future__ import annotations

import datetime
import math
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.operators import metrics, profile, validate
from rowgauge.sources import readers


def distinct(frame):
    return profile.duplicate_profile(frame).first().distinct_rows


def values(frame, scans="shared"):
    return {r.column_name: (r.nulls, r.distinct_values) for r in profile.distinct_profile(frame, scans=scans).collect()}


def test_nulls_in_other_columns_are_other_rows(spark):
    frame = spark.createDataFrame(
        [("a", None), (None, "a"), ("a", ""), ("", "a"), (None, None), (None, None), ("", ""), (None, "")],
        "x string, y string",
    )
    assert distinct(frame) == frame.distinct().count() == 7


@pytest.mark.parametrize("width", [1, 59, 61, 130])
def test_marks_of_wide_rows(spark, width):
    rows = [tuple(None if i == gap else 1 for i in range(width)) for gap in range(width)] * 2
    assert distinct(spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(width)))) == width


def test_equal_numbers_are_one_value(spark):
    frame = spark.createDataFrame(
        [(0.0, [0.0]), (-0.0, [-0.0]), (math.nan, [math.nan]), (math.nan, [math.nan]), (1.5, None), (None, [1.5])],
        "d double, a array<double>",
    ).select("d", F.col("d").cast("float").alias("f"), F.struct("d").alias("s"), "a")
    assert distinct(frame) == 4
    for scans in ("shared", "per_column"):
        found = values(frame, scans)
        assert found["d"] == found["f"] == (1, 4) and found["a"] == (1, 4) and found["s"] == (0, 4)


def test_nested_nulls_are_told_apart(spark):
    frame = spark.sql(
        "SELECT * FROM VALUES (array(1, null), named_struct('x', 1, 'y', null), map('k', null)), "
        "(array(null, 1), named_struct('x', null, 'y', 1), map()), (array(1), null, map('k', 1)), "
        "(array(), named_struct('x', null, 'y', null), null), (null, named_struct('x', 1, 'y', null), map('k', 1)) t(a, s, m)"
    )
    assert distinct(frame) == 5
    for scans in ("shared", "per_column"):
        assert values(frame, scans) == {"a": (1, 5), "s": (1, 4), "m": (1, 4)}


def test_values_of_all_types(spark):
    frame = spark.range(40).select(
        (F.col("id") % 3).cast("tinyint").alias("t"),
        (F.col("id") % 4).cast("decimal(38,10)").alias("wide"),
        (F.col("id") % 5).cast("decimal(9,2)").alias("short"),
        (F.col("id") % 6).cast("string").cast("binary").alias("b"),
        F.timestamp_micros(F.col("id") % 7).alias("at"),
        F.timestamp_micros(F.col("id") % 8).cast("timestamp_ntz").alias("local"),
        F.date_from_unix_date((F.col("id") % 9).cast("int")).alias("day"),
        F.repeat(F.lit("x"), (F.col("id") % 10).cast("int")).alias("text"),
        (F.col("id") % 2 == 0).alias("flag"),
    )
    want = dict(zip(frame.columns, [3, 4, 5, 6, 7, 8, 9, 10, 2]))
    for scans in ("shared", "per_column"):
        assert {k: n for k, (_, n) in values(frame, scans).items()} == want


def shuffled(frame) -> list[str]:
    """The columns that each exchange of the plan passes on."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    text = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "Exchange" in plan
    return re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", text)


def test_shuffle_does_not_depend_on_width(spark):
    def narrow(width):
        text = [F.repeat(F.col("id").cast("string"), 50).alias(f"c{i}") for i in range(width)]
        return spark.range(10).select(*text)

    for operator in (profile.duplicate_profile, metrics.consistency_dataset, metrics.consistency_column,
                     validate.validate_duplicates, validate.validate_all):
        for frame in (operator(narrow(2)), operator(narrow(30))):
            assert not [c for c in shuffled(frame) if re.search(r"\bc\d+#", c)]
        sizes = [[c.count("#") for c in shuffled(operator(narrow(w)))] for w in (2, 30)]
        assert sizes[0] == sizes[1]


def test_validation_scans_once(spark, tmp_path):
    spark.range(100).select("id", F.lit("a").alias("t")).write.parquet(str(tmp_path / "x"))
    frame = spark.read.parquet(str(tmp_path / "x"))
    plan = validate.validate_all(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert [(r.check, r.violations) for r in validate.validate_all(frame).collect()] == [
        ("nulls", 0), ("duplicates", 0), ("schema", 0), ("data_types", 0)
    ]


def test_groups_have_reports_of_their_own(spark):
    frame = spark.createDataFrame(
        [("a", 1, None), ("a", 1, None), ("b", 1, "x"), ("b", 2, "3"), (None, 1, "x"), (None, 1, "x")],
        "g string, v int, t string",
    )
    found = validate.validate_groups(frame, ["g"], expected_types={"t": "int"}, run_at="2024-01-01").collect()
    got = {(r.g, r.check): r.violations for r in found}
    assert got == {
        ("a", "nulls"): 2, ("a", "duplicates"): 1, ("a", "schema"): 0, ("a", "data_types"): 0,
        ("b", "nulls"): 0, ("b", "duplicates"): 0, ("b", "schema"): 0, ("b", "data_types"): 1,
        (None, "nulls"): 0, (None, "duplicates"): 1, (None, "schema"): 0, (None, "data_types"): 2,
    }
    assert all(r.is_valid == (r.violations == 0) and r.run_at == datetime.datetime(2024, 1, 1) for r in found)
    only = validate.validate_groups(frame, ["g"], ["schema"], T.StructType().add("v", T.IntegerType()).add("w", T.IntegerType()))
    assert {(r.g, r.violations) for r in only.collect()} == {("a", 2), ("b", 2), (None, 2)}
    with pytest.raises(ValueError):
        validate.validate_groups(frame, ["g"], [])


def test_directory_is_judged_by_file_in_one_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n1,2\n,3\n")
    (tmp_path / "b b.csv").write_text("x,y\n1,q\n")
    (tmp_path / "none.csv").write_text("x,y\n")
    (tmp_path / "other.txt").write_text("x,y\n,\n")
    found = readers.validate_directory(
        spark, str(tmp_path), expected_types={"y": "int"},
        expected_schema=T.StructType().add("x", T.StringType()).add("y", T.StringType()),
    )
    got = {}
    for r in found.collect():
        name = os.path.basename(r.file_path).replace("%20", " ")
        got.setdefault(name, {})[r.check] = (r.is_valid, r.violations)
    good = (True, 0)
    assert got == {
        "a.csv": {"nulls": (False, 1), "duplicates": (False, 1), "schema": good, "data_types": good},
        "b b.csv": {"nulls": good, "duplicates": good, "schema": good, "data_types": (False, 1)},
        "none.csv": {"nulls": good, "duplicates": good, "schema": good, "data_types": good},
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.find("Initial Plan"):] if "Initial Plan" in plan else plan
    assert plan.count("FileScan csv") == 1
