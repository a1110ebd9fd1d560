"""Column-level and dataset-level features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.functions.cells import chosen, percent
from rowgauge.operators.profile import column_profile, distinct_profile

# Assumed width of a cell and bytes per megabyte for the size estimate.
BYTES_PER_CELL = 8
BYTES_PER_MB = 1024 * 1024


def null_percentages(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column_name, null_percentage)."""
    return column_profile(df, columns).select(
        "column_name", percent(F.col("nulls"), F.col("rows")).alias("null_percentage")
    )


def cardinality(
    df: DataFrame, columns: Iterable[str] | None = None, scans: str = "shared"
) -> DataFrame:
    """(column_name, cardinality): distinct values, NULL included, as a share of all rows."""
    return distinct_profile(df, columns, scans).select(
        "column_name", percent(F.col("distinct_values"), F.col("rows")).alias("cardinality")
    )


def numeric_stats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column_name, count, mean, stddev, min, max) of every numeric column; sample stddev."""
    return (
        column_profile(df, columns, stats=True)
        .filter("numeric")
        .select("column_name", F.col("filled").alias("count"), "mean", "stddev", "min", "max")
    )


def column_features(
    df: DataFrame, columns: Iterable[str] | None = None, scans: str = "shared"
) -> DataFrame:
    """Null share, cardinality and statistics per column; statistics null if not numeric."""
    names = chosen(df, columns)
    profile = column_profile(df, names, stats=True)
    distinct = distinct_profile(df, names, scans)
    # Both sides hold one row per column of the table.
    return profile.join(distinct.select("ordinal", "distinct_values"), "ordinal").select(
        "column_name",
        "data_type",
        percent(F.col("nulls"), F.col("rows")).alias("null_percentage"),
        percent(F.col("distinct_values"), F.col("rows")).alias("cardinality"),
        F.when(F.col("numeric"), F.col("filled")).alias("count"),
        "mean",
        "stddev",
        "min",
        "max",
    )


def _estimated_mb(rows: Column, width: int) -> Column:
    return rows.cast("double") * F.lit(width * BYTES_PER_CELL) / F.lit(float(BYTES_PER_MB))


def dataset_features(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: (row_count, column_count, estimated_mb, data_density)."""
    names = chosen(df, columns)
    return column_profile(df, names).agg(
        F.max("rows").alias("row_count"),
        F.lit(len(names)).alias("column_count"),
        _estimated_mb(F.max("rows"), len(names)).alias("estimated_mb"),
        percent(F.sum("filled"), F.sum("rows")).alias("data_density"),
    )


def features_summary(
    df: DataFrame, columns: Iterable[str] | None = None, scans: str = "shared"
) -> DataFrame:
    """All features as long rows (level, feature, column_name, value)."""
    names = chosen(df, columns)

    def spread(frame: DataFrame, level: str, name: Column, features: list[str]) -> DataFrame:
        entries = [
            F.struct(
                F.lit(level).alias("level"),
                F.lit(feature).alias("feature"),
                name.cast("string").alias("column_name"),
                F.col(feature).cast("double").alias("value"),
            )
            for feature in features
        ]
        return frame.select(F.inline(F.array(*entries)))

    whole = spread(
        dataset_features(df, names),
        "dataset",
        F.lit(None),
        ["row_count", "column_count", "estimated_mb", "data_density"],
    )
    numbers = ["count", "mean", "stddev", "min", "max"]
    by_column = spread(
        column_features(df, names, scans),
        "column",
        F.col("column_name"),
        ["null_percentage", "cardinality", *numbers],
    ).filter(~(F.col("value").isNull() & F.col("feature").isin(numbers)))
    return whole.unionAll(by_column)
