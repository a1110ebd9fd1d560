"""Completeness, accuracy, consistency and timeliness per dataset and per column.

Every function gives long rows (metric, level, column_name, value); `column_name` is null on
dataset level. Values are percentages with two decimals.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.functions.cells import percent, rounded
from rowgauge.functions.freshness import NO_DATE_SCORE
from rowgauge.operators.profile import column_profile, distinct_profile, duplicate_profile
from rowgauge.operators.schema import validity_profile

# Order in which the metrics are reported.
METRICS = ("completeness", "accuracy", "consistency", "timeliness")


def _long(frame: DataFrame, metric: Column, level: str, name: Column, value: Column) -> DataFrame:
    return frame.select(
        metric.alias("metric"),
        F.lit(level).alias("level"),
        name.cast("string").alias("column_name"),
        value.alias("value"),
    )


def _dataset(frame: DataFrame, metric: str, value: Column) -> DataFrame:
    return _long(frame, F.lit(metric), "dataset", F.lit(None), value)


def _column(frame: DataFrame, metric: str, value: Column) -> DataFrame:
    return _long(frame, F.lit(metric), "column", F.col("column_name"), value)


def filled_share(profile: DataFrame) -> DataFrame:
    """One row (value): non-null share of all cells of a profiled table."""
    return profile.agg(percent(F.sum("filled"), F.sum("rows")).alias("value"))


def mean_age_score(profile: DataFrame) -> DataFrame:
    """One row (value): mean score of the temporal columns that hold a date."""
    return profile.agg(
        F.coalesce(rounded(F.avg("age_score")), F.lit(NO_DATE_SCORE)).alias("value")
    )


def completeness_dataset(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return _dataset(filled_share(column_profile(df, columns)), "completeness", F.col("value"))


def completeness_column(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return _column(
        column_profile(df, columns), "completeness", percent(F.col("filled"), F.col("rows"))
    )


def accuracy_dataset(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Non-null share of all cells; see `type_validity_column` for checks of the content."""
    return _dataset(filled_share(column_profile(df, columns)), "accuracy", F.col("value"))


def accuracy_column(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return _column(
        column_profile(df, columns), "accuracy", percent(F.col("filled"), F.col("rows"))
    )


def type_validity_column(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Share of cells that are null or readable as the expected type."""
    return _column(
        validity_profile(df, expected),
        "type_validity",
        percent(F.col("checked") - F.col("invalid_count"), F.col("checked")),
    )


def type_validity_dataset(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    share = validity_profile(df, expected).agg(
        percent(F.sum(F.col("checked") - F.col("invalid_count")), F.sum("checked")).alias("value")
    )
    return _dataset(share, "type_validity", F.col("value"))


def consistency_dataset(df: DataFrame) -> DataFrame:
    """Distinct rows as a share of all rows."""
    return _dataset(
        duplicate_profile(df),
        "consistency",
        percent(F.col("distinct_rows"), F.col("total_rows")),
    )


def consistency_column(
    df: DataFrame, columns: Iterable[str] | None = None, scans: str = "shared"
) -> DataFrame:
    """Distinct values, NULL being one of them, as a share of all rows."""
    return _column(
        distinct_profile(df, columns, scans),
        "consistency",
        percent(F.col("distinct_values"), F.col("rows")),
    )


def timeliness_dataset(
    df: DataFrame,
    reference_date: str | datetime.date | datetime.datetime | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Mean age score over the temporal columns; 100 without any."""
    profile = column_profile(df, columns, freshness=True, reference_date=reference_date)
    return _dataset(mean_age_score(profile), "timeliness", F.col("value"))


def timeliness_column(
    df: DataFrame,
    reference_date: str | datetime.date | datetime.datetime | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Age score of each column's latest date; 100 for other columns."""
    profile = column_profile(df, columns, freshness=True, reference_date=reference_date)
    return _column(
        profile, "timeliness", F.coalesce(rounded(F.col("age_score")), F.lit(NO_DATE_SCORE))
    )


def all_metrics(
    df: DataFrame,
    reference_date: str | datetime.date | datetime.datetime | None = None,
    scans: str = "shared",
) -> DataFrame:
    """The four metrics on both levels: three passes over the input, as one Spark query.

    One aggregate without a shuffle of rows serves completeness, accuracy and timeliness; one
    shuffle of values serves column consistency; one shuffle of rows dataset consistency.
    `scans` is passed on to `distinct_profile`.
    """
    profile = column_profile(df, freshness=True, reference_date=reference_date)
    share = percent(F.col("filled"), F.col("rows"))
    age = F.coalesce(rounded(F.col("age_score")), F.lit(NO_DATE_SCORE))

    def spread(frame: DataFrame, level: str, name: Column, values: dict[str, Column]) -> DataFrame:
        # Several metrics out of one pass: one struct per metric, inlined to rows.
        return frame.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(metric).alias("metric"),
                            F.lit(level).alias("level"),
                            name.cast("string").alias("column_name"),
                            value.alias("value"),
                        )
                        for metric, value in values.items()
                    ]
                )
            )
        )

    by_column = spread(
        profile,
        "column",
        F.col("column_name"),
        {"completeness": share, "accuracy": share, "timeliness": age},
    )
    whole = profile.agg(
        percent(F.sum("filled"), F.sum("rows")).alias("filled_share"),
        F.coalesce(rounded(F.avg("age_score")), F.lit(NO_DATE_SCORE)).alias("age"),
    )
    of_dataset = spread(
        whole,
        "dataset",
        F.lit(None),
        {
            "completeness": F.col("filled_share"),
            "accuracy": F.col("filled_share"),
            "timeliness": F.col("age"),
        },
    )
    return (
        of_dataset.unionAll(consistency_dataset(df))
        .unionAll(by_column)
        .unionAll(consistency_column(df, scans=scans))
    )


def metrics_report(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Metrics in reading order, numbered by `position`: dataset value, then the columns.

    `columns` gives the column order. There is one row per metric and column, so the sort is
    over table metadata, not over data.
    """
    metric_rank = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    column_rank = F.coalesce(
        F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name")), F.lit(0)
    )
    # Both ranks are dense, so the position is plain arithmetic and needs no window.
    position = (metric_rank - 1) * (len(columns) + 1) + column_rank + 1
    return metrics.select(position.cast("int").alias("position"), *metrics.columns).orderBy(
        "position"
    )


def as_dict(metrics: DataFrame) -> dict[str, dict]:
    """Nested view {metric: {"dataset": value, "columns": {name: value}}} for callers.

    Collects one row per metric and column.
    """
    nested: dict[str, dict] = {}
    for row in metrics.collect():
        entry = nested.setdefault(row["metric"], {"dataset": None, "columns": {}})
        if row["level"] == "dataset":
            entry["dataset"] = row["value"]
        else:
            entry["columns"][row["column_name"]] = row["value"]
    return nested
