"""From a table to its assessment: metrics, features, and rows with a quality vector."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgauge.functions.cells import (
    cell,
    filled_cells,
    is_temporal,
    null_cells,
    percent,
    restored,
    rounded,
)
from rowgauge.functions.freshness import NO_DATE_SCORE, age_score, reference_point
from rowgauge.operators.features import features_summary
from rowgauge.operators.metrics import all_metrics
from rowgauge.operators.profile import COPIES, row_copies
from rowgauge.operators.rows import completeness_of, flagged_copies, freshness_of
from rowgauge.operators.validate import validate_all
from rowgauge.operators.vectors import create_feature_vector

Moment = str | datetime.date | datetime.datetime | None

ROW_FEATURES = ["row_completeness", "row_accuracy", "is_duplicate", "row_timeliness"]


def _dataset_values(df: DataFrame, counted: DataFrame, reference_date: Moment) -> DataFrame:
    """One row with the four dataset metrics, out of the distinct rows and their copies."""
    names = df.columns
    copies = F.col(COPIES)
    dates = [f.name for f in df.schema.fields if is_temporal(f.dataType)]
    reference = reference_point(reference_date)
    totals = counted.agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(copies * filled_cells(names)), F.lit(0)).alias("filled"),
        *[F.max(cell(n)).alias(f"latest_{i}") for i, n in enumerate(dates)],
    )
    share = percent(F.col("filled"), F.col("rows") * len(names))
    age = F.lit(NO_DATE_SCORE)
    if dates:
        scores = F.array_compact(
            F.array(*[age_score(F.col(f"latest_{i}"), reference) for i in range(len(dates))])
        )
        total = F.aggregate(scores, F.lit(0.0), lambda acc, score: acc + score)
        age = F.coalesce(
            rounded(total / F.nullif(F.size(scores), F.lit(0))), F.lit(NO_DATE_SCORE)
        )
    return totals.select(
        share.alias("completeness"),
        share.alias("accuracy"),
        percent(F.col("distinct_rows"), F.col("rows")).alias("consistency"),
        age.alias("timeliness"),
    )


def assessed_rows(df: DataFrame, reference_date: Moment = None) -> DataFrame:
    """Every row with its metrics, features and quality vector: one scan and one shuffle.

    Dataset metrics and duplicate flags both come from the distinct rows and their copies, so
    they share a single exchange. All measures are over the input's own columns.
    """
    names = df.columns
    counted = row_copies(df)
    share = completeness_of(names)
    rows = flagged_copies(counted).select(
        *[restored(cell(f.name), f.dataType).alias(f.name) for f in df.schema.fields],
        share.alias("row_completeness"),
        share.alias("row_accuracy"),
        "is_duplicate",
        freshness_of(df, names, reference_date).alias("row_timeliness"),
        null_cells(names).alias("null_count"),
        filled_cells(names).alias("valid_types_count"),
    )
    return create_feature_vector(
        rows, ROW_FEATURES, _dataset_values(df, counted, reference_date)
    )


@dataclass(frozen=True)
class Assessment:
    """The full assessment of a table. Each frame is planned, and run, when it is asked for."""

    table: DataFrame
    reference_date: Moment = None
    scans: str = "shared"

    @cached_property
    def rows(self) -> DataFrame:
        """Every row with its metrics, features and quality vector."""
        return assessed_rows(self.table, self.reference_date)

    @cached_property
    def metrics(self) -> DataFrame:
        """The four metrics per dataset and column."""
        return all_metrics(self.table, self.reference_date, self.scans)

    @cached_property
    def features(self) -> DataFrame:
        """Column and dataset features as long rows."""
        return features_summary(self.table, scans=self.scans)

    @cached_property
    def validation(self) -> DataFrame:
        """One verdict per check."""
        return validate_all(self.table)


def assess(df: DataFrame, reference_date: Moment = None, scans: str = "shared") -> Assessment:
    """The full assessment of a table; `scans` is passed on to `distinct_profile`."""
    return Assessment(df, reference_date, scans)


def quick_assessment(
    df: DataFrame, reference_date: Moment = None, scans: str = "shared"
) -> DataFrame:
    """Dataset and column metrics only."""
    return all_metrics(df, reference_date, scans)
