"""Row-level operators: narrow projections, and the duplicate flag."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.functions.cells import (
    cell,
    chosen,
    filled_cells,
    is_temporal,
    null_cells,
    ratio,
    restored,
)
from rowgauge.functions.freshness import NO_DATE_SCORE, age_score, reference_point
from rowgauge.operators.profile import COPIES, row_copies

# Largest number of copies one distinct row is expanded to within one task. Rows with more
# copies are cut into blocks of this size and the blocks are spread over the cluster.
BLOCK = 100_000


def completeness_of(names: list[str]) -> Column:
    """Share of non-null cells of a row, 0..100."""
    return filled_cells(names).cast("double") / F.lit(len(names)) * 100


def freshness_of(
    df: DataFrame,
    names: list[str],
    reference_date: str | datetime.date | datetime.datetime | None,
) -> Column:
    """Lowest age score among the row's dates; 100 for a row without any."""
    reference = reference_point(reference_date)
    scores = [age_score(cell(n), reference) for n in names if is_temporal(df.schema[n].dataType)]
    if not scores:
        return F.lit(NO_DATE_SCORE)
    lowest = F.array_min(F.array(*scores))
    return F.coalesce(lowest, F.lit(NO_DATE_SCORE))


def row_completeness(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.withColumn("row_completeness", completeness_of(chosen(df, columns)))


def row_accuracy(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Same measure as completeness, over the input's own columns."""
    return df.withColumn("row_accuracy", completeness_of(chosen(df, columns)))


def row_timeliness(
    df: DataFrame,
    reference_date: str | datetime.date | datetime.datetime | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    return df.withColumn(
        "row_timeliness", freshness_of(df, chosen(df, columns), reference_date)
    )


def flagged_copies(counted: DataFrame, copies: str = COPIES) -> DataFrame:
    """Write every distinct row out `copies` times, the first with is_duplicate 0, others 1.

    A row with at most BLOCK copies is written where it lies. One with more is cut into blocks,
    which are dealt out over all shuffle partitions, so no task writes a hot row alone. Both
    branches read the same shuffle: Spark reuses the exchange behind `counted`.
    """
    spark = counted.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col(copies)
    names = [n for n in counted.columns if n != copies]

    def written(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.select(
            *[cell(n) for n in names], F.explode(F.sequence(first, last)).alias("__copy")
        )

    usual = written(counted.filter(number <= BLOCK), F.lit(1).cast("bigint"), number)
    blocks = (
        counted.filter(number > BLOCK)
        .withColumn("__block", F.explode(F.sequence(F.lit(0), F.ceil(number / BLOCK) - 1)))
        .repartition(partitions, "__block", *[cell(n) for n in names])
    )
    hot = written(
        blocks,
        F.col("__block") * BLOCK + 1,
        F.least((F.col("__block") + 1) * BLOCK, number),
    )
    return usual.unionAll(hot).select(
        *[cell(n) for n in names], (F.col("__copy") > 1).cast("int").alias("is_duplicate")
    )


def duplicate_flag(df: DataFrame) -> DataFrame:
    """Add `is_duplicate`: 0 for one copy of each distinct row, 1 for all further copies."""
    flagged = flagged_copies(row_copies(df))
    return flagged.select(
        *[restored(cell(f.name), f.dataType).alias(f.name) for f in df.schema.fields],
        "is_duplicate",
    )


def row_metrics(
    df: DataFrame,
    reference_date: str | datetime.date | datetime.datetime | None = None,
) -> DataFrame:
    """All four row metrics: completeness, accuracy, duplicate flag, timeliness.

    Everything is measured over the input's own columns.
    """
    names = chosen(df, None)
    share = completeness_of(names)
    return duplicate_flag(df).select(
        *[cell(n) for n in names],
        share.alias("row_completeness"),
        share.alias("row_accuracy"),
        "is_duplicate",
        freshness_of(df, names, reference_date).alias("row_timeliness"),
    )


def row_features(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Add `null_count` and `valid_types_count`."""
    names = chosen(df, columns)
    return df.select(
        "*",
        null_cells(names).alias("null_count"),
        filled_cells(names).alias("valid_types_count"),
    )


def null_ratio_label(
    df: DataFrame, columns: Iterable[str] | None = None, threshold: float = 0.1
) -> DataFrame:
    """Add `null_ratio` and the rule label `ground_truth`: 1 up to the threshold, else 0."""
    names = chosen(df, columns)
    share = ratio(null_cells(names), F.lit(len(names)))
    return df.select(
        "*",
        share.alias("null_ratio"),
        F.when(share <= threshold, 1).otherwise(0).alias("ground_truth"),
    )


def drop_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows without a null (or NaN) cell."""
    return df.dropna(subset=None if columns is None else list(columns))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Each distinct row once, nulls being equal."""
    return row_copies(df).select(
        *[restored(cell(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )
