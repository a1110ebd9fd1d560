"""The shared passes over a table.

`column_profile` is one map-side-combined aggregate: only one small row per task is
shuffled. Where values or rows are only counted, `value_frequencies` and `row_frequencies` shuffle
digests, whose size does not depend on the width of cells or rows; `row_copies` shuffles the rows
themselves, for those who need them. All combine before they shuffle, so a value or a row that
makes up a third of the table leaves every task as one record.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell, chosen, comparable, is_numeric, is_temporal, quoted
from rowgauge.functions.digests import is_narrow, row_digest, value_digest
from rowgauge.functions.freshness import age_score, reference_point


COPIES = "__copies"


def column_profile(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    *,
    stats: bool = False,
    freshness: bool = False,
    reference_date: str | datetime.date | datetime.datetime | None = None,
) -> DataFrame:
    """One row per column: rows, filled, nulls and, on request, statistics and age score.

    Result: (ordinal, column_name, data_type, rows, filled, nulls
             [, mean, stddev, min, max] [, temporal, age_score]).
    """
    names = chosen(df, columns)
    types = {name: df.schema[name].dataType for name in names}
    reference = reference_point(reference_date)

    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        value = cell(name)
        aggregates.append(F.count(value).alias(f"filled_{i}"))
        if stats and is_numeric(types[name]):
            number = value.cast("double")
            aggregates += [
                F.avg(number).alias(f"mean_{i}"),
                F.stddev_samp(number).alias(f"stddev_{i}"),
                F.min(value).cast("double").alias(f"min_{i}"),
                F.max(value).cast("double").alias(f"max_{i}"),
            ]
        if freshness and is_temporal(types[name]):
            aggregates.append(F.max(value).alias(f"latest_{i}"))

    nothing = F.lit(None).cast("double")
    entries = []
    for i, name in enumerate(names):
        filled = F.col(f"filled_{i}")
        fields = [
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column_name"),
            F.lit(types[name].simpleString()).alias("data_type"),
            F.col("rows"),
            filled.alias("filled"),
            (F.col("rows") - filled).alias("nulls"),
        ]
        if stats:
            numeric = is_numeric(types[name])
            fields += [
                (F.col(f"{part}_{i}") if numeric else nothing).alias(part)
                for part in ("mean", "stddev", "min", "max")
            ]
            fields.append(F.lit(numeric).alias("numeric"))
        if freshness:
            temporal = is_temporal(types[name])
            score = age_score(F.col(f"latest_{i}"), reference) if temporal else nothing
            fields += [F.lit(temporal).alias("temporal"), score.alias("age_score")]
        entries.append(F.struct(*fields))

    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def value_frequencies(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(ordinal, high, low, copies): how often each value of each column occurs, by its digest.

    The input is scanned once whatever the number of columns, and every cell becomes a record of
    three numbers. `high` is null for a null only.
    """
    names = chosen(df, columns)
    records = []
    for i, name in enumerate(names):
        high, low = value_digest(cell(name), df.schema[name].dataType)
        records.append(F.struct(F.lit(i).alias("ordinal"), high.alias("high"), low.alias("low")))
    return (
        df.select(F.inline(F.array(*records)))
        .groupBy("ordinal", "high", "low")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def column_listing(spark: SparkSession, names: list[str]) -> DataFrame:
    """(ordinal, column_name): one row per name."""
    position = F.col("id").cast("int")
    return spark.range(0, len(names), 1, 1).select(
        position.alias("ordinal"),
        F.get(F.array(*[F.lit(name) for name in names]), position).alias("column_name"),
    )


def distinct_profile(
    df: DataFrame, columns: Iterable[str] | None = None, scans: str = "shared"
) -> DataFrame:
    """(ordinal, column_name, rows, nulls, distinct_values); NULL counts as one value.

    'shared' scans the input once and suits any source and any number of columns. With
    'per_column' each column has its own narrow scan and aggregate, all in one job: about twice
    as fast on a columnar file, where every column is still read once, but it computes a
    row-wise or derived input once per column.
    """
    names = chosen(df, columns)
    if scans == "per_column":
        return reduce(
            DataFrame.unionAll, [_distinct_values(df, i, name) for i, name in enumerate(names)]
        )
    if scans != "shared":
        raise ValueError(f"unknown kind of scans: {scans}")
    is_null = F.col("high").isNull()
    counted = (
        value_frequencies(df, names)
        .groupBy("ordinal")
        .agg(
            F.sum("copies").alias("rows"),
            F.sum(F.when(is_null, F.col("copies")).otherwise(0)).alias("nulls"),
            F.count(F.lit(1)).alias("distinct_values"),
        )
    )
    # Listing the columns first keeps those of an empty table in the result.
    return column_listing(df.sparkSession, names).join(counted, "ordinal", "left").select(
        "ordinal",
        "column_name",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("rows", "nulls", "distinct_values")],
    )


def _distinct_values(df: DataFrame, ordinal: int, name: str) -> DataFrame:
    """The same counts for one column, from an aggregate of its own."""
    copies = F.col(COPIES)
    dtype = df.schema[name].dataType
    parts = [cell(name)] if is_narrow(dtype) else list(value_digest(cell(name), dtype))
    keys = [part.alias(f"value_{i}") for i, part in enumerate(parts)]
    return (
        df.select(*keys)
        .groupBy(*[f"value_{i}" for i in range(len(parts))])
        .agg(F.count(F.lit(1)).alias(COPIES))
        .agg(
            F.coalesce(F.sum(copies), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value_0").isNull(), copies)), F.lit(0)).alias("nulls"),
            F.count(F.lit(1)).alias("distinct_values"),
        )
        .select(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("column_name"), "*")
    )


def row_copies(df: DataFrame) -> DataFrame:
    """Each distinct row once, with `copies`; nulls are equal and maps compare by content."""
    keys = [comparable(cell(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(*keys).groupBy(*[quoted(n) for n in df.columns]).agg(
        F.count(F.lit(1)).alias(COPIES)
    )


def row_frequencies(
    df: DataFrame, by: Iterable[str] = (), sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """(`by`, high, low, copies, `sums`): how often each distinct row occurs in each group.

    Rows are those of all columns but `by`, and stand for themselves by their digests. `sums` are
    added up over the copies of a row.
    """
    by = list(by)
    sums = sums or {}
    high, low = row_digest([f for f in df.schema.fields if f.name not in by])
    groups = [f"__by_{i}" for i in range(len(by))]
    return (
        df.select(
            *[cell(n).alias(g) for n, g in zip(by, groups)],
            high.alias("__high"),
            low.alias("__low"),
            *[value.alias(n) for n, value in sums.items()],
        )
        .groupBy(*groups, "__high", "__low")
        .agg(F.count(F.lit(1)).alias(COPIES), *[F.sum(n).alias(n) for n in sums])
        .withColumnsRenamed(dict(zip(groups, by)))
    )


def duplicate_profile(df: DataFrame) -> DataFrame:
    """One row: (total_rows, distinct_rows, duplicate_count)."""
    return row_frequencies(df).agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicate_count"),
    )
