"""Validation reports as rows."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell, chosen, percent, ratio
from rowgauge.functions.typing import fits_type, type_name_of
from rowgauge.operators.profile import COPIES, column_profile, duplicate_profile, row_frequencies
from rowgauge.operators.schema import validity_profile

# Shares above which a column or a table draws a warning.
NULL_THRESHOLD = 0.5
DUPLICATE_THRESHOLD = 0.1

CHECKS = ("nulls", "duplicates", "schema", "data_types")


def validate_nulls(
    df: DataFrame, columns: Iterable[str] | None = None, threshold: float = NULL_THRESHOLD
) -> DataFrame:
    """(column_name, total_rows, null_count, null_percentage, exceeds_threshold, is_valid)."""
    share = ratio(F.col("nulls"), F.col("rows"))
    return column_profile(df, columns).select(
        "column_name",
        F.col("rows").alias("total_rows"),
        F.col("nulls").alias("null_count"),
        percent(F.col("nulls"), F.col("rows")).alias("null_percentage"),
        F.coalesce(share > threshold, F.lit(False)).alias("exceeds_threshold"),
        (F.col("nulls") == 0).alias("is_valid"),
    )


def validate_duplicates(df: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """One row: total, distinct and duplicate rows, share, warning and verdict."""
    share = ratio(F.col("duplicate_count"), F.col("total_rows"))
    return duplicate_profile(df).select(
        "total_rows",
        "distinct_rows",
        "duplicate_count",
        percent(F.col("duplicate_count"), F.col("total_rows")).alias("duplicate_percentage"),
        F.coalesce(share > threshold, F.lit(False)).alias("exceeds_threshold"),
        (F.col("duplicate_count") == 0).alias("is_valid"),
    )


def _schema_rows(fields: list[T.StructField], expected: T.StructType | None) -> list[tuple]:
    rows = []
    wanted = None if expected is None else {f.name: f.dataType for f in expected.fields}
    for field in fields:
        actual = field.dataType.simpleString()
        target = None
        status = "valid"
        if wanted is not None:
            if field.name not in wanted:
                status = "unexpected"
            else:
                target = wanted[field.name].simpleString()
                status = "valid" if target == actual else "type_mismatch"
        rows.append((field.name, target, actual, field.nullable, status))
    for name, dtype in (wanted or {}).items():
        if name not in [f.name for f in fields]:
            rows.append((name, dtype.simpleString(), None, None, "missing"))
    return rows


def validate_schema(df: DataFrame, expected: T.StructType | None = None) -> DataFrame:
    """(column_name, expected_type, actual_type, nullable, status) from metadata alone.

    Without an expected schema every column is 'valid'. With one, the status is 'valid',
    'type_mismatch', 'missing' or 'unexpected'.
    """
    return df.sparkSession.createDataFrame(
        _schema_rows(df.schema.fields, expected),
        "column_name string, expected_type string, actual_type string, nullable boolean, "
        "status string",
    )


def validate_types(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """(column_name, expected_type, checked, invalid_count, status); text judged by content.

    Without expectations every column is checked against its own type.
    """
    if expected is None:
        expected = {f.name: type_name_of(f.dataType) for f in df.schema.fields}
    return validity_profile(df, expected).select(
        "column_name",
        "expected_type",
        "checked",
        "invalid_count",
        F.when(F.col("invalid_count") == 0, "valid").otherwise("invalid").alias("status"),
    )


def validate_groups(
    df: DataFrame,
    by: Iterable[str],
    checks: Iterable[str] = CHECKS,
    expected_schema: T.StructType | None = None,
    expected_types: dict[str, str] | None = None,
    run_at: str | datetime.datetime | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """One row per group and check: (`by`, check, is_valid, violations, run_at).

    The groups are those of the columns `by`, null being a value; what is checked is the other
    columns. `violations` counts null cells, surplus rows, columns off the schema and cells of the
    wrong type. One scan, whatever the number of groups, checks and columns: every row leaves its
    task as a digest with its counts, equal rows as one. `listed` names the groups to report, each
    once and none null, where some may have no rows.
    """
    by, checks = list(by), list(checks)
    unknown = [c for c in checks if c not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks: {unknown}")
    if not checks:
        raise ValueError("at least one check is needed")
    fields = [f for f in df.schema.fields if f.name not in by]
    names = chosen(df, [f.name for f in fields])
    if expected_types is None:
        expected_types = {f.name: type_name_of(f.dataType) for f in fields}

    def added(marks: list[Column]) -> Column:
        return reduce(Column.__add__, [F.when(m, F.lit(1)).otherwise(0).cast("bigint") for m in marks])

    counts = {}
    if "nulls" in checks:
        counts["nulls"] = added([cell(n).isNull() for n in names])
    if "data_types" in checks:
        judged = chosen(df, expected_types)
        counts["data_types"] = added(
            [~fits_type(cell(n), df.schema[n].dataType, expected_types[n]) for n in judged]
        )
    sums = {f"__sum_{c}": value for c, value in counts.items()}
    groups = [f"__by_{i}" for i in range(len(by))]
    if "duplicates" in checks:
        rows = row_frequencies(df, by, sums).withColumnsRenamed(dict(zip(by, groups)))
        surplus = {"duplicates": F.sum(F.col(COPIES) - 1)}
    else:
        rows = df.select(
            *[cell(n).alias(g) for n, g in zip(by, groups)], *[v.alias(n) for n, v in sums.items()]
        )
        surplus = {}
    off = sum(row[-1] != "valid" for row in _schema_rows(fields, expected_schema))
    violations = surplus | {c: F.sum(f"__sum_{c}") for c in counts}
    counted = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__rows"), *[v.alias(f"__of_{c}") for c, v in violations.items()]
    )
    if listed is not None:
        counted = listed.select(*[cell(n).alias(g) for n, g in zip(by, groups)]).join(counted, groups, "left")
    report = F.array(
        *[
            F.struct(
                F.lit(c).alias("check"),
                (F.lit(off) if c == "schema" else F.coalesce(F.col(f"__of_{c}"), F.lit(0)))
                .cast("bigint").alias("violations"),
            )
            for c in checks
        ]
    )
    moment = F.current_timestamp() if run_at is None else F.lit(str(run_at)).cast("timestamp")
    return counted.select(*groups, F.inline(report)).select(
        *[F.col(g).alias(n) for g, n in zip(groups, by)],
        "check",
        (F.col("violations") == 0).alias("is_valid"),
        "violations",
        moment.alias("run_at"),
    )


def validate_all(
    df: DataFrame,
    checks: Iterable[str] = CHECKS,
    expected_schema: T.StructType | None = None,
    expected_types: dict[str, str] | None = None,
    run_at: str | datetime.datetime | None = None,
) -> DataFrame:
    """One row per check: (check, is_valid, violations, run_at), as in `validate_groups`; one scan."""
    return validate_groups(df, [], checks, expected_schema, expected_types, run_at)
