"""Queries: metrics, validation and features over the damaged orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgauge.functions.cells import rounded
from rowgauge.operators import features, metrics, rows, validate
from workload.registry import query
from workload.views import (
    DIRTY_COLUMNS,
    DIRTY_NUMBERS,
    DIRTY_ORDERS,
    REFERENCE_DATE,
    WIDE_COLUMNS,
    WIDE_NULLS,
    dirty_orders,
    sql_age,
    sql_percent,
    sql_rounded,
    wide_nulls,
)

WIDTH = len(DIRTY_COLUMNS)
NULLS_IN_ROW = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in DIRTY_COLUMNS)
FILLED_IN_ROW = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in DIRTY_COLUMNS)
FILLED_TOTAL = " + ".join(f"count({c})" for c in DIRTY_COLUMNS)
ALL_COLUMNS = ", ".join(DIRTY_COLUMNS)
WITH = f"WITH {DIRTY_ORDERS}"
COUNTED = f"counted AS (SELECT {ALL_COLUMNS}, count(*) AS n FROM dirty_orders GROUP BY ALL)"


def dataset_row(metric: str, value: str) -> str:
    return (
        f"SELECT '{metric}' AS metric, 'dataset' AS level, CAST(NULL AS VARCHAR) AS column_name, "
        f"{value} AS value FROM dirty_orders"
    )


def column_rows(metric: str, value) -> str:
    """UNION ALL of one row per column; `value` maps a column to an SQL expression."""
    return " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, 'column' AS level, '{c}' AS column_name, {value(c)} AS value "
        "FROM dirty_orders"
        for c in DIRTY_COLUMNS
    )


FILLED_SHARE = sql_percent(FILLED_TOTAL, f"count(*) * {WIDTH}")
DISTINCT_SHARE = sql_percent("(SELECT count(*) FROM counted)", "count(*)")


def filled_of(c: str) -> str:
    return sql_percent(f"count({c})", "count(*)")


def distinct_of(c: str) -> str:
    return sql_percent(f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER))", "count(*)")


def age_of(c: str) -> str:
    if c != "o_orderdate":
        return "CAST(max(100.0) AS DOUBLE)"
    return f"coalesce({sql_age(f'max({c})')}, 100.0)"


# Completeness ---------------------------------------------------------------------------------


@query("completeness_dataset", f"{WITH} {dataset_row('completeness', FILLED_SHARE)}")
def _(spark, sf):
    return metrics.completeness_dataset(dirty_orders(spark, sf))


@query("completeness_column", f"{WITH} {column_rows('completeness', filled_of)}")
def _(spark, sf):
    return metrics.completeness_column(dirty_orders(spark, sf))


@query(
    "completeness_row",
    f"{WITH} SELECT *, CAST({FILLED_IN_ROW} AS DOUBLE) / {WIDTH} * 100 AS row_completeness "
    "FROM dirty_orders",
)
def _(spark, sf):
    return rows.row_completeness(dirty_orders(spark, sf))


# Accuracy -------------------------------------------------------------------------------------


@query("accuracy_dataset", f"{WITH} {dataset_row('accuracy', FILLED_SHARE)}")
def _(spark, sf):
    return metrics.accuracy_dataset(dirty_orders(spark, sf))


@query("accuracy_column", f"{WITH} {column_rows('accuracy', filled_of)}")
def _(spark, sf):
    return metrics.accuracy_column(dirty_orders(spark, sf))


@query(
    "accuracy_row",
    f"{WITH} SELECT *, CAST({FILLED_IN_ROW} AS DOUBLE) / {WIDTH} * 100 AS row_accuracy "
    "FROM dirty_orders",
)
def _(spark, sf):
    return rows.row_accuracy(dirty_orders(spark, sf))


# Consistency ----------------------------------------------------------------------------------


@query(
    "consistency_dataset", f"{WITH}, {COUNTED} {dataset_row('consistency', DISTINCT_SHARE)}"
)
def _(spark, sf):
    return metrics.consistency_dataset(dirty_orders(spark, sf))


@query("consistency_column", f"{WITH} {column_rows('consistency', distinct_of)}")
def _(spark, sf):
    return metrics.consistency_column(dirty_orders(spark, sf))


NUMBERED = (
    f"numbered AS (SELECT *, row_number() OVER (PARTITION BY {ALL_COLUMNS} "
    "ORDER BY 1) AS rn FROM dirty_orders)"
)


@query(
    "duplicate_flag",
    f"{WITH}, {NUMBERED} SELECT {ALL_COLUMNS}, CAST(rn > 1 AS INTEGER) AS is_duplicate "
    "FROM numbered",
)
def _(spark, sf):
    return rows.duplicate_flag(dirty_orders(spark, sf))


# Timeliness -----------------------------------------------------------------------------------


@query("timeliness_dataset", f"{WITH} {dataset_row('timeliness', age_of('o_orderdate'))}")
def _(spark, sf):
    return metrics.timeliness_dataset(dirty_orders(spark, sf), REFERENCE_DATE)


@query("timeliness_column", f"{WITH} {column_rows('timeliness', age_of)}")
def _(spark, sf):
    return metrics.timeliness_column(dirty_orders(spark, sf), REFERENCE_DATE)


ROW_AGE = f"coalesce({sql_age('o_orderdate')}, 100.0)"


@query("timeliness_row", f"{WITH} SELECT *, {ROW_AGE} AS row_timeliness FROM dirty_orders")
def _(spark, sf):
    return rows.row_timeliness(dirty_orders(spark, sf), REFERENCE_DATE)


# All metrics ----------------------------------------------------------------------------------

ALL_METRICS = " UNION ALL ".join(
    [
        dataset_row("completeness", FILLED_SHARE),
        dataset_row("accuracy", FILLED_SHARE),
        dataset_row("consistency", DISTINCT_SHARE),
        dataset_row("timeliness", age_of("o_orderdate")),
        column_rows("completeness", filled_of),
        column_rows("accuracy", filled_of),
        column_rows("consistency", distinct_of),
        column_rows("timeliness", age_of),
    ]
)


@query("all_metrics", f"{WITH}, {COUNTED} {ALL_METRICS}")
def _(spark, sf):
    return metrics.all_metrics(dirty_orders(spark, sf), REFERENCE_DATE)


_RANK_M = "list_position(['completeness','accuracy','consistency','timeliness'], metric)"
_RANK_C = f"coalesce(list_position({DIRTY_COLUMNS!r}, column_name), 0)"


@query(
    "metrics_report",
    f"{WITH}, {COUNTED}, m AS ({ALL_METRICS}) SELECT CAST(row_number() OVER (ORDER BY {_RANK_M}, "
    f"{_RANK_C}) AS INTEGER) AS position, * FROM m",
)
def _(spark, sf):
    found = metrics.all_metrics(dirty_orders(spark, sf), REFERENCE_DATE)
    return metrics.metrics_report(found, DIRTY_COLUMNS)


@query(
    "row_metrics",
    f"{WITH}, {NUMBERED} SELECT {ALL_COLUMNS}, "
    f"CAST({FILLED_IN_ROW} AS DOUBLE) / {WIDTH} * 100 AS row_completeness, "
    f"CAST({FILLED_IN_ROW} AS DOUBLE) / {WIDTH} * 100 AS row_accuracy, "
    f"CAST(rn > 1 AS INTEGER) AS is_duplicate, {ROW_AGE} AS row_timeliness FROM numbered",
)
def _(spark, sf):
    return rows.row_metrics(dirty_orders(spark, sf), REFERENCE_DATE)


# Cleaning, row features -----------------------------------------------------------------------


@query(
    "drop_nulls",
    f"{WITH} SELECT * FROM dirty_orders WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in DIRTY_COLUMNS),
)
def _(spark, sf):
    return rows.drop_nulls(dirty_orders(spark, sf))


@query("drop_duplicates", f"{WITH} SELECT DISTINCT * FROM dirty_orders")
def _(spark, sf):
    return rows.drop_duplicates(dirty_orders(spark, sf))


@query(
    "row_features",
    f"{WITH} SELECT *, {NULLS_IN_ROW} AS null_count, {FILLED_IN_ROW} AS valid_types_count "
    "FROM dirty_orders",
)
def _(spark, sf):
    return rows.row_features(dirty_orders(spark, sf))


@query(
    "null_ratio_label",
    f"{WITH} SELECT *, CAST({NULLS_IN_ROW} AS DOUBLE) / {WIDTH} AS null_ratio, "
    f"CASE WHEN CAST({NULLS_IN_ROW} AS DOUBLE) / {WIDTH} <= 0.1 THEN 1 ELSE 0 END AS ground_truth "
    "FROM dirty_orders",
)
def _(spark, sf):
    return rows.null_ratio_label(dirty_orders(spark, sf))


# Validation -----------------------------------------------------------------------------------


@query(
    "validate_nulls",
    f"{WITH} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
        f"{sql_percent(f'count(*) - count({c})', 'count(*)')} AS null_percentage, "
        f"(count(*) - count({c})) > 0.5 * count(*) AS exceeds_threshold, "
        f"count(*) = count({c}) AS is_valid FROM dirty_orders"
        for c in DIRTY_COLUMNS
    ),
)
def _(spark, sf):
    return validate.validate_nulls(dirty_orders(spark, sf))


DUPLICATES = (
    "dup AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, "
    "CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM counted)"
)


@query(
    "validate_duplicates",
    f"{WITH}, {COUNTED}, {DUPLICATES} SELECT *, "
    f"{sql_percent('duplicate_count', 'total_rows')} AS duplicate_percentage, "
    "duplicate_count > 0.1 * total_rows AS exceeds_threshold, "
    "duplicate_count = 0 AS is_valid FROM dup",
)
def _(spark, sf):
    return validate.validate_duplicates(dirty_orders(spark, sf))


@query(
    "validate_all",
    f"{WITH}, {COUNTED}, {DUPLICATES}, v AS ("
    f"SELECT 'nulls' AS \"check\", CAST((SELECT count(*) * {WIDTH} - ({FILLED_TOTAL}) "
    "FROM dirty_orders) AS BIGINT) AS violations "
    "UNION ALL SELECT 'duplicates', (SELECT duplicate_count FROM dup) "
    "UNION ALL SELECT 'schema', 0 UNION ALL SELECT 'data_types', 0) "
    "SELECT \"check\", violations = 0 AS is_valid, violations FROM v",
)
def _(spark, sf):
    return validate.validate_all(dirty_orders(spark, sf), run_at=REFERENCE_DATE).drop("run_at")


# Features -------------------------------------------------------------------------------------


@query(
    "null_percentages",
    f"{WITH} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {sql_percent(f'count(*) - count({c})', 'count(*)')} "
        "AS null_percentage FROM dirty_orders"
        for c in DIRTY_COLUMNS
    ),
)
def _(spark, sf):
    return features.null_percentages(dirty_orders(spark, sf))


@query(
    "cardinality",
    f"{WITH} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {distinct_of(c)} AS cardinality FROM dirty_orders"
        for c in DIRTY_COLUMNS
    ),
)
def _(spark, sf):
    return features.cardinality(dirty_orders(spark, sf))


def stat_columns(c: str) -> str:
    return (
        f"count({c}) AS count, {sql_rounded(f'avg({c})', 6)} AS mean, "
        f"{sql_rounded(f'stddev_samp({c})', 6)} AS stddev, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max"
    )


@query(
    "numeric_stats",
    f"{WITH} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {stat_columns(c)} FROM dirty_orders" for c in DIRTY_NUMBERS
    ),
)
def _(spark, sf):
    found = features.numeric_stats(dirty_orders(spark, sf))
    return found.withColumns({c: rounded(F.col(c), 6) for c in ("mean", "stddev")})


NO_STATS = (
    "CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, "
    "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
)
SPARK_TYPE = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}
COLUMN_FEATURES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{SPARK_TYPE[c]}' AS data_type, "
    f"{sql_percent(f'count(*) - count({c})', 'count(*)')} AS null_percentage, "
    f"{distinct_of(c)} AS cardinality, {stat_columns(c) if c in DIRTY_NUMBERS else NO_STATS} "
    "FROM dirty_orders"
    for c in DIRTY_COLUMNS
)


@query("column_features", f"{WITH} {COLUMN_FEATURES}")
def _(spark, sf):
    found = features.column_features(dirty_orders(spark, sf))
    return found.withColumns({c: rounded(F.col(c), 6) for c in ("mean", "stddev")})


DATASET_FEATURES = (
    f"SELECT count(*) AS row_count, {WIDTH} AS column_count, "
    f"CAST(count(*) AS DOUBLE) * {WIDTH * 8} / 1048576.0 AS estimated_mb, "
    f"{FILLED_SHARE} AS data_density FROM dirty_orders"
)


@query("dataset_features", f"{WITH} {DATASET_FEATURES}")
def _(spark, sf):
    return features.dataset_features(dirty_orders(spark, sf))


def _summary_rows() -> str:
    parts = [
        f"SELECT 'dataset' AS level, '{f}' AS feature, CAST(NULL AS VARCHAR) AS column_name, "
        f"CAST({f} AS DOUBLE) AS value FROM d"
        for f in ("row_count", "column_count", "estimated_mb", "data_density")
    ]
    for f in ("null_percentage", "cardinality"):
        parts.append(f"SELECT 'column', '{f}', column_name, {f} FROM c")
    for f in ("count", "mean", "stddev", "min", "max"):
        parts.append(
            f"SELECT 'column', '{f}', column_name, CAST(\"{f}\" AS DOUBLE) FROM c "
            f'WHERE "{f}" IS NOT NULL'
        )
    return " UNION ALL ".join(parts)


@query(
    "profile_all",
    f"{WITH}, d AS ({DATASET_FEATURES}), c AS ({COLUMN_FEATURES}) "
    f"SELECT level, feature, column_name, {sql_rounded('value', 6)} AS value "
    f"FROM ({_summary_rows()})",
)
def _(spark, sf):
    found = features.features_summary(dirty_orders(spark, sf))
    return found.withColumn("value", rounded(F.col("value"), 6))


def _wide_row(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, {sql_percent(f'count(*) - count({c})', 'count(*)')} "
        f"AS null_percentage, {sql_percent(f'count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER))', 'count(*)')} "
        "AS cardinality FROM wide_nulls"
    )


@query(
    "wide_profile", f"WITH {WIDE_NULLS} " + " UNION ALL ".join(_wide_row(c) for c in WIDE_COLUMNS)
)
def _(spark, sf):
    return features.column_features(wide_nulls(spark, sf), scans="per_column").select(
        "column_name", "null_percentage", "cardinality"
    )
