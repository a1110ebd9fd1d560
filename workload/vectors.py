"""Queries: feature vectors and the full assessment."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowgauge.functions.cells import rounded
from rowgauge.operators import metrics, rows, vectors
from rowgauge.plans import assess
from workload.quality import (
    ALL_COLUMNS,
    ALL_METRICS,
    COUNTED,
    DISTINCT_SHARE,
    FILLED_IN_ROW,
    FILLED_SHARE,
    NULLS_IN_ROW,
    NUMBERED,
    ROW_AGE,
    WIDTH,
    WITH,
    age_of,
)
from workload.registry import query
from workload.views import (
    REFERENCE_DATE,
    WIDE_COLUMNS,
    WIDE_NULLS,
    dirty_orders,
    fixed,
    sql_age,
    sql_fixed,
    sql_percent,
    sql_rounded,
    table,
    wide_nulls,
)

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]


def components(df, vector: str, keep: list[str], names: list[str], digits: int = 6):
    """A vector column as one rounded double column per component."""
    parts = vector_to_array(F.col(vector))
    return df.select(*keep, *[fixed(parts[i], digits).alias(n) for i, n in enumerate(names)])


def _norm_sql(norm: str) -> str:
    parts = ", ".join(
        f"coalesce({sql_fixed(f'{c} / nullif({norm}, 0)')}, 0.0) AS {c}" for c in NUMBERS
    )
    return f"SELECT {', '.join(KEYS)}, {parts} FROM lineitem"


@query("normalize_l2", _norm_sql("sqrt(" + " + ".join(f"{c} * {c}" for c in NUMBERS) + ")"))
def _(spark, sf):
    found = vectors.normalize_features(table(spark, sf, "lineitem"), NUMBERS)
    return components(found, "normalized_features", KEYS, NUMBERS)


@query("normalize_l1", _norm_sql("(" + " + ".join(f"abs({c})" for c in NUMBERS) + ")"))
def _(spark, sf):
    found = vectors.normalize_features(table(spark, sf, "lineitem"), NUMBERS, p=1.0)
    return components(found, "normalized_features", KEYS, NUMBERS)


@query(
    "standardize",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}" for c in NUMBERS)
    + f" FROM lineitem) SELECT {', '.join(KEYS)}, "
    + ", ".join(
        f"coalesce({sql_fixed(f'({c} - m_{c}) / nullif(d_{c}, 0)')}, 0.0) AS {c}"
        for c in NUMBERS
    )
    + " FROM lineitem, s",
)
def _(spark, sf):
    found = vectors.standardize_features(table(spark, sf, "lineitem"), NUMBERS)
    return components(found, "standardized_features", KEYS, NUMBERS)


PARTS = [
    "row_completeness",
    "row_accuracy",
    "row_timeliness",
    "dataset_completeness",
    "dataset_timeliness",
]


@query(
    "quality_vector",
    f"{WITH}, d AS (SELECT {FILLED_SHARE} AS dc, {age_of('o_orderdate')} AS dt FROM dirty_orders) "
    f"SELECT o_orderkey, {sql_fixed(f'CAST({FILLED_IN_ROW} AS DOUBLE) / {WIDTH} * 100')} "
    f"AS row_completeness, {sql_fixed(f'CAST({FILLED_IN_ROW} AS DOUBLE) / {WIDTH} * 100')} "
    f"AS row_accuracy, {ROW_AGE} AS row_timeliness, dc AS dataset_completeness, "
    "dt AS dataset_timeliness FROM dirty_orders, d",
)
def _(spark, sf):
    df = dirty_orders(spark, sf)
    names = df.columns
    measured = rows.row_timeliness(
        rows.row_accuracy(rows.row_completeness(df), names), REFERENCE_DATE, names
    )
    dataset = metrics.completeness_dataset(df).select(F.col("value").alias("completeness"))
    fresh = metrics.timeliness_dataset(df, REFERENCE_DATE).select("value").scalar()
    found = vectors.create_feature_vector(
        measured, PARTS[:3], dataset.select("completeness", fresh.alias("timeliness"))
    )
    return components(found, "quality_feature_vector", ["o_orderkey"], PARTS)


@query(
    "vector_stats",
    " UNION ALL ".join(
        f"SELECT {i} AS component, {len(NUMBERS)} AS dimension, count(*) AS count, "
        f"{sql_rounded(f'avg({c})', 6)} AS mean, {sql_rounded(f'stddev_samp({c})', 6)} AS stddev, "
        f"min({c}) AS min, max({c}) AS max FROM lineitem"
        for i, c in enumerate(NUMBERS)
    ),
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(*NUMBERS)
    found = vectors.vector_stats(vectors.assembled(lines, NUMBERS, "v"), "v")
    return found.withColumns({c: rounded(F.col(c), 6) for c in ("mean", "stddev")})


DATASET_PARTS = ["completeness", "accuracy", "consistency", "timeliness"]
VECTOR = [*assess.ROW_FEATURES, *[f"dataset_{m}" for m in DATASET_PARTS]]
_SHARE = sql_fixed(f"CAST({FILLED_IN_ROW} AS DOUBLE) / {WIDTH} * 100")

FULL = (
    f"{WITH}, {COUNTED}, {NUMBERED}, d AS (SELECT {FILLED_SHARE} AS dc, {DISTINCT_SHARE} AS du, "
    f"{age_of('o_orderdate')} AS dt FROM dirty_orders) SELECT {ALL_COLUMNS}, "
    f"{NULLS_IN_ROW} AS null_count, {FILLED_IN_ROW} AS valid_types_count, "
    f"{_SHARE} AS row_completeness, {_SHARE} AS row_accuracy, "
    f"CAST(rn > 1 AS DOUBLE) AS is_duplicate, {ROW_AGE} AS row_timeliness, "
    "dc AS dataset_completeness, dc AS dataset_accuracy, du AS dataset_consistency, "
    "dt AS dataset_timeliness FROM numbered, d"
)


@query("full_pipeline", FULL)
def full_pipeline(spark, sf):
    df = dirty_orders(spark, sf)
    found = assess.assess(df, REFERENCE_DATE).rows
    keep = [*df.columns, "null_count", "valid_types_count"]
    return components(found, "quality_feature_vector", keep, VECTOR)


@query("quick_assessment", f"{WITH}, {COUNTED} {ALL_METRICS}")
def _(spark, sf):
    return assess.quick_assessment(dirty_orders(spark, sf), REFERENCE_DATE)


_WIDE_NULLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in WIDE_COLUMNS)
_WIDE_FILLED = " + ".join(f"count({c})" for c in WIDE_COLUMNS)
_N = len(WIDE_COLUMNS)


@query(
    "wide_assessment",
    f"WITH {WIDE_NULLS}, u AS (SELECT DISTINCT * FROM wide_nulls), d AS (SELECT "
    f"{sql_percent(_WIDE_FILLED, f'count(*) * {_N}')} AS dc, "
    f"{sql_percent('(SELECT count(*) FROM u)', 'count(*)')} AS du, "
    f"{sql_age('max(l_shipdate)')} AS dt FROM wide_nulls), r AS (SELECT *, row_number() OVER ("
    f"PARTITION BY {', '.join(WIDE_COLUMNS)} ORDER BY 1) AS rn, {_WIDE_NULLS} AS nulls FROM wide_nulls) "
    f"SELECT l_orderkey, l_linenumber, "
    f"{sql_fixed(f'CAST({_N} - nulls AS DOUBLE) / {_N} * 100')} AS row_completeness, "
    f"{sql_fixed(f'CAST({_N} - nulls AS DOUBLE) / {_N} * 100')} AS row_accuracy, "
    f"CAST(rn > 1 AS DOUBLE) AS is_duplicate, coalesce({sql_age('l_shipdate')}, 100.0) AS row_timeliness, "
    "dc AS dataset_completeness, dc AS dataset_accuracy, du AS dataset_consistency, "
    "dt AS dataset_timeliness FROM r, d",
)
def _(spark, sf):
    found = assess.assessed_rows(wide_nulls(spark, sf), REFERENCE_DATE)
    return components(found, "quality_feature_vector", ["l_orderkey", "l_linenumber"], VECTOR)
