"""Human labels: the label rule, checks of a label table, joins, and correlation ranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell, is_numeric, percent, rounded
from rowgauge.operators.sampling import LABEL_COLUMN, LABEL_DIMENSIONS

# Passing dimensions needed for label 1.
PASSES_NEEDED = 3

_LABELS = [*LABEL_DIMENSIONS, LABEL_COLUMN]


def _number(name: str) -> Column:
    """A label as a number; null where it cannot be read as one, such as text in a CSV column."""
    return cell(name).try_cast("double")


def _not_zero_or_one(name: str) -> Column:
    """A value that is there and is neither 0 nor 1."""
    return cell(name).isNotNull() & ~F.coalesce(_number(name).isin(0.0, 1.0), F.lit(False))


def passes(dimensions: Iterable[str] = LABEL_DIMENSIONS) -> Column:
    total = F.lit(0)
    for name in dimensions:
        total = total + F.coalesce(_number(name), F.lit(0.0))
    return total


def rule_label() -> Column:
    """1 when at least three of the four dimensions pass, else 0."""
    return F.when(passes() >= PASSES_NEEDED, 1).otherwise(0)


def label_rule(df: DataFrame) -> DataFrame:
    """Add `passing_count` and `expected_label`."""
    return df.select(
        "*", passes().cast("int").alias("passing_count"), rule_label().alias("expected_label")
    )


def _breaks_rule() -> Column:
    return F.coalesce(_number(LABEL_COLUMN) != rule_label(), F.lit(True))


def verify_labels(
    labels: DataFrame, key: str, expected_rows: int | None = None
) -> DataFrame:
    """All checks of a label table as rows (check, status, violations); one aggregate.

    Row count, required columns, nulls and values per label column, and the label rule. Values that
    are no number, as a file read as text may hold, are violations. Checks that need a missing
    column are reported as 'skipped'.
    """
    required = [key, *_LABELS]
    missing = [c for c in required if c not in labels.columns]
    checks: list[tuple[str, Column | None]] = []
    surplus = F.lit(0) if expected_rows is None else F.abs(F.count(F.lit(1)) - expected_rows)
    checks.append(("row_count", surplus))
    checks.append(("required_columns", F.lit(len(missing))))
    for name in _LABELS:
        present = name in labels.columns
        checks.append((f"no_nulls:{name}", F.count(F.when(cell(name).isNull(), 1)) if present else None))
    for name in _LABELS:
        present = name in labels.columns
        checks.append(
            (f"zero_or_one:{name}", F.count(F.when(_not_zero_or_one(name), 1)) if present else None)
        )
    rule = None if any(c in missing for c in _LABELS) else F.count(F.when(_breaks_rule(), 1))
    checks.append(("label_rule", rule))

    aggregates = [
        (F.lit(None) if check is None else check).cast("bigint").alias(f"v{i}")
        for i, (_, check) in enumerate(checks)
    ]
    rows = [
        F.struct(F.lit(name).alias("check"), F.col(f"v{i}").alias("violations"))
        for i, (name, _) in enumerate(checks)
    ]
    status = (
        F.when(F.col("violations").isNull(), "skipped")
        .when(F.col("violations") == 0, "pass")
        .otherwise("fail")
    )
    return (
        labels.agg(F.count(F.lit(1)).alias("__n"), *aggregates)
        .select(F.inline(F.array(*rows)))
        .select("check", status.alias("status"), "violations")
    )


def label_violations(labels: DataFrame) -> DataFrame:
    """Rows with a null or a value outside 0/1 in a label column, or a label off the rule."""
    bad_value = F.lit(False)
    for name in _LABELS:
        bad_value = bad_value | cell(name).isNull() | _not_zero_or_one(name)
    return label_rule(labels).filter(bad_value | _breaks_rule())


def dimension_pass_rates(
    labels: DataFrame, dimensions: Iterable[str] = LABEL_DIMENSIONS
) -> DataFrame:
    """(dimension, passed, total, percentage); one aggregate."""
    names = list(dimensions)
    counts = [F.count(F.when(_number(d) == 1, 1)).alias(f"p{i}") for i, d in enumerate(names)]
    rows = [
        F.struct(F.lit(d).alias("dimension"), F.col(f"p{i}").alias("passed"), F.col("total"))
        for i, d in enumerate(names)
    ]
    return (
        labels.agg(F.count(F.lit(1)).alias("total"), *counts)
        .select(F.inline(F.array(*rows)))
        .select("*", percent(F.col("passed"), F.col("total")).alias("percentage"))
    )


def label_join(
    raw: DataFrame, labels: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Inner join on the key; other columns both sides have get the suffixes.

    No broadcast is forced: Spark broadcasts the labels while their measured size allows and
    otherwise shuffles, splitting a hot key's partition. Repeated label keys repeat rows.
    """
    shared = {c for c in raw.columns if c in labels.columns and c != key}
    left = raw.select(*[cell(c).alias(c + suffixes[0]) if c in shared else cell(c) for c in raw.columns])
    right = labels.select(
        *[cell(c).alias(c + suffixes[1]) if c in shared else cell(c) for c in labels.columns]
    )
    return left.join(right, key)


def correlation_importance(
    df: DataFrame, label: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """(feature, correlation, importance) of the numeric columns; one aggregate.

    Features without variance have no correlation and importance 0.
    """
    names = [
        f.name
        for f in df.schema.fields
        if f.name != label and is_numeric(f.dataType) and (columns is None or f.name in columns)
    ]
    if not names:
        raise ValueError("no numeric feature column")
    target = cell(label).cast("double")

    def correlation(name: str) -> Column:
        # corr() itself fails on a constant column under ANSI; this gives null.
        x = F.when(target.isNotNull(), cell(name).cast("double"))
        y = F.when(x.isNotNull(), target)
        return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))

    found = [correlation(n).alias(f"c{i}") for i, n in enumerate(names)]
    rows = [
        F.struct(F.lit(n).alias("feature"), F.col(f"c{i}").alias("correlation"))
        for i, n in enumerate(names)
    ]
    return (
        df.agg(*found)
        .select(F.inline(F.array(*rows)))
        .select(
            "feature",
            rounded(F.col("correlation"), 6).alias("correlation"),
            F.coalesce(rounded(F.abs("correlation"), 6), F.lit(0.0)).alias("importance"),
        )
        .orderBy(F.desc("importance"), "feature")
    )


def association_importance(
    df: DataFrame, label: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """(feature, kind, association, importance) of the numeric and the text columns.

    Numeric columns have their correlation with the label. Text columns have the correlation ratio:
    the root of the share of the label's variance that lies between values; for a label of two
    classes this is Cramer's V. Rows in which label or value is null are left out. A column whose
    label does not vary has no association and importance 0; empty text is a value. All text columns
    share one aggregate by column and value, combined before the shuffle, and a second one by column.
    """
    wanted = [f for f in df.schema.fields if f.name != label and (columns is None or f.name in columns)]
    texts = [f.name for f in wanted if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in wanted if is_numeric(f.dataType)]
    if not texts and not numbers:
        raise ValueError("no numeric or text feature column")
    found = None
    if numbers:
        found = correlation_importance(df, label, numbers).select(
            "feature", F.lit("numeric").alias("kind"), F.col("correlation").alias("association"), "importance"
        )
    if texts:
        y = F.col("y")
        values = df.select(
            cell(label).cast("double").alias("y"),
            F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), cell(c).alias("value")) for c in texts])).alias("x"),
        ).where("y IS NOT NULL AND x.value IS NOT NULL")
        groups = values.groupBy("x.feature", "x.value").agg(
            F.count(F.lit(1)).alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares")
        )
        mean = F.pow(F.sum("total"), 2) / F.sum("n")
        between = F.sum(F.pow("total", 2) / F.col("n")) - mean
        whole = F.sum("squares") - mean
        ratio = F.sqrt(F.greatest(F.lit(0.0), between) / F.nullif(whole, F.lit(0.0)))
        # Columns without a single pair of values are there too.
        names = df.sparkSession.createDataFrame([(c,) for c in texts], "feature string")
        measured = names.join(groups.groupBy("feature").agg(ratio.alias("ratio")), "feature", "left").select(
            "feature", F.lit("text").alias("kind"), rounded(F.col("ratio"), 6).alias("association"),
            F.coalesce(rounded(F.col("ratio"), 6), F.lit(0.0)).alias("importance"),
        )
        found = measured if found is None else found.unionByName(measured)
    return found.orderBy(F.desc("importance"), "feature")


def feature_kinds(df: DataFrame, label: str) -> dict[str, int]:
    """Number of features in all, numeric and categorical; from the schema alone."""
    features = [f for f in df.schema.fields if f.name != label]
    numeric = sum(is_numeric(f.dataType) for f in features)
    return {
        "n_total_features": len(features),
        "n_numeric": numeric,
        "n_categorical": len(features) - numeric,
    }
