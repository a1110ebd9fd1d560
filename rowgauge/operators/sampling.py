"""Strata, stratified samples, resampling, splits and folds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgauge.functions.cells import cell, percent, quoted, ratio
from rowgauge.functions.draws import DRAWS, digest, digest_of, draw, drawn_index

# Sample columns of a labeling template.
LABEL_DIMENSIONS = ["completeness", "consistency", "validity", "accuracy"]
LABEL_COLUMN = "final_label"

# Length of the digest prefix that numbers buckets.
BUCKET_CHARS = 4


def monthly_strata(df: DataFrame, moment: str, output: str = "month") -> DataFrame:
    """Add the calendar month as a stratum."""
    return df.withColumn(output, F.date_trunc("month", cell(moment)).cast("date"))


def strata_counts(df: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n) of the non-null strata; combined before the shuffle."""
    return df.filter(cell(stratum).isNotNull()).groupBy(quoted(stratum)).agg(
        F.count(F.lit(1)).alias("n")
    )


def strata_profile(df: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n, share): frequency and share of the rows that have a stratum."""
    counts = strata_counts(df, stratum)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(quoted(stratum), "n", ratio(F.col("n"), total).alias("share"))


def strata_summary(df: DataFrame, stratum: str, moment: str) -> DataFrame:
    """One row: (strata, first, last): number of strata and range of a date column."""
    per_stratum = df.groupBy(quoted(stratum)).agg(
        F.min(cell(moment)).alias("first"), F.max(cell(moment)).alias("last")
    )
    return per_stratum.agg(
        F.count(cell(stratum)).alias("strata"), F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def rare_strata(df: DataFrame, stratum: str, minimum: int = 5) -> DataFrame:
    """(stratum, n, share) of the strata whose share is below minimum / all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    limit = ratio(F.lit(minimum), total)
    return strata_profile(df, stratum).filter(F.col("share") < limit)


def top_strata(df: DataFrame, stratum: str, k: int = 10) -> DataFrame:
    """The k most frequent strata, ties in stratum order."""
    return strata_counts(df, stratum).orderBy(F.desc("n"), cell(stratum)).limit(k)


def _row_digest(df: DataFrame, key: str, purpose: str, seed: int) -> Column:
    """The key's digest; rows without a key are told apart by what they hold."""
    whole = digest_of(F.to_json(F.struct(*[cell(n) for n in df.columns])), f"{purpose}:row", seed)
    return F.when(cell(key).isNull(), whole).otherwise(digest(key, purpose, seed))


def stratified_sample(
    df: DataFrame, stratum: str, key: str, total: int, seed: int = 42
) -> DataFrame:
    """Proportional sample without replacement: max(1, floor(total * share)) rows a stratum.

    A stratum's rows are taken in digest order. One pass counts them per stratum and digest prefix,
    which tells the prefix at which the quota is reached. Rows beyond it are dropped where they are
    read in the second pass; the others are ranked within their prefix, so a task sorts a 65,536th
    of a stratum whatever the quota. Lazy, and one plan for any number of strata and any size.

    Rows without a stratum are left out. Rows without a key take part like any other, in an order
    of their own; those that are equal in all columns are interchangeable.
    """
    marked = df.filter(cell(stratum).isNotNull()).withColumn(
        "__digest", _row_digest(df, key, "sample", seed)
    ).withColumn("__prefix", F.substring("__digest", 1, BUCKET_CHARS))
    sizes = (
        marked.select(cell(stratum).alias("__stratum"), "__prefix")
        .groupBy("__stratum", "__prefix").agg(F.count(F.lit(1)).alias("__size"))
    )
    before = Window.partitionBy("__stratum").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    everything = F.sum("__size").over(Window.partitionBy("__stratum"))
    quota = F.greatest(
        F.lit(1),
        F.floor(F.lit(total) * ratio(F.col("__all"), strata_counts(df, stratum).agg(F.sum("n")).scalar())),
    )
    cuts = (
        sizes.select(
            "__stratum", "__prefix", "__size", everything.alias("__all"),
            F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"),
        )
        .withColumn("__quota", quota)
        .filter((F.col("__before") < F.col("__quota")) & (F.col("__before") + F.col("__size") >= F.least("__quota", "__all")))
        .select("__stratum", F.col("__prefix").alias("__cut"), (F.col("__quota") - F.col("__before")).alias("__left"))
    )
    inside = Window.partitionBy("__stratum", "__prefix").orderBy("__digest", cell(key))
    return (
        marked.join(cuts, cell(stratum) == F.col("__stratum"))
        .filter(F.col("__prefix") <= F.col("__cut"))
        .withColumn("__rank", F.row_number().over(inside))
        .filter((F.col("__prefix") < F.col("__cut")) | (F.col("__rank") <= F.col("__left")))
        .select(*[cell(n) for n in df.columns])
    )


def numbered(df: DataFrame, key: str, seed: int = 42, output: str = "row_index") -> DataFrame:
    """Number all rows 0..N-1 in digest order without sorting them in one task.

    Digests are uniform, so their first characters cut any table into even buckets. A row's
    number is its place in its bucket plus the sizes of the buckets before. There are at most
    16**BUCKET_CHARS buckets whatever the table's size, so their offsets are safe to broadcast.
    `key` should identify the row; rows without a key are numbered as well.
    """
    order = _row_digest(df, key, "order", seed)
    bucket = F.substring(order, 1, BUCKET_CHARS).alias("__bucket")
    sizes = df.select(bucket).groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy("__bucket").orderBy("__digest", cell(key))
    return (
        df.select("*", bucket, order.alias("__digest"))
        .withColumn("__place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__bucket")
        .select(
            *[cell(n) for n in df.columns],
            (F.col("__offset") + F.col("__place") - 1).alias(output),
        )
    )


def bootstrap_resample(sample: DataFrame, key: str, total: int, seed: int = 42) -> DataFrame:
    """Exactly `total` rows drawn from the sample with replacement; empty if the sample is.

    Adds `draw`, the number of the draw.
    """
    indexed = numbered(sample, key, seed)
    size = sample.agg(F.count(F.lit(1))).scalar()
    draws = sample.sparkSession.range(total).select(
        F.col("id").alias("draw"),
        drawn_index(F.col("id"), F.nullif(size, F.lit(0)), seed).alias("row_index"),
    )
    return draws.join(indexed, "row_index").select("draw", *[cell(n) for n in sample.columns])


def exact_size_sample(
    df: DataFrame, stratum: str, key: str, total: int, seed: int = 42
) -> DataFrame:
    """Stratified sample, redrawn with replacement where its size is not `total`.

    Counts the sample first: one action.
    """
    sample = stratified_sample(df, stratum, key, total, seed)
    if sample.count() == total:
        return sample
    return bootstrap_resample(sample, key, total, seed).drop("draw")


def label_template(df: DataFrame, key: str, context: Iterable[str] = ()) -> DataFrame:
    """Key and context columns, then empty label dimensions, label and notes."""
    empty = [F.lit(None).cast("int").alias(d) for d in [*LABEL_DIMENSIONS, LABEL_COLUMN]]
    return df.select(
        cell(key), *[cell(c) for c in context], *empty, F.lit(None).cast("string").alias("notes")
    )


def split_mark(key: str, train: float = 0.8, seed: int = 42) -> Column:
    """'train' or 'test' by the key's draw: no shuffle, stable under repartitioning."""
    limit = int(train * DRAWS)
    return F.when(draw(key, "split", seed) < limit, "train").otherwise("test")


def train_test_split(
    df: DataFrame, key: str, train: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    mark = split_mark(key, train, seed)
    return df.filter(mark == "train"), df.filter(mark == "test")


def random_split(
    df: DataFrame, train: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Row-wise random split for tables without a key."""
    first, second = df.randomSplit([train, 1 - train], seed)
    return first, second


def assign_folds(
    df: DataFrame, key: str, folds: int = 5, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Add `fold_id` 1..folds: by the key's draw, or with sizes equal within one row.

    The first form is a projection. The exact form numbers the rows and needs a shuffle.
    """
    if not exact:
        return df.withColumn("fold_id", (F.pmod(draw(key, "fold", seed), F.lit(folds)) + 1).cast("int"))
    placed = numbered(df, key, seed, "__index")
    return placed.withColumn(
        "fold_id", (F.pmod(F.col("__index") + 1, F.lit(folds)) + 1).cast("int")
    ).drop("__index")


def label_distribution(df: DataFrame, label: str = "ground_truth") -> DataFrame:
    """(label, n, percentage)."""
    counts = df.groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(quoted(label), "n", percent(F.col("n"), total).alias("percentage"))
