"""Evaluation of predictions against labels, per group and pooled.

Everything starts from counts per group, label and prediction (or score), combined before the
shuffle. What follows works on those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgauge.functions.cells import cell, percent
from rowgauge.sources.writers import use_shared_folder

# Thresholds of the acceptance gate, names of the pooled group and
# of rows without a group.
MIN_PRECISION = 0.80
MIN_RECALL = 0.75
MIN_F1 = 0.77
POOLED = "combined"
UNNAMED = "(none)"

# The ranking is cut into at least so many squared score ranges, found in two steps of comparisons.
LEAST_STEP = 32


def _zero_safe(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is zero."""
    return F.coalesce(
        part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0)
    )


def outcome_counts(
    scored: DataFrame,
    truth: str,
    predicted: str | None = None,
    score: str | None = None,
    by: str | None = None,
) -> DataFrame:
    """(dataset, truth [, predicted] [, score], n): the one pass over the scored rows.

    What follows works on these counts. Measures taken from the same counts share the pass.
    """
    group = F.lit(POOLED) if by is None else F.coalesce(cell(by).cast("string"), F.lit(UNNAMED))
    keys = {"dataset": group, "truth": cell(truth).cast("int")}
    if predicted is not None:
        keys["predicted"] = cell(predicted).cast("int")
    if score is not None:
        keys["score"] = cell(score).cast("double")
    return (
        scored.select(*[value.alias(name) for name, value in keys.items()])
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _with_pooled(counts: DataFrame, pooled: bool) -> DataFrame:
    """Counts per dataset and, with `pooled`, each once more for the group of all datasets.

    A flag tells that group from a dataset which happens to have its name.
    """
    own = F.struct(F.col("dataset"), F.lit(False).alias("pooled"))
    if not pooled:
        return counts.withColumn("pooled", F.lit(False))
    groups = F.array(own, F.struct(F.lit(POOLED).alias("dataset"), F.lit(True).alias("pooled")))
    rest = [c for c in counts.columns if c != "dataset"]
    return counts.select(F.inline(groups), *rest)


def _kept(counts: DataFrame) -> DataFrame:
    """The counts written once, for measures that read them several times."""
    use_shared_folder(counts.sparkSession)
    return counts.checkpoint()


def confusion_matrix(
    scored: DataFrame, truth: str, predicted: str, by: str | None = None, pooled: bool = False
) -> DataFrame:
    """(dataset, n_samples, n_positive, n_negative, tn, fp, fn, tp); label 1 is positive.

    With `pooled`, a row 'combined' over all datasets is added.
    """
    counts = outcome_counts(scored, truth, predicted, by=by)
    return _confusion(_with_pooled(counts, pooled and by is not None)).drop("pooled")


def _confusion(counts: DataFrame) -> DataFrame:
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    t, p = F.col("truth"), F.col("predicted")
    return counts.groupBy("dataset", "pooled").agg(
        F.sum("n").alias("n_samples"),
        total(t == 1).alias("n_positive"),
        total(t == 0).alias("n_negative"),
        total((t == 0) & (p == 0)).alias("tn"),
        total((t == 0) & (p == 1)).alias("fp"),
        total((t == 1) & (p == 0)).alias("fn"),
        total((t == 1) & (p == 1)).alias("tp"),
    )


def with_binary_metrics(confusion: DataFrame) -> DataFrame:
    """Add precision, recall, f1_score (0 where undefined) and accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.select(
        "*",
        _zero_safe(tp, tp + fp).alias("precision"),
        _zero_safe(tp, tp + fn).alias("recall"),
        _zero_safe(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _zero_safe(tp + tn, F.col("n_samples")).alias("accuracy"),
    )


def binary_metrics(
    scored: DataFrame, truth: str, predicted: str, by: str | None = None, pooled: bool = False
) -> DataFrame:
    return with_binary_metrics(confusion_matrix(scored, truth, predicted, by, pooled))


def weighted_metrics(
    scored: DataFrame, truth: str, predicted: str, by: str | None = None
) -> DataFrame:
    """(dataset, samples, weighted_precision, weighted_recall, weighted_f1) over all classes.

    Each class counts with its share of the labels.
    """
    return _weighted(outcome_counts(scored, truth, predicted, by=by))


def _weighted(counts: DataFrame) -> DataFrame:
    n, t, p = F.col("n"), F.col("truth"), F.col("predicted")
    none = F.lit(0).cast("bigint")
    # Each count speaks for the class it was labeled as and for the class it was predicted as.
    sides = F.array(
        F.struct(
            t.alias("class"), n.alias("labeled"), none.alias("guessed"),
            F.when(t == p, n).otherwise(none).alias("hit"),
        ),
        F.struct(p.alias("class"), none.alias("labeled"), n.alias("guessed"), none.alias("hit")),
    )
    per_class = (
        counts.select("dataset", F.inline(sides))
        .groupBy("dataset", "class")
        .agg(*[F.sum(c).alias(c) for c in ("labeled", "guessed", "hit")])
    )
    labeled, guessed, hit = (F.col(c) for c in ("labeled", "guessed", "hit"))

    def mean(measure: Column) -> Column:
        return _zero_safe(F.sum(measure * labeled), F.sum(labeled))

    return per_class.groupBy("dataset").agg(
        F.sum("labeled").alias("samples"),
        mean(_zero_safe(hit, guessed)).alias("weighted_precision"),
        mean(_zero_safe(hit, labeled)).alias("weighted_recall"),
        mean(_zero_safe(2 * hit, guessed + labeled)).alias("weighted_f1"),
    )


def auc_roc(
    scored: DataFrame, truth: str, score: str, by: str | None = None, pooled: bool = False
) -> DataFrame:
    """(dataset, auc_roc): exact area under the ROC curve, ties counting half; 0.0 if undefined.

    The area is the share of (positive, negative) pairs ranked the right way round. Scores are
    counted, then cut into ranges at quantiles of the counted scores, at least as many as there are
    shuffle partitions. Pairs within a range come from a running sum inside the range, pairs across
    ranges from the range totals. So no task orders more than one range of one dataset, and where
    the cuts fall does not change the sum. Runs a job: the counts are written once.
    """
    counts = _kept(outcome_counts(scored, truth, score=score, by=by))
    return _area(_with_pooled(counts, pooled and by is not None)).drop("pooled")


def _area(outcomes: DataFrame) -> DataFrame:
    # Rows without a score or label count as nothing.
    n = F.when(F.col("score").isNotNull(), F.col("n"))
    counts = outcomes.groupBy("dataset", "pooled", "score").agg(
        F.coalesce(F.sum(F.when(F.col("truth") == 1, n)), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col("truth") == 0, n)), F.lit(0)).alias("neg"),
    )
    partitions = int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(LEAST_STEP, math.ceil(math.sqrt(partitions)))
    # One text literal instead of a thousand number literals keeps the plan small.
    fractions = F.split(
        F.lit(" ".join(str(i / step**2) for i in range(1, step**2))), " "
    ).cast("array<double>")
    cuts = outcomes.agg(F.percentile_approx("score", fractions, 4 * step**2).alias("fine")).select(
        F.struct(
            "fine",
            F.filter("fine", lambda _, i: i % step == step - 1).alias("coarse"),
        )
    ).scalar()

    def reached(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda bound: bound <= F.col("score")))

    ranged = (
        counts.select("*", cuts["fine"].alias("fine"), cuts["coarse"].alias("coarse"))
        .withColumn("step", reached(F.col("coarse")) * step)
        .withColumn(
            "range",
            F.col("step") + reached(F.slice("fine", F.col("step") + 1, F.lit(step))),
        )
        .drop("fine", "coarse", "step")
    )

    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    in_range = Window.partitionBy("dataset", "pooled", "range").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1
    )
    below = F.coalesce(F.sum(neg).over(in_range), F.lit(0.0))
    totals = (
        ranged.withColumn("pairs", pos * (below + neg / 2))
        .groupBy("dataset", "pooled", "range")
        .agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"), F.sum("pairs").alias("pairs"))
    )
    # At most step * step rows per dataset from here on.
    across = Window.partitionBy("dataset", "pooled").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    below_range = F.coalesce(F.sum("neg").over(across), F.lit(0.0))
    return (
        totals.withColumn("pairs", F.col("pairs") + F.col("pos") * below_range)
        .groupBy("dataset", "pooled")
        .agg(_zero_safe(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("auc_roc"))
    )


def evaluate(
    scored: DataFrame,
    truth: str,
    predicted: str,
    score: str,
    by: str | None = None,
    pooled: bool = True,
) -> DataFrame:
    """Confusion counts, binary metrics and AUC per dataset, and pooled as 'combined'.

    One pass over the scored rows, run at once; its counts are written and all measures read them.
    """
    counts = _with_pooled(_kept(outcome_counts(scored, truth, predicted, score, by)), pooled and by is not None)
    # One row per dataset on both sides.
    both = with_binary_metrics(_confusion(counts)).join(_area(counts), ["dataset", "pooled"])
    return both.drop("pooled")


def evaluate_weighted(
    scored: DataFrame, truth: str, predicted: str, score: str, by: str | None = None
) -> DataFrame:
    """(dataset, samples, weighted metrics, auc_roc, accepted), from one pass, run at once, as well."""
    return evaluate_counts(kept_counts(scored, truth, predicted, score, by))


def kept_counts(
    scored: DataFrame, truth: str, predicted: str, score: str, by: str | None = None
) -> DataFrame:
    """Outcome counts written at once, so that what scored the rows is needed no more."""
    return _kept(outcome_counts(scored, truth, predicted, score, by))


def evaluate_counts(counts: DataFrame) -> DataFrame:
    """evaluate_weighted from kept counts, or from a union of them over different datasets."""
    area = _area(_with_pooled(counts, False)).drop("pooled")
    return acceptance_gate(_weighted(counts).join(area, "dataset"))


def evaluation_summary(evaluation: DataFrame) -> DataFrame:
    """Shares of high and low labels and one pass flag per threshold."""
    return evaluation.select(
        "dataset",
        "n_samples",
        percent(F.col("n_positive"), F.col("n_samples")).alias("high_percentage"),
        percent(F.col("n_negative"), F.col("n_samples")).alias("low_percentage"),
        "precision",
        "recall",
        "f1_score",
        "accuracy",
        (F.col("precision") >= MIN_PRECISION).alias("precision_ok"),
        (F.col("recall") >= MIN_RECALL).alias("recall_ok"),
        (F.col("f1_score") >= MIN_F1).alias("f1_ok"),
    )


def acceptance_gate(
    metrics: DataFrame,
    precision: str = "weighted_precision",
    recall: str = "weighted_recall",
    f1: str = "weighted_f1",
) -> DataFrame:
    """Add `accepted`: all three thresholds are met."""
    return metrics.withColumn(
        "accepted",
        (cell(precision) >= MIN_PRECISION)
        & (cell(recall) >= MIN_RECALL)
        & (cell(f1) >= MIN_F1),
    )


def union_datasets(frames: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Stack labeled tables by column name, missing columns null, with the table's name."""
    stacked = None
    for label, frame in frames.items():
        named = frame.withColumn(name, F.lit(label))
        stacked = (
            named if stacked is None else stacked.unionByName(named, allowMissingColumns=True)
        )
    if stacked is None:
        raise ValueError("at least one table is needed")
    return stacked
