"""Record-quality classifier: a Random Forest over scaled features.

Text codes, scaling and forest are fitted on training data together, so new data is encoded and scaled
as the training data was.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from rowgauge.functions.cells import cell
from rowgauge.operators.encode import TextEncoder, fit_text
from rowgauge.operators.evaluate import evaluate_counts, evaluate_weighted, kept_counts
from rowgauge.operators.sampling import assign_folds, numbered
from rowgauge.operators.schema import numeric_features
from rowgauge.sources.writers import use_shared_folder

# Forest settings, and columns that are never features.
NUM_TREES = 100
MAX_DEPTH = 15
SEED = 42
FOLDS = 5
TOP_FEATURES = 10
NOT_FEATURES = ["row_id", "ground_truth", "dataset", "split", "fold_id"]

#: Rows that a task of a forest holds at most.
ROWS_A_TASK = 200_000

# Plain name of the target while fitting, whatever it is called.
_LABEL = "__label"


def feature_columns(
    df: DataFrame, target: str = "ground_truth", exclude: Iterable[str] = ()
) -> list[str]:
    """All columns but the target, bookkeeping columns and those to exclude.

    Exclude what the label was computed from, or the model only learns the rule.
    """
    left_out = {target, *NOT_FEATURES, *exclude}
    return [c for c in df.columns if c not in left_out]


def _plain(features: list[str]) -> list[str]:
    return [f"__feature_{i}" for i in range(len(features))]


def _copied(df: DataFrame, features: list[str], keep: Iterable[Column]) -> DataFrame:
    """The columns to keep, and the features under plain names."""
    return df.select(*keep, *[cell(c).alias(a) for c, a in zip(features, _plain(features))])


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt evenly over as many tasks as there are cores, and over more if there are many.

    In every level each task of a fit sends the sums of all nodes, whatever its rows, so tasks by the
    size of the input would cost tasks times nodes. Predictions cost far more than a row's bytes tell,
    so joins of narrow rows would leave them to a task or two.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def _stages(features: list[str]) -> list:
    # Rows with NaN in a feature are skipped in training; predictions take NaN as 0.0.
    return [
        VectorAssembler(
            inputCols=_plain(features), outputCol="features", handleInvalid="skip"
        ),
        StandardScaler(
            inputCol="features", outputCol="scaled_features", withMean=True, withStd=True
        ),
    ]


def prepare_features(
    df: DataFrame, target: str = "ground_truth", exclude: Iterable[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Rows with `features` and `scaled_features`, and the feature names in vector order.

    Text columns have codes, or out-of-fold means of the target (see `encode.fit_text`). Runs jobs.
    """
    features = feature_columns(df, target, exclude)
    copies = _copied(df, features, [cell(c) for c in df.columns])
    text = fit_text(copies, _plain(features), target if target in df.columns else None)
    prepared = numeric_features(text.apply(copies, training=True), _plain(features))
    model = Pipeline(stages=_stages(features)).fit(prepared)
    return model.transform(prepared).drop(*_plain(features)), features


@dataclass(frozen=True)
class RecordClassifier:
    """A fitted pipeline, the features it takes and the column it predicts."""

    model: PipelineModel
    features: list[str]
    target: str
    text: TextEncoder

    def predict(self, df: DataFrame) -> DataFrame:
        """Every input row with `prediction` (0/1) and `score`, the probability of 1."""
        plain = _plain(self.features)
        copies = _copied(df, self.features, [cell(c) for c in df.columns])
        numbers = numeric_features(self.text.apply(copies), plain)
        scored = self.model.transform(numbers.withColumns({c: F.nanvl(c, F.lit(0.0)) for c in plain}))
        return scored.select(
            *[cell(c) for c in df.columns],
            F.col("prediction").cast("int").alias("prediction"),
            F.get(vector_to_array("probability"), F.lit(1)).alias("score"),
        )

    def evaluate(self, df: DataFrame) -> DataFrame:
        """One row: weighted metrics, AUC, sample count and the acceptance gate."""
        return evaluate_weighted(self.predict(df), self.target, "prediction", "score")

    def importance(self, top: int = TOP_FEATURES) -> DataFrame:
        """(feature, importance), highest first. The model holds one number per feature."""
        weights = self.model.stages[-1].featureImportances.toArray()
        spark = SparkSession.active()
        rows = [(name, float(weight)) for name, weight in zip(self.features, weights)]
        ranked = spark.createDataFrame(rows, "feature string, importance double")
        return ranked.orderBy(F.desc("importance"), "feature").limit(top)


def train_random_forest(
    df: DataFrame,
    target: str = "ground_truth",
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
    exclude: Iterable[str] = (),
    persist: bool = True,
) -> RecordClassifier:
    """Fit text codes, scaler and forest on the rows that have a label.

    Rows are kept in memory and on disk while they are encoded, unless `persist` is off, for input that
    is kept already. Encoded, they are dealt over the cores and written to the shared folder once, as
    fitting passes over them several times. The node that a row has come to in each tree is kept:
    without, every level would walk every row down all trees from their roots.
    """
    use_shared_folder(df.sparkSession)
    features = feature_columns(df, target, exclude)
    copies = _copied(
        df.filter(cell(target).isNotNull()), features, [cell(target).cast("double").alias(_LABEL)]
    )
    forest = RandomForestClassifier(
        featuresCol="scaled_features",
        labelCol=_LABEL,
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        cacheNodeIds=True,
    )
    if persist:
        # The encoder reads the rows as well, before they are encoded.
        copies.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        text = fit_text(copies, _plain(features), _LABEL)
        labeled = numeric_features(text.apply(copies, training=True), _plain(features))
        dealt = _dealt(labeled, copies.count()).checkpoint()
    finally:
        if persist:
            copies.unpersist()
    model = Pipeline(stages=[*_stages(features), forest]).fit(dealt)
    return RecordClassifier(model, features, target, text)


def cross_validate(
    df: DataFrame,
    key: str,
    target: str = "ground_truth",
    folds: int = FOLDS,
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """(metric, mean, stddev, folds): each fold predicted by a model of the other folds.

    Folds come from the key, so they are the same in every pass. The key is no feature. Text is
    encoded by each model's own training rows. The rows are kept in memory and on disk while the
    models are fitted; counts of each fold's outcomes are written before the next model is fitted, so
    that one model is held at a time, and evaluated together.
    """
    features = feature_columns(df, target, [key, *exclude])
    labeled = df.filter(cell(target).isNotNull())
    folded = assign_folds(labeled, key, folds, seed).select(
        *[cell(c) for c in features], cell(target), "fold_id"
    )
    prepared = folded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = []
        for fold in range(1, folds + 1):
            fitted = train_random_forest(
                prepared.filter(F.col("fold_id") != fold),
                target,
                num_trees,
                max_depth,
                seed,
                persist=False,
            )
            held_out = prepared.filter(F.col("fold_id") == fold)
            counts.append(
                kept_counts(fitted.predict(held_out), target, "prediction", "score", "fold_id")
            )
        scores = evaluate_counts(reduce(DataFrame.unionAll, counts))
        names = ["f1_score", "precision", "recall", "auc_roc"]
        columns = ["weighted_f1", "weighted_precision", "weighted_recall", "auc_roc"]
        rows = F.array(
            *[
                F.struct(F.lit(n).alias("metric"), F.col(c).alias("value"))
                for n, c in zip(names, columns)
            ]
        )
        summary = (
            scores.select(F.inline(rows))
            .groupBy("metric")
            .agg(
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("stddev"),
                F.count("value").alias("folds"),
            )
            .collect()
        )
    finally:
        prepared.unpersist()
    # Four rows of scalars.
    return df.sparkSession.createDataFrame(
        summary, "metric string, mean double, stddev double, folds bigint"
    )


def permutation_importance(
    model: RecordClassifier, df: DataFrame, key: str, seed: int = SEED
) -> DataFrame:
    """(feature, samples, accuracy, permuted_accuracy, importance): what each feature is worth on `df`.

    `importance` is the accuracy on these rows less that with the feature's values dealt to other
    rows; the rows should be held out from training. Rows are placed once in a seeded random order of
    `key`, and each feature's values move on by a seeded number of places of its own, so the outcome
    does not depend on partitioning. Every row is predicted in one pass, as it is and once for each
    feature. Text is permuted as the numbers that the model takes it for.

    Rows without a label take no part; without any labeled row the measures are null. Rows without a
    key are placed by what they hold. Vector columns raise ValueError. Runs jobs: the rows as numbers
    are written once, and counted.
    """
    use_shared_folder(df.sparkSession)
    features, plain = model.features, _plain(model.features)
    vectors = [c for c in features if isinstance(df.schema[c].dataType, T.UserDefinedType)]
    if vectors:
        raise ValueError(f"vector columns cannot be permuted: {vectors}")
    keep = [cell(key).alias("__key"), cell(model.target).cast("int").alias(_LABEL)]
    copies = _copied(df.filter(cell(model.target).isNotNull()), features, keep)
    values = F.array(*[F.nanvl(c, F.lit(0.0)) for c in plain])
    numbers = numeric_features(model.text.apply(copies), plain).select("__key", _LABEL, values.alias("__own")).checkpoint()
    placed = numbered(numbers, "__key", seed, "__place")

    rows = numbers.agg(F.count(F.lit(1))).scalar()
    steps = F.array(*[F.xxhash64(F.lit(name), F.lit(seed)) for name in features])
    step = 1 + F.pmod(F.get(steps, F.col("__feature")), F.greatest(rows - 1, F.lit(1)))
    moved = (
        placed.select("__place", F.posexplode("__own").alias("__feature", "__value"))
        .select(F.pmod(F.col("__place") + step, rows).alias("__place"), F.struct("__feature", "__value").alias("__given"))
        # One value of each feature comes to a place.
        .groupBy("__place").agg(F.array_sort(F.collect_list("__given"))["__value"].alias("__other"))
    )

    def replaced(feature: Column) -> Column:
        return F.transform(
            "__own", lambda x, i: F.when(i == feature, F.get(F.col("__other"), i)).otherwise(x)
        )

    variants = F.transform(F.sequence(F.lit(-1), F.lit(len(features) - 1)), replaced)
    dealt = _dealt(placed.join(moved, "__place").select(_LABEL, "__own", "__other"), numbers.count())
    trials = dealt.select(_LABEL, F.posexplode(variants).alias("__trial", "__values"))
    scored = model.model.transform(
        trials.select(_LABEL, "__trial", *[F.get("__values", F.lit(i)).alias(c) for i, c in enumerate(plain)])
    )
    right = F.avg((F.col("prediction") == F.col(_LABEL)).cast("double"))
    # One entry a feature and one for the rows as they are.
    found = (
        scored.groupBy("__trial").agg(F.count(F.lit(1)).alias("samples"), right.alias("accuracy"))
        .agg(F.map_from_entries(F.collect_list(F.struct("__trial", "accuracy"))).alias("of"), F.max("samples").alias("samples"))
    )
    base = F.try_element_at("of", F.lit(0))
    report = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), F.try_element_at("of", F.lit(i + 1)).alias("permuted_accuracy"))
            for i, name in enumerate(features)
        ]
    )
    return found.select(
        F.coalesce("samples", F.lit(0)).alias("samples"), base.alias("accuracy"), F.inline(report)
    ).select(
        "feature", "samples", "accuracy", "permuted_accuracy",
        (F.col("accuracy") - F.col("permuted_accuracy")).alias("importance"),
    )
