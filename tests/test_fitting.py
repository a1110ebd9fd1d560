"""What fitting reads, keeps and holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgauge.operators import classifier


def _rows(spark, n=300):
    y = (F.col("id") % 3 == 0).cast("int")
    return spark.range(n).select(
        "id", (F.col("id") % 17 + 5 * y).cast("double").alias("number"),
        F.when(F.col("id") % 4 == 0, "none").when(y == 1, "yes").otherwise("no").alias("text"), y.alias("ground_truth"),
    )


def _counted(spark, rows):
    """The rows, and an accumulator of how many were made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(x):
        made.add(1)
        return x

    return rows.withColumn("text", count("text")), made


def test_training_makes_the_rows_once(spark):
    rows, made = _counted(spark, _rows(spark))
    classifier.train_random_forest(rows, num_trees=3, max_depth=3, exclude=["id"])
    assert made.value == 300


def test_permutation_makes_the_rows_once(spark):
    model = classifier.train_random_forest(_rows(spark), num_trees=3, max_depth=3, exclude=["id"])
    rows, made = _counted(spark, _rows(spark))
    assert classifier.permutation_importance(model, rows, "id").count() == 2
    assert made.value == 300


def test_node_of_every_row_is_kept(spark):
    model = classifier.train_random_forest(_rows(spark), num_trees=3, max_depth=3, exclude=["id"])
    assert model.model.stages[-1].getCacheNodeIds()


def test_cross_validation_writes_the_counts_of_each_fold(spark, monkeypatch):
    """Counts are written while only that fold's model is held, and cover every row once."""
    written = []

    def kept(*args, of=classifier.kept_counts):
        written.append(of(*args))
        return written[-1]

    monkeypatch.setattr(classifier, "kept_counts", kept)
    found = classifier.cross_validate(_rows(spark), "id", folds=3, num_trees=3, max_depth=3).collect()
    assert {r.metric: r.folds for r in found} == {"f1_score": 3, "precision": 3, "recall": 3, "auc_roc": 3}
    sums = [{(r.dataset): r.n for r in c.groupBy("dataset").agg(F.sum("n").alias("n")).collect()} for c in written]
    assert [len(s) for s in sums] == [1, 1, 1] and sum(sum(s.values()) for s in sums) == 300


def test_forest_is_fitted_in_as_many_tasks_as_cores(spark, monkeypatch):
    tasks = []

    def fit(self, df, of=classifier.Pipeline.fit):
        tasks.append([len(part) for part in df.rdd.glom().collect()])
        return of(self, df)

    monkeypatch.setattr(classifier.Pipeline, "fit", fit)
    rows = _rows(spark).repartition(40)
    for persist in (True, False):
        classifier.train_random_forest(rows, num_trees=3, max_depth=3, exclude=["id"], persist=persist)
    cores = spark.sparkContext.defaultParallelism
    assert [len(parts) for parts in tasks] == [cores, cores]
    monkeypatch.setattr(classifier, "ROWS_A_TASK", 20)
    classifier.train_random_forest(rows, num_trees=3, max_depth=3, exclude=["id"])
    assert len(tasks[-1]) == max(cores, 15)
    assert all(sum(parts) == 300 and max(parts) < 100 for parts in tasks)


def test_permutation_predicts_in_as_many_tasks_as_cores(spark, monkeypatch):
    model = classifier.train_random_forest(_rows(spark), num_trees=3, max_depth=3, exclude=["id"])
    tasks = []

    def transform(df, of=model.model.transform):
        tasks.append([len(part) for part in df.rdd.glom().collect()])
        return of(df)

    monkeypatch.setattr(model.model, "transform", transform)
    assert classifier.permutation_importance(model, _rows(spark), "id").count() == 2
    assert [len(parts) for parts in tasks] == [spark.sparkContext.defaultParallelism]
    assert sum(tasks[0]) == 3 * 300 and max(tasks[0]) < 300
