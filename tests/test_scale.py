"""Plans and skew: what must hold when one row, value or stratum makes up a third of the data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgauge.operators import evaluate, profile, rows, sampling
from rowgauge.plans.assess import assessed_rows


def final_plan(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed(spark):
    """A third of the rows are copies of one row."""
    hot = spark.range(1000).select(F.lit(-1).cast("bigint").alias("id"), F.lit("hot").alias("t"))
    return spark.range(2000).select("id", (F.col("id") % 7).cast("string").alias("t")).union(hot)


def test_hot_row_is_written_in_blocks(skewed, monkeypatch):
    monkeypatch.setattr(rows, "BLOCK", 64)
    flagged = rows.duplicate_flag(skewed)
    assert flagged.drop("is_duplicate").exceptAll(skewed).isEmpty()
    assert flagged.count() == 3000
    assert flagged.agg(F.sum("is_duplicate")).first()[0] == 999
    per_task = (
        flagged.filter("id = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    )
    assert len(per_task) > 4 and max(r["count"] for r in per_task) < 600


def test_copies_are_combined_before_the_shuffle(skewed):
    plan = final_plan(profile.duplicate_profile(skewed))
    assert plan.index("partial_count") > plan.index("Exchange")


def test_assessment_shuffles_rows_once(skewed):
    plan = final_plan(assessed_rows(skewed))
    assert "ReusedExchange" in plan


def test_completeness_shuffles_no_rows(skewed):
    plan = final_plan(profile.column_profile(skewed))
    plan = plan[: plan.index("Initial Plan")]
    assert "hashpartitioning" not in plan
    assert plan.count("Exchange SinglePartition") == 1


def first_by_digest(ids_of, quota_of, seed=42):
    import hashlib

    return sorted(
        i
        for stratum, ids in ids_of.items()
        for i in sorted(ids, key=lambda i: hashlib.md5(f"sample:={i}:{seed}".encode()).hexdigest())[
            : quota_of[stratum]
        ]
    )


@pytest.mark.parametrize("total", [6, 90, 4500, 9000])
def test_sample_is_the_first_of_each_stratum(spark, total):
    """A third of 9000 rows is one stratum; the rest are strata of 3 to 2000 rows."""
    sizes = {0: 3000, 1: 2000, 2: 1990, 3: 2000, 4: 7, 5: 3}
    bounds, start = {}, 0
    for stratum, size in sizes.items():
        bounds[stratum] = range(start, start + size)
        start += size
    stratum = F.lit(5)
    for name in (4, 3, 2, 1, 0):
        stratum = F.when(F.col("id") < bounds[name].stop, name).otherwise(stratum)
    frame = spark.range(start).withColumn("t", stratum).repartition(13)
    quotas = {t: max(1, int(total * (n / start))) for t, n in sizes.items()}
    sample = sampling.stratified_sample(frame, "t", "id", total)
    assert sorted(r.id for r in sample.collect()) == first_by_digest(bounds, quotas)


def test_sample_ranks_within_digest_prefixes(skewed):
    """No task sorts a stratum, whatever the quota, and nothing is collected or limited."""
    sample = sampling.stratified_sample(skewed.filter("id >= 0"), "t", "id", 1500)
    plan = final_plan(sample)
    ranks = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert ranks and all("__prefix" in line for line in ranks)
    assert "GlobalLimit" not in plan


def test_numbering_is_a_permutation_in_digest_order(spark):
    frame = spark.range(5000)
    found = sampling.numbered(frame, "id", 7).collect()
    assert sorted(r.row_index for r in found) == list(range(5000))
    import hashlib

    by_digest = sorted(
        range(5000), key=lambda i: hashlib.md5(f"order:={i}:7".encode()).hexdigest()
    )
    assert [r.id for r in sorted(found, key=lambda r: r.row_index)] == by_digest


def test_split_and_folds_of_a_sample_are_independent_of_it(spark):
    """Low digests are sampled; the same rows must not all be training rows or of one fold."""
    frame = spark.range(20_000).withColumn("t", F.col("id") % 3)
    sample = sampling.stratified_sample(frame, "t", "id", 2000).cache()
    train, test = sampling.train_test_split(sample, "id")
    assert 0.76 < train.count() / sample.count() < 0.84
    assert train.count() + test.count() == sample.count()
    folds = sampling.assign_folds(test, "id", 5).groupBy("fold_id").count().collect()
    assert len(folds) == 5 and min(r["count"] for r in folds) > 0.1 * test.count()


def test_bootstrap_draws_with_replacement(spark):
    for size in (963, 1024):
        drawn = sampling.bootstrap_resample(spark.range(size), "id", size)
        assert drawn.count() == size
        share = drawn.select("id").distinct().count() / size
        assert share == pytest.approx(1 - 1 / np.e, abs=0.05)


@pytest.fixture
def quarter_null(spark):
    """1000 rows in two strata; every fourth has no key."""
    key = F.when(F.col("id") % 4 != 0, F.col("id")).alias("key")
    return spark.range(1000).select("id", key, (F.col("id") % 8 == 0).cast("int").alias("t"))


def test_rows_without_a_key_are_kept(quarter_null):
    assert sampling.stratified_sample(quarter_null, "t", "key", 1000).count() == 1000
    half = sampling.stratified_sample(quarter_null, "t", "key", 400)
    assert half.filter("t = 1").count() == 50
    for exact in (False, True):
        folds = sampling.assign_folds(quarter_null, "key", 5, exact=exact)
        assert folds.count() == 1000 and folds.filter("fold_id IS NULL").isEmpty()
    assert sampling.bootstrap_resample(quarter_null, "key", 1000).count() == 1000
    train, test = sampling.train_test_split(quarter_null, "key")
    assert train.count() + test.count() == 1000


def area_by_pairs(truth, score) -> float:
    pos, neg = score[truth == 1], score[truth == 0]
    if not len(pos) or not len(neg):
        return 0.0
    above = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return above / (len(pos) * len(neg))


@pytest.mark.parametrize("distinct", [1, 3, 40, 5000])
def test_area_equals_pair_counting(spark, distinct):
    random = np.random.default_rng(distinct)
    truth = random.integers(0, 2, 1500)
    score = random.integers(0, distinct, 1500) / distinct - 0.3
    groups = np.array(["a", "b", "b"])[random.integers(0, 3, 1500)]
    frame = spark.createDataFrame(
        [(g, int(t), float(s)) for g, t, s in zip(groups, truth, score)], "g string, t int, s double"
    )
    found = {
        r.dataset: r.auc_roc for r in evaluate.auc_roc(frame, "t", "s", "g", pooled=True).collect()
    }
    assert found["combined"] == pytest.approx(area_by_pairs(truth, score), abs=1e-12)
    for group in "ab":
        chosen = groups == group
        assert found[group] == pytest.approx(area_by_pairs(truth[chosen], score[chosen]), abs=1e-12)


def test_area_with_hot_score(spark):
    frame = spark.range(3000).select(
        (F.col("id") % 2).cast("int").alias("t"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("s"),
    ).cache()
    found = evaluate.auc_roc(frame, "t", "s").first().auc_roc
    data = np.array([(r.t, r.s) for r in frame.collect()])
    assert found == pytest.approx(area_by_pairs(data[:, 0], data[:, 1]), abs=1e-12)
    frame.unpersist()


def test_evaluation_passes_over_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "scored")
    spark.range(300).select(
        (F.col("id") % 2).cast("int").alias("t"), (F.col("id") % 3 % 2).cast("int").alias("p"),
        (F.col("id") % 11 / 11).alias("s"), (F.col("id") % 4).cast("string").alias("g"),
    ).write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(score):
        read.add(1)
        return score

    scored = spark.read.parquet(path).withColumn("s", counted("s"))
    assert evaluate.evaluate(scored, "t", "p", "s", "g").count() == 5
    assert read.value == 300
    read.value = 0
    assert evaluate.evaluate_weighted(scored, "t", "p", "s", "g").count() == 4
    assert read.value == 300


def test_a_dataset_named_combined_is_not_added_to_the_pooled_row(spark):
    frame = spark.createDataFrame(
        [("combined", 1, 1, 0.9), ("combined", 0, 0, 0.1), ("b", 1, 0, 0.4)], "g string, t int, p int, s double"
    )
    found = evaluate.evaluate(frame, "t", "p", "s", "g")
    assert sorted((r.dataset, r.n_samples) for r in found.collect()) == [("b", 1), ("combined", 2), ("combined", 3)]


def test_type_test_is_compiled_once(spark):
    from rowgauge.operators.schema import type_votes

    def size(n):
        texts = spark.createDataFrame([tuple("1" * n)], [f"c{i}" for i in range(n)])
        plan = type_votes(texts)._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan
        return plan.count("RLIKE")

    assert size(2) == size(12) > 0
