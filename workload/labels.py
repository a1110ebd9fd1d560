"""Queries: labels, evaluation against labels, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgauge.functions.cells import rounded
from rowgauge.operators import evaluate, labels, sampling
from workload.registry import query
from workload.views import (
    LABEL_COPIES,
    LABEL_DIMS,
    SCORED,
    label_copies,
    label_dims,
    scored,
    sql_percent,
    sql_rounded,
    table,
)

DIMS = ["completeness", "consistency", "validity", "accuracy"]
LABELS = [*DIMS, "final_label"]
RULE = "CASE WHEN completeness + consistency + validity + accuracy >= 3 THEN 1 ELSE 0 END"

# Label rule and checks ------------------------------------------------------------------------


@query(
    "label_rule",
    f"WITH {LABEL_DIMS} SELECT *, completeness + consistency + validity + accuracy AS passing_count, "
    f"{RULE} AS expected_label FROM label_dims",
)
def _(spark, sf):
    return labels.label_rule(label_dims(spark, sf))


_CHECKS = [
    ("row_count", "abs(count(*) - 15000)"),
    *[(f"no_nulls:{c}", f"count(*) FILTER ({c} IS NULL)") for c in LABELS],
    *[(f"zero_or_one:{c}", f"count(*) FILTER ({c} NOT IN (0, 1))") for c in LABELS],
    ("label_rule", f"count(*) FILTER (final_label <> {RULE})"),
]


@query(
    "verify_labels",
    f"WITH {LABEL_DIMS}, c AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", CAST({e} AS BIGINT) AS violations FROM label_dims"
        for n, e in _CHECKS
    )
    + " UNION ALL SELECT 'required_columns', CAST(0 AS BIGINT)) "
    "SELECT \"check\", CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status, violations FROM c",
)
def _(spark, sf):
    return labels.verify_labels(label_dims(spark, sf), "o_orderkey", expected_rows=15000)


@query(
    "label_violations",
    f"WITH {LABEL_DIMS} SELECT *, completeness + consistency + validity + accuracy AS passing_count, "
    f"{RULE} AS expected_label FROM label_dims WHERE final_label <> {RULE}",
)
def _(spark, sf):
    return labels.label_violations(label_dims(spark, sf))


@query(
    "dimension_pass_rates",
    f"WITH {LABEL_DIMS} "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, count(*) FILTER ({d} = 1) AS passed, count(*) AS total, "
        f"{sql_percent(f'count(*) FILTER ({d} = 1)', 'count(*)')} AS percentage FROM label_dims"
        for d in DIMS
    ),
)
def _(spark, sf):
    return labels.dimension_pass_rates(label_dims(spark, sf))


@query(
    "label_distribution",
    f"WITH {LABEL_DIMS} SELECT final_label, count(*) AS n, "
    f"{sql_percent('count(*)', '(SELECT count(*) FROM label_dims)')} AS percentage "
    "FROM label_dims GROUP BY final_label",
)
def _(spark, sf):
    return sampling.label_distribution(label_dims(spark, sf), "final_label")


@query(
    "label_template",
    "SELECT o_orderkey, o_orderstatus, o_orderdate, "
    + ", ".join(f"CAST(NULL AS INTEGER) AS {c}" for c in LABELS)
    + ", CAST(NULL AS VARCHAR) AS notes FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return sampling.label_template(orders, "o_orderkey", ["o_orderstatus", "o_orderdate"])


@query(
    "label_join",
    f"WITH {LABEL_COPIES}, r AS (SELECT doc_id, lang, source, n_chars, 1 AS quality FROM documents) "
    "SELECT doc_id, lang, source, n_chars, r.quality AS quality_x, l.quality AS quality_y, l.toxic "
    "FROM r JOIN label_copies l USING (doc_id)",
)
def _(spark, sf):
    raw = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.lit(1).alias("quality")
    )
    return labels.label_join(raw, label_copies(spark, sf), "doc_id")


_FEATURES = ["o_orderkey", *DIMS]
_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(final_label AS DOUBLE)) AS r "
    "FROM label_dims"
    for c in _FEATURES
)


@query(
    "correlation_importance",
    f"WITH {LABEL_DIMS}, c AS ({_CORR}) SELECT feature, {sql_rounded('r', 6)} AS correlation, "
    f"coalesce({sql_rounded('abs(r)', 6)}, 0.0) AS importance FROM c",
)
def _(spark, sf):
    return labels.correlation_importance(label_dims(spark, sf), "final_label")


_STATUS_LABEL = "CAST(CASE WHEN o_totalprice > 150000 AND o_orderstatus <> 'F' THEN 1 ELSE 0 END AS DOUBLE)"


def _ratio_sql(column: str) -> str:
    """The correlation ratio of the label given a column's values."""
    return (
        f"SELECT '{column}' AS feature, 'text' AS kind, sqrt(sum(s * s / n) - sum(s) * sum(s) / sum(n)) / "
        f"sqrt(sum(q) - sum(s) * sum(s) / sum(n)) AS r FROM (SELECT count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM o "
        f"WHERE {column} IS NOT NULL AND y IS NOT NULL GROUP BY {column})"
    )


@query(
    "association_importance",
    f"WITH o AS (SELECT o_totalprice, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus, "
    f"CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, {_STATUS_LABEL} AS y FROM orders), "
    f"a AS (SELECT 'o_totalprice' AS feature, 'numeric' AS kind, corr(o_totalprice, y) AS r FROM o "
    f"UNION ALL {_ratio_sql('o_orderstatus')} UNION ALL {_ratio_sql('o_orderpriority')}) "
    f"SELECT feature, kind, {sql_rounded('r', 6)} AS association, coalesce({sql_rounded('abs(r)', 6)}, 0.0) AS importance FROM a",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_totalprice",
        F.expr("CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority"),
        F.expr(f"{_STATUS_LABEL} AS y"),
    )
    return labels.association_importance(orders, "y")


@query(
    "feature_kinds",
    "SELECT CAST(7 AS BIGINT) AS n_total_features, CAST(4 AS BIGINT) AS n_numeric, CAST(3 AS BIGINT) AS n_categorical, "
    "count(*) AS rows FROM orders JOIN customer ON c_custkey = o_custkey",
)
def _(spark, sf):
    """Kinds of the features of orders with their customers, the status being the label."""
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")
    ).select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    kinds = labels.feature_kinds(joined, "o_orderstatus")
    return joined.agg(*[F.lit(n).cast("long").alias(name) for name, n in kinds.items()], F.count(F.lit(1)).alias("rows"))


# Evaluation -----------------------------------------------------------------------------------

_POOL = f"WITH {SCORED}, pool AS (SELECT * FROM scored UNION ALL SELECT event_id, 'combined', truth, predicted, score FROM scored)"


def confusion_sql(source: str, dataset: str = "dataset") -> str:
    return (
        f"SELECT {dataset} AS dataset, count(*) AS n_samples, count(*) FILTER (truth = 1) AS n_positive, "
        "count(*) FILTER (truth = 0) AS n_negative, "
        "count(*) FILTER (truth = 0 AND predicted = 0) AS tn, "
        "count(*) FILTER (truth = 0 AND predicted = 1) AS fp, "
        "count(*) FILTER (truth = 1 AND predicted = 0) AS fn, "
        f"count(*) FILTER (truth = 1 AND predicted = 1) AS tp FROM {source} GROUP BY ALL"
    )


_RATES = {
    "precision": ("tp", "tp + fp"),
    "recall": ("tp", "tp + fn"),
    "f1_score": ("2 * tp", "2 * tp + fp + fn"),
    "accuracy": ("tp + tn", "n_samples"),
}
BINARY = ", ".join(
    f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0.0), 0.0) AS \"{n}\""
    for n, (a, b) in _RATES.items()
)


def area_sql(source: str) -> str:
    """Rank-sum area per dataset."""
    return (
        "g AS (SELECT dataset, score, CAST(count(*) FILTER (truth = 1) AS DOUBLE) AS p, "
        f"CAST(count(*) FILTER (truth = 0) AS DOUBLE) AS q FROM {source} GROUP BY ALL), "
        "u AS (SELECT dataset, p, q, p * (coalesce(sum(q) OVER (PARTITION BY dataset ORDER BY score "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) + q / 2) AS pairs FROM g), "
        "area AS (SELECT dataset, coalesce(sum(pairs) / nullif(sum(p) * sum(q), 0.0), 0.0) AS auc_roc "
        "FROM u GROUP BY dataset)"
    )


@query("confusion_matrix", f"WITH {SCORED} {confusion_sql('scored')}")
def _(spark, sf):
    return evaluate.confusion_matrix(scored(spark, sf), "truth", "predicted", "dataset")


@query(
    "binary_metrics", f"WITH {SCORED}, c AS ({confusion_sql('scored')}) SELECT *, {BINARY} FROM c"
)
def _(spark, sf):
    return evaluate.binary_metrics(scored(spark, sf), "truth", "predicted", "dataset")


_WEIGHTED = (
    "cls AS (SELECT dataset, k, count(*) FILTER (truth = k) AS l, count(*) FILTER (predicted = k) AS g, "
    "count(*) FILTER (truth = k AND predicted = k) AS h FROM scored, (VALUES (0), (1)) t(k) GROUP BY ALL), "
    "rates AS (SELECT dataset, l, coalesce(CAST(h AS DOUBLE) / nullif(g, 0), 0.0) AS p, "
    "coalesce(CAST(h AS DOUBLE) / nullif(l, 0), 0.0) AS r, "
    "coalesce(CAST(2 * h AS DOUBLE) / nullif(g + l, 0), 0.0) AS f FROM cls), "
    "w AS (SELECT dataset, CAST(sum(l) AS BIGINT) AS samples, sum(p * l) / sum(l) AS wp, "
    "sum(r * l) / sum(l) AS wr, sum(f * l) / sum(l) AS wf FROM rates GROUP BY dataset), "
    f"wm AS (SELECT dataset, samples, {sql_rounded('wp', 6)} AS weighted_precision, "
    f"{sql_rounded('wr', 6)} AS weighted_recall, {sql_rounded('wf', 6)} AS weighted_f1 FROM w)"
)


def _weighted(spark, sf):
    found = evaluate.weighted_metrics(scored(spark, sf), "truth", "predicted", "dataset")
    names = ("weighted_precision", "weighted_recall", "weighted_f1")
    return found.withColumns({c: rounded(F.col(c), 6) for c in names})


@query("weighted_metrics", f"WITH {SCORED}, {_WEIGHTED} SELECT * FROM wm")
def _(spark, sf):
    return _weighted(spark, sf)


@query(
    "acceptance_gate",
    f"WITH {SCORED}, {_WEIGHTED} SELECT *, weighted_precision >= 0.80 AND weighted_recall >= 0.75 "
    "AND weighted_f1 >= 0.77 AS accepted FROM wm",
)
def _(spark, sf):
    return evaluate.acceptance_gate(_weighted(spark, sf))


@query(
    "auc_roc",
    f"WITH {SCORED}, {area_sql('scored')} SELECT dataset, {sql_rounded('auc_roc', 6)} AS auc_roc FROM area",
)
def _(spark, sf):
    found = evaluate.auc_roc(scored(spark, sf), "truth", "score", "dataset")
    return found.withColumn("auc_roc", rounded(F.col("auc_roc"), 6))


@query(
    "evaluate_rollup",
    f"{_POOL}, c AS ({confusion_sql('pool')}), {area_sql('pool')} "
    f"SELECT c.*, {BINARY}, {sql_rounded('auc_roc', 6)} AS auc_roc FROM c JOIN area USING (dataset)",
)
def _(spark, sf):
    found = evaluate.evaluate(scored(spark, sf), "truth", "predicted", "score", "dataset")
    return found.withColumn("auc_roc", rounded(F.col("auc_roc"), 6))


@query(
    "evaluation_summary",
    f"{_POOL}, c AS ({confusion_sql('pool')}), b AS (SELECT *, {BINARY} FROM c) "
    f"SELECT dataset, n_samples, {sql_percent('n_positive', 'n_samples')} AS high_percentage, "
    f"{sql_percent('n_negative', 'n_samples')} AS low_percentage, \"precision\", recall, f1_score, "
    "accuracy, \"precision\" >= 0.80 AS precision_ok, recall >= 0.75 AS recall_ok, "
    "f1_score >= 0.77 AS f1_ok FROM b",
)
def _(spark, sf):
    found = evaluate.binary_metrics(
        scored(spark, sf), "truth", "predicted", "dataset", pooled=True
    )
    return evaluate.evaluation_summary(found)


@query(
    "union_datasets",
    "SELECT doc_id, quality, toxic, CAST(NULL AS INTEGER) AS label, 'documents' AS dataset FROM labels "
    "UNION ALL SELECT vec_id, NULL, NULL, label, 'vectors' FROM embeddings",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return evaluate.union_datasets({"documents": table(spark, sf, "labels"), "vectors": vectors})


# Sampling -------------------------------------------------------------------------------------

MONTHLY = (
    "monthly AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)"
)
COUNTS = (
    "counts AS (SELECT month, count(*) AS n FROM monthly GROUP BY month), "
    "shares AS (SELECT month, n, CAST(n AS DOUBLE) / CAST((SELECT count(*) FROM orders) AS DOUBLE) "
    "AS share FROM counts)"
)


def digest_sql(purpose: str, key: str = "o_orderkey") -> str:
    return f"md5('{purpose}:' || coalesce('=' || CAST({key} AS VARCHAR), '') || ':42')"


ORDER = digest_sql("order")
SAMPLED = (
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY {digest_sql('sample')}, o_orderkey) AS rk "
    "FROM monthly), sampled AS (SELECT r.* EXCLUDE (rk) FROM ranked r JOIN shares s USING (month) "
    "WHERE rk <= greatest(1, CAST(floor(1000 * share) AS BIGINT)))"
)


def monthly(spark, sf):
    return sampling.monthly_strata(table(spark, sf, "orders"), "o_orderdate")


@query("monthly_strata", f"WITH {MONTHLY} SELECT * FROM monthly")
def _(spark, sf):
    return monthly(spark, sf)


@query("strata_profile", f"WITH {MONTHLY}, {COUNTS} SELECT * FROM shares")
def _(spark, sf):
    return sampling.strata_profile(monthly(spark, sf), "month")


@query(
    "strata_summary",
    f"WITH {MONTHLY} SELECT count(DISTINCT month) AS strata, min(o_orderdate) AS first, "
    "max(o_orderdate) AS last FROM monthly",
)
def _(spark, sf):
    return sampling.strata_summary(monthly(spark, sf), "month", "o_orderdate")


@query(
    "rare_strata",
    f"WITH {MONTHLY}, {COUNTS} SELECT * FROM shares "
    "WHERE share < 100.0 / (SELECT CAST(count(*) AS DOUBLE) FROM orders)",
)
def _(spark, sf):
    return sampling.rare_strata(monthly(spark, sf), "month", minimum=100)


@query(
    "top10_strata", f"WITH {MONTHLY}, {COUNTS} SELECT * FROM counts ORDER BY n DESC, month LIMIT 10"
)
def _(spark, sf):
    return sampling.top_strata(monthly(spark, sf), "month")


@query("stratified_sample", f"WITH {MONTHLY}, {COUNTS}, {SAMPLED} SELECT * FROM sampled")
def _(spark, sf):
    return sampling.stratified_sample(monthly(spark, sf), "month", "o_orderkey", 1000)


DRAWN = (
    "SELECT range AS draw, CAST('0x' || substr(md5('bootstrap:' || CAST(range AS VARCHAR) || ':42'), 1, 15) "
    "AS BIGINT) % (SELECT count(*) FROM sampled) AS ix FROM range(1000)"
)


@query(
    "bootstrap_resample",
    f"WITH {MONTHLY}, {COUNTS}, {SAMPLED}, indexed AS (SELECT *, row_number() OVER (ORDER BY {ORDER}, "
    f"o_orderkey) - 1 AS ix FROM sampled), draws AS ({DRAWN}) "
    "SELECT draw, i.* EXCLUDE (ix) FROM draws JOIN indexed i USING (ix)",
)
def _(spark, sf):
    sample = sampling.stratified_sample(monthly(spark, sf), "month", "o_orderkey", 1000)
    return sampling.bootstrap_resample(sample, "o_orderkey", 1000)


@query(
    "exact_size_sample",
    f"WITH {MONTHLY}, {COUNTS}, {SAMPLED}, indexed AS (SELECT *, row_number() OVER (ORDER BY {ORDER}, "
    f"o_orderkey) - 1 AS ix FROM sampled), draws AS ({DRAWN}) "
    "SELECT i.* EXCLUDE (ix) FROM draws JOIN indexed i USING (ix) WHERE (SELECT count(*) FROM sampled) <> 1000 "
    "UNION ALL SELECT * FROM sampled WHERE (SELECT count(*) FROM sampled) = 1000",
)
def _(spark, sf):
    return sampling.exact_size_sample(monthly(spark, sf), "month", "o_orderkey", 1000)


@query(
    "class_sample",
    "WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), ranked AS (SELECT *, "
    f"row_number() OVER (PARTITION BY o_orderpriority ORDER BY {digest_sql('sample')}, o_orderkey) AS rk FROM orders) "
    "SELECT r.* EXCLUDE (rk) FROM ranked r JOIN n USING (o_orderpriority) WHERE rk <= greatest(1, CAST(floor(90 * "
    "(CAST(n AS DOUBLE) / CAST((SELECT count(*) FROM orders) AS DOUBLE))) AS BIGINT))",
)
def _(spark, sf):
    return sampling.stratified_sample(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 90)


def number_sql(purpose: str, key: str = "o_orderkey") -> str:
    return f"CAST('0x' || substr({digest_sql(purpose, key)}, 1, 8) AS BIGINT)"


@query(
    "train_test_split",
    f"SELECT *, CASE WHEN {number_sql('split')} < 3435973836 THEN 'train' ELSE 'test' END AS split FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").withColumn("split", sampling.split_mark("o_orderkey"))


@query("kfold_assign", f"SELECT *, CAST({number_sql('fold')} % 5 + 1 AS INTEGER) AS fold_id FROM orders")
def _(spark, sf):
    return sampling.assign_folds(table(spark, sf, "orders"), "o_orderkey", 5)


@query(
    "kfold_assign_exact",
    f"SELECT *, CAST(row_number() OVER (ORDER BY {ORDER}, o_orderkey) % 5 + 1 AS INTEGER) AS fold_id "
    "FROM orders",
)
def _(spark, sf):
    return sampling.assign_folds(table(spark, sf, "orders"), "o_orderkey", 5, exact=True)
