"""Queries: the record classifier. Documents with a quality label are the ground truth."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from rowgauge.operators import classifier, encode, labels, rows, sampling
from rowgauge.plans.labeling import LabeledTable, label_pipeline, predict_labeled
from workload.labels import number_sql
from workload.registry import query
from workload.views import dirty_orders, fixed, sql_fixed, table

TRAINED = f"{number_sql('split', 'doc_id')} < 3435973836"
LABELED = (
    "labeled AS (SELECT doc_id, CAST(quality AS INTEGER) AS ground_truth, "
    "length(text) - length(replace(text, ' ', '')) + 1 AS n_words, "
    f"{TRAINED} AS trained FROM documents JOIN labels USING (doc_id))"
)


def _within(name: str):
    """Whether a measure lies in 0..1."""
    return F.col(name).between(0.0, 1.0).alias(f"{name}_valid")


def _documents(spark, sf):
    """Documents with lengths of their text, one of them missing at every ninth document."""
    documents = table(spark, sf, "documents")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1
    raw = documents.select(
        "doc_id",
        "lang",
        F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")).alias("n_chars"),
        words.alias("n_words"),
        (F.length("text") / words).alias("word_length"),
    )
    return rows.row_features(raw)


def _labeled(spark, sf):
    truth = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("ground_truth")
    )
    return labels.label_join(_documents(spark, sf), truth, "doc_id")


def _fitted(spark, sf):
    train, test = sampling.train_test_split(_labeled(spark, sf), "doc_id")
    model = classifier.train_random_forest(train, exclude=["doc_id"])
    return model, train, test


@query(
    "prepare_features",
    "WITH twice AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0), "
    "r AS (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice ELSE 0.0 END AS DOUBLE) AS a, "
    "CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey ELSE 0 END AS DOUBLE) AS b, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status FROM twice), "
    "codes AS (SELECT status, CAST(row_number() OVER (ORDER BY count(*) DESC, status) AS DOUBLE) AS code "
    "FROM r WHERE status IS NOT NULL GROUP BY status), "
    "f AS (SELECT o_orderkey, a, b, coalesce(code, 0.0) AS c FROM r LEFT JOIN codes USING (status)), "
    "s AS (SELECT avg(a) AS ma, stddev_samp(a) AS da, avg(b) AS mb, stddev_samp(b) AS db, avg(c) AS mc, "
    "stddev_samp(c) AS dc FROM f) "
    f"SELECT o_orderkey, {sql_fixed('(b - mb) / db')} AS o_custkey, {sql_fixed('(c - mc) / dc')} AS o_orderstatus, "
    f"{sql_fixed('(a - ma) / da')} AS o_totalprice FROM f, s",
)
def _(spark, sf):
    orders = dirty_orders(spark, sf).select(
        F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", "o_totalprice"
    )
    prepared, names = classifier.prepare_features(orders)
    scaled = vector_to_array("scaled_features")
    return prepared.select(
        F.col("row_id").alias("o_orderkey"),
        *[fixed(scaled[i]).alias(n) for i, n in enumerate(names)],
    )


@query(
    "encode_text",
    "WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR) || 'c' AS customer, "
    "o_orderkey % 2 AS y FROM orders), n AS (SELECT count(*) AS n, avg(y) AS whole FROM r), "
    "p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS code FROM r GROUP BY 1), "
    "m AS (SELECT customer, (sum(y) + 10 * any_value(whole)) / (count(*) + 10) AS mean FROM r, n GROUP BY customer) "
    f"SELECT o_orderkey, CAST(code AS DOUBLE) AS priority, {sql_fixed('mean')} AS customer "
    "FROM r JOIN p USING (o_orderpriority) JOIN m USING (customer)",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("c")).alias("customer"), (F.col("o_orderkey") % 2).alias("y"),
    )
    text = encode.fit_text(orders, ["priority", "customer"], "y")
    return text.apply(orders).select("o_orderkey", "priority", fixed(F.col("customer")).alias("customer"))


# A forest's numbers have no SQL: these queries return what SQL can say of them, and tests the rest.


@query(
    "rf_predict",
    f"WITH {LABELED} SELECT doc_id, ground_truth, true AS prediction_valid, true AS score_valid "
    "FROM labeled WHERE NOT trained",
)
def _(spark, sf):
    model, _, test = _fitted(spark, sf)
    return model.predict(test).select(
        "doc_id", "ground_truth", F.col("prediction").isin(0, 1).alias("prediction_valid"), _within("score")
    )


def _evaluated(model, rows):
    names = ("weighted_precision", "weighted_recall", "weighted_f1", "auc_roc")
    return model.evaluate(rows).select("samples", *[_within(n) for n in names])


def _evaluated_sql(condition: str) -> str:
    return (
        f"WITH {LABELED} SELECT count(*) AS samples, true AS weighted_precision_valid, true AS "
        f"weighted_recall_valid, true AS weighted_f1_valid, true AS auc_roc_valid FROM labeled WHERE {condition}"
    )


@query("rf_train_metrics", _evaluated_sql("trained"))
def _(spark, sf):
    model, train, _ = _fitted(spark, sf)
    return _evaluated(model, train)


@query("rf_evaluate", _evaluated_sql("NOT trained"))
def _(spark, sf):
    model, _, test = _fitted(spark, sf)
    return _evaluated(model, test)


@query(
    "rf_importance",
    "SELECT CAST(6 AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, true AS importance_valid",
)
def _(spark, sf):
    return _fitted(spark, sf)[0].importance(top=100).agg(
        F.count(F.lit(1)).alias("features"),
        fixed(F.sum("importance")).alias("total"),
        F.bool_and(F.col("importance").between(0.0, 1.0)).alias("importance_valid"),
    )


def _planted(spark, sf):
    """Labeled documents with a column that tells nine labels of ten, and one that tells nothing.

    Words are left out, since their length tells the label as well.
    """
    told = F.when(F.col("doc_id") % 10 == 0, 1 - F.col("ground_truth")).otherwise(F.col("ground_truth"))
    noise = F.pmod(F.xxhash64("doc_id"), F.lit(1000)).cast("double")
    rows = _labeled(spark, sf).drop("n_words", "word_length")
    return rows.withColumns({"planted": told.cast("double"), "noise": noise})


@query(
    "rf_permutation_importance",
    f"WITH {LABELED}, f AS (SELECT unnest(['lang', 'n_chars', 'null_count', 'valid_types_count', 'planted', 'noise']) "
    "AS feature) SELECT feature, count(*) AS samples, CASE WHEN feature = 'noise' THEN true END AS worth_less_than_planted "
    "FROM labeled, f WHERE NOT trained GROUP BY feature",
)
def _(spark, sf):
    train, test = sampling.train_test_split(_planted(spark, sf), "doc_id")
    model = classifier.train_random_forest(train, exclude=["doc_id"])
    found = classifier.permutation_importance(model, test, "doc_id")
    planted = F.max(F.when(F.col("feature") == "planted", F.col("importance"))).over(Window.partitionBy())
    less = F.when(F.col("feature") == "noise", F.col("importance") < planted)
    return found.select("feature", "samples", less.alias("worth_less_than_planted"))


@query(
    "rf_cross_validate",
    f"WITH {LABELED}, folds AS (SELECT count(DISTINCT {number_sql('fold', 'doc_id')} % 5) AS folds FROM labeled) "
    "SELECT metric, folds, true AS mean_valid FROM folds, "
    "(VALUES ('f1_score'), ('precision'), ('recall'), ('auc_roc')) m(metric)",
)
def _(spark, sf):
    found = classifier.cross_validate(_labeled(spark, sf), "doc_id")
    return found.select("metric", "folds", _within("mean"))


def _tables(spark, sf) -> dict[str, LabeledTable]:
    """Two labeled tables, short and long documents, with the labels kept from the training."""
    raw = _documents(spark, sf)
    truth = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("final_label")
    )
    held_out = sampling.train_test_split(truth, "doc_id")[1]
    return {
        "short": LabeledTable(raw.filter("n_words < 100"), held_out, "doc_id"),
        "long": LabeledTable(raw.filter("n_words >= 100"), held_out, "doc_id"),
    }


@query(
    "predict_labeled",
    f"WITH {LABELED} SELECT doc_id, ground_truth AS final_label, true AS prediction_valid, "
    "true AS score_valid FROM labeled WHERE NOT trained",
)
def _(spark, sf):
    model = _fitted(spark, sf)[0]
    short, long = _tables(spark, sf).values()
    whole = LabeledTable(short.raw.unionByName(long.raw), short.labels, "doc_id")
    return predict_labeled(model, whole).select(
        "doc_id", "final_label", F.col("prediction").isin(0, 1).alias("prediction_valid"), _within("score")
    )


@query(
    "label_pipeline",
    f"WITH {LABELED}, named AS (SELECT *, CASE WHEN n_words < 100 THEN 'short' ELSE 'long' END AS dataset "
    "FROM labeled WHERE NOT trained), pool AS (SELECT dataset, ground_truth FROM named UNION ALL "
    "SELECT 'combined', ground_truth FROM named) SELECT dataset, count(*) AS n_samples, "
    "count(*) FILTER (ground_truth = 1) AS n_positive, count(*) FILTER (ground_truth = 0) AS n_negative, "
    "count(*) AS outcomes FROM pool GROUP BY dataset",
)
def _(spark, sf):
    report = label_pipeline(_fitted(spark, sf)[0], _tables(spark, sf))
    return report.select(
        "dataset", "n_samples", "n_positive", "n_negative",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("outcomes"),
    )
