"""From labels to an evaluation report: join, predict, evaluate, save."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from rowgauge.functions.cells import cell
from rowgauge.operators.classifier import RecordClassifier
from rowgauge.operators.evaluate import evaluate, union_datasets
from rowgauge.operators.labels import label_join
from rowgauge.sources.writers import save_metrics


class LabeledTable(NamedTuple):
    """A raw table, its labels, and the column both share."""

    raw: DataFrame
    labels: DataFrame
    key: str


def predict_labeled(
    classifier: RecordClassifier, table: LabeledTable, label: str = "final_label"
) -> DataFrame:
    """(key, label, prediction, score) of the labeled rows."""
    joined = label_join(table.raw, table.labels, table.key)
    return classifier.predict(joined).select(cell(table.key), cell(label), "prediction", "score")


def label_pipeline(
    classifier: RecordClassifier,
    tables: dict[str, LabeledTable],
    label: str = "final_label",
    output: str | None = None,
) -> DataFrame:
    """Predict every labeled table and evaluate per table and combined.

    With `output` the report is also written there as JSON lines.
    """
    predictions = {
        name: predict_labeled(classifier, table, label)
        .select(cell(label), "prediction", "score")
        for name, table in tables.items()
    }
    report = evaluate(union_datasets(predictions), label, "prediction", "score", "dataset")
    if output is not None:
        save_metrics(report, output)
    return report
