"""Feature vectors: assembling, norms, standardizing, statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import Normalizer, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgauge.functions.cells import cell


def assembled(
    df: DataFrame, columns: Iterable[str], output: str, handle_invalid: str = "error"
) -> DataFrame:
    """Add a vector of the columns. Any column name works: the assembler sees plain aliases."""
    names = list(columns)
    inputs = [f"__part_{i}" for i in range(len(names))]
    aliased = df.select("*", *[cell(n).alias(a) for n, a in zip(names, inputs)])
    assembler = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid=handle_invalid)
    return assembler.transform(aliased).drop(*inputs)


def normalize_features(df: DataFrame, feature_columns: Iterable[str], p: float = 2.0) -> DataFrame:
    """Add `normalized_features`: each row's features over their p-norm; zero rows stay zero."""
    raw = assembled(df, feature_columns, "__raw")
    normalizer = Normalizer(inputCol="__raw", outputCol="normalized_features", p=p)
    return normalizer.transform(raw).drop("__raw")


def fit_scaler(df: DataFrame, feature_columns: Iterable[str]) -> StandardScalerModel:
    """Mean and sample deviation of each feature; one aggregate over the data."""
    scaler = StandardScaler(
        inputCol="__raw", outputCol="standardized_features", withMean=True, withStd=True
    )
    return scaler.fit(assembled(df.select(*map(cell, feature_columns)), feature_columns, "__raw"))


def standardize_features(
    df: DataFrame, feature_columns: Iterable[str], model: StandardScalerModel | None = None
) -> DataFrame:
    """Add `standardized_features`: mean 0, sample deviation 1; constant features become 0.

    Pass the model of `fit_scaler` to scale new data like the data it was fitted on.
    """
    names = list(feature_columns)
    fitted = fit_scaler(df, names) if model is None else model
    return fitted.transform(assembled(df, names, "__raw")).drop("__raw")


def create_feature_vector(
    df: DataFrame, row_features: Iterable[str], dataset_metrics: DataFrame
) -> DataFrame:
    """Add `normalized_features`, `dataset_<metric>` columns and `quality_feature_vector`.

    `dataset_metrics` has one row and one column per metric. It enters as a scalar subquery, so
    one value reaches the rows and nothing is joined. The vector holds the row features as they
    are, then the dataset metrics.
    """
    names = list(row_features)
    metrics = dataset_metrics.columns
    packed = dataset_metrics.select(F.struct(*[cell(m) for m in metrics])).scalar()
    with_metrics = df.select(
        "*", *[packed[m].cast("double").alias(f"dataset_{m}") for m in metrics]
    )
    parts = [*names, *[f"dataset_{m}" for m in metrics]]
    return assembled(normalize_features(with_metrics, names), parts, "quality_feature_vector")


def vector_stats(df: DataFrame, vector: str = "quality_feature_vector") -> DataFrame:
    """Rows (component, dimension, count, mean, stddev, min, max); one aggregate."""
    parts = ("mean", "std", "min", "max")
    summary = df.agg(
        Summarizer.metrics("count", *parts).summary(cell(vector)).alias("s")
    ).select(
        F.col("s.count").alias("count"), *[vector_to_array(F.col(f"s.{p}")).alias(p) for p in parts]
    )
    return summary.select(
        "count",
        F.size("mean").alias("dimension"),
        F.posexplode(F.arrays_zip(*parts)).alias("component", "v"),
    ).select(
        "component",
        "dimension",
        "count",
        F.col("v.mean").alias("mean"),
        F.col("v.std").alias("stddev"),
        F.col("v.min").alias("min"),
        F.col("v.max").alias("max"),
    )
