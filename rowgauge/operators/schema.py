"""Schema inference over text columns, type checks, and conversion to a schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell, chosen
from rowgauge.functions.typing import (
    SPARK_TYPES,
    TYPE_NAMES,
    fits_type,
    read_as,
    type_name_of,
    value_kind,
    value_type,
)
from rowgauge.operators.profile import column_listing


def infer_value_types(df: DataFrame, column: str, output: str = "value_type") -> DataFrame:
    """Add the inferred type name of each value of a text column."""
    return df.withColumn(output, value_type(cell(column)))


def type_votes(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column with the number of values of each type.

    (ordinal, column_name, int, float, bool, timestamp, date, string, missing, wide, huge):
    `wide` counts whole numbers beyond 32 bits, `huge` those beyond 64. One scan. Cells become
    rows of their own before the type test, so it is compiled once, whatever the number of columns,
    and the kinds are counted within each task before the shuffle.
    """
    names = chosen(df, columns)
    texts = F.array(*[cell(n).cast("string") for n in names])
    kinds = [*TYPE_NAMES, "missing", "wide", "huge"]
    counted = (
        df.select(F.posexplode(texts).alias("ordinal", "text"))
        .select("ordinal", value_kind(F.col("text")).alias("kind"))
        .groupBy("ordinal")
        .agg(*[F.count(F.when(F.col("kind") == kind, 1)).alias(kind) for kind in kinds])
    )
    votes = column_listing(df.sparkSession, names).join(counted, "ordinal", "left")
    filled = {kind: F.coalesce(F.col(kind), F.lit(0)) for kind in kinds}
    return votes.select(
        "ordinal",
        "column_name",
        (filled["int"] + filled["wide"] + filled["huge"]).alias("int"),
        *[filled[kind].alias(kind) for kind in kinds if kind != "int"],
    )


def infer_column_types(
    df: DataFrame, columns: Iterable[str] | None = None, policy: str = "majority"
) -> DataFrame:
    """(ordinal, column_name, inferred_type) of text columns.

    'majority' takes the most common type other than string, string only where nothing else
    occurs; ties go to the first of int, float, bool, timestamp, date. An int column that holds
    a value beyond 32 bits is 'long'. 'strict' takes the narrowest type that fits all values.
    """
    votes = type_votes(df, columns)
    ballots = [F.struct(F.col(t).alias("n"), F.lit(-i).alias("rank"), F.lit(t).alias("type"))
               for i, t in enumerate(TYPE_NAMES) if t != "string"]
    top = F.greatest(*ballots)
    whole = (
        F.when(F.col("huge") > 0, "float").when(F.col("wide") > 0, "long").otherwise("int")
    )
    if policy == "majority":
        winner = F.when(top["n"] == 0, "string").when(
            top["type"] == "int", F.when(F.col("wide") + F.col("huge") > 0, "long").otherwise("int")
        ).otherwise(top["type"])
    elif policy == "strict":
        total = F.col("int") + F.col("float") + F.col("bool") + F.col("timestamp") + F.col(
            "date") + F.col("string")
        winner = (
            F.when(total == 0, "string")
            .when(F.col("int") == total, whole)
            .when(F.col("int") + F.col("float") == total, "float")
            .when(F.col("bool") == total, "bool")
            .when(F.col("date") == total, "date")
            .when(F.col("date") + F.col("timestamp") == total, "timestamp")
            .otherwise("string")
        )
    else:
        raise ValueError(f"unknown policy: {policy}")
    return votes.select("ordinal", "column_name", winner.alias("inferred_type"))


def infer_schema(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    policy: str = "majority",
) -> T.StructType:
    """A nullable StructType for text columns, from all rows. One job; collects one row per column."""
    names = chosen(df, columns)
    found = infer_column_types(df, names, policy).orderBy("ordinal").collect()
    return T.StructType(
        [T.StructField(row["column_name"], SPARK_TYPES[row["inferred_type"]]) for row in found]
    )


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Read text columns as the schema's types; unreadable values become null.

    Columns outside the schema, and columns that are no text, stay as they are.
    """
    wanted = {f.name: f.dataType for f in schema.fields}

    def converted(field: T.StructField):
        value = cell(field.name)
        target = wanted.get(field.name)
        if target is None or not isinstance(field.dataType, T.StringType):
            return value
        read = read_as(value, type_name_of(target))
        return read.cast(target).alias(field.name)

    return df.select(*[converted(f) for f in df.schema.fields])


def expected_types(schema: T.StructType) -> dict[str, str]:
    """Short type names of a schema, for the type checks."""
    return {f.name: type_name_of(f.dataType) for f in schema.fields}


def type_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Add one boolean `<column>_valid` per column of `expected`; null cells are valid."""
    checks = [
        fits_type(cell(n), df.schema[n].dataType, t).alias(f"{n}_valid")
        for n, t in expected.items()
    ]
    return df.select("*", *checks)


def validity_profile(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(ordinal, column_name, expected_type, checked, invalid_count); one aggregate."""
    names = chosen(df, expected)
    invalid = [
        F.count(F.when(~fits_type(cell(n), df.schema[n].dataType, expected[n]), 1)).alias(f"bad_{i}")
        for i, n in enumerate(names)
    ]
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(n).alias("column_name"),
            F.lit(expected[n]).alias("expected_type"),
            F.col("checked"),
            F.col(f"bad_{i}").alias("invalid_count"),
        )
        for i, n in enumerate(names)
    ]
    return df.agg(F.count(F.lit(1)).alias("checked"), *invalid).select(F.inline(F.array(*rows)))


def row_type_validity(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Add `row_type_validity`: share of a row's cells that fit their expected type, 0..100."""
    names = chosen(df, expected)
    fitting = [fits_type(cell(n), df.schema[n].dataType, expected[n]).cast("int") for n in names]
    total = fitting[0]
    for term in fitting[1:]:
        total = total + term
    return df.withColumn(
        "row_type_validity", total.cast("double") / F.lit(len(names)) * 100
    )


def numeric_features(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns as double for a model: text by content, null and unreadable as 0.0.

    Vector columns pass unchanged. One projection.
    """
    names = list(columns)

    def as_double(name: str):
        dtype = df.schema[name].dataType
        value = cell(name)
        if isinstance(dtype, T.StringType):
            number = read_as(value, "float")
        elif isinstance(dtype, (T.NumericType, T.BooleanType)):
            number = value.cast("double")
        elif isinstance(dtype, T.UserDefinedType):
            return value
        else:
            # Dates and nested values are no numbers here, as under a failing cast.
            number = F.lit(None).cast("double")
        return F.coalesce(number, F.lit(0.0)).alias(name)

    rest = [cell(n) for n in df.columns if n not in names]
    return df.select(*rest, *[as_double(n) for n in names])
