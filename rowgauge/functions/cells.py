"""Column-level building blocks: quoting, type tests, canonical values, percentages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Back-quote a column name so that dots and spaces stay part of the name."""
    return "`" + name.replace("`", "``") + "`"


def cell(name: str) -> Column:
    return F.col(quoted(name))


def chosen(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """The columns an operator works on: those asked for, else all of the input."""
    names = list(df.columns if columns is None else columns)
    if not names:
        raise ValueError("at least one column is needed")
    unknown = [name for name in names if name not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return names


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(has_map(field.dataType) for field in dtype.fields)
    return False


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A value that can be grouped on: maps, at any depth, become sorted entry arrays."""
    if not has_map(dtype):
        return value
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        if has_map(dtype.valueType):
            # Sort on the key alone (unique within a map), then rewrite the values.
            keys = F.array_sort(F.map_keys(value))
            return F.transform(
                keys,
                lambda k: F.struct(
                    k.alias("key"), comparable(value[k], dtype.valueType).alias("value")
                ),
            )
        return entries
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: comparable(item, dtype.elementType))
    rebuilt = F.struct(
        *[comparable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
    )
    return F.when(value.isNotNull(), rebuilt)


def restored(value: Column, dtype: T.DataType) -> Column:
    """Undo `comparable`, giving back the original type."""
    if not has_map(dtype):
        return value
    if isinstance(dtype, T.MapType):
        if has_map(dtype.valueType):
            value = F.transform(
                value,
                lambda e: F.struct(
                    e["key"].alias("key"), restored(e["value"], dtype.valueType).alias("value")
                ),
            )
        return F.map_from_entries(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: restored(item, dtype.elementType))
    rebuilt = F.struct(*[restored(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    return F.when(value.isNotNull(), rebuilt)


def null_cells(names: Iterable[str]) -> Column:
    """Number of null cells of a row."""
    return _added([cell(n).isNull().cast("int") for n in names])


def filled_cells(names: Iterable[str]) -> Column:
    """Number of non-null cells of a row."""
    return _added([cell(n).isNotNull().cast("int") for n in names])


def _added(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null when the whole is zero (ANSI-safe)."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def rounded(value: Column, digits: int = 2) -> Column:
    """Half-up rounding by way of decimal, so that 2.675 gives 2.68 in every engine."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0.0 for an empty whole."""
    return F.coalesce(rounded(ratio(part, whole) * 100), F.lit(0.0))
