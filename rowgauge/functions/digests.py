"""Digests that stand for values and rows where these are only counted.

A digest is a pair of 64-bit hashes, made in generated code: what is shuffled is as narrow for a long
text as for a number. Different values have one digest with a chance of 2^-128 a pair, so a table of
10^12 distinct rows is counted right but for a chance of 10^-14.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell, comparable

# to_json cuts timestamps to milliseconds, and offsets to minutes, unless told otherwise.
JSON_IN_FULL = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# Null marks of so many columns fit one whole number.
MARKS = 60

_NESTED = (T.StructType, T.ArrayType, T.MapType)


def _has_zero_sign(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_zero_sign(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_zero_sign(dtype.keyType) or _has_zero_sign(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_zero_sign(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _unsigned_zero(value: Column, dtype: T.DataType) -> Column:
    """A comparable value with -0.0 as 0.0 at any depth, as in grouping."""
    if not _has_zero_sign(dtype):
        return value
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _unsigned_zero(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform(
            value,
            lambda e: F.struct(
                _unsigned_zero(e["key"], dtype.keyType).alias("key"),
                _unsigned_zero(e["value"], dtype.valueType).alias("value"),
            ),
        )
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(*[_unsigned_zero(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(value.isNotNull(), rebuilt)
    return value + F.lit(0.0).cast(dtype)


def hashable(value: Column, dtype: T.DataType) -> Column:
    """The value in a form that the hash takes whole: nested values as text, nulls in them included."""
    if isinstance(dtype, _NESTED):
        return F.to_json(_unsigned_zero(comparable(value, dtype), dtype), JSON_IN_FULL)
    return value


def _pair(parts: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def row_digest(fields: list[T.StructField]) -> tuple[Column, Column]:
    """Both halves of the digest of a row with these columns; equal rows, nulls included, have one.

    Hashing passes over nulls, so marks that say which cells are null are hashed as well.
    """
    marks = []
    for start in range(0, len(fields), MARKS):
        mark = F.lit(0).cast("bigint")
        for i, f in enumerate(fields[start : start + MARKS]):
            mark = mark.bitwiseOR(F.when(cell(f.name).isNull(), F.lit(1 << i).cast("bigint")).otherwise(0))
        marks.append(mark)
    return _pair(marks + [hashable(cell(f.name), f.dataType) for f in fields])


def is_narrow(dtype: T.DataType) -> bool:
    """Whether a value of the type has 64 bits or fewer."""
    return isinstance(
        dtype, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.FloatType, T.DoubleType)
    )


def value_digest(value: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """Both halves of a value's digest: the first is null for a null only.

    One hash maps values of 64 bits or fewer one to one, so these have no second half.
    """
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint"), F.lit(None).cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("bigint"), F.lit(None).cast("bigint")
    if is_narrow(dtype):
        wide = value.cast("double") if isinstance(dtype, T.FloatType) else value
        return F.when(value.isNotNull(), F.xxhash64(wide)), F.lit(None).cast("bigint")
    first, second = _pair([hashable(value, dtype)])
    return F.when(value.isNotNull(), first), F.when(value.isNotNull(), second)
