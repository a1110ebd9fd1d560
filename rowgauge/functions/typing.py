"""Type of a text value, and lossless conversion to a type, as plain column expressions.

Reading rules are anchored patterns followed by Spark's non-failing conversions, so a value
has one answer whatever the ANSI setting. Digits are ASCII only; blanks around numbers are
allowed, as they are for casts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings and patterns (Java date patterns).
MISSING_WORDS = ["null", "none", "nan"]
TRUE_WORDS = ["true", "1", "yes", "y", "on"]
FALSE_WORDS = ["false", "0", "no", "n", "off"]
TIMESTAMP_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy"]

INT_TEXT = r"^ *[+-]?[0-9]+ *$"
FLOAT_TEXT = r"^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$"
FLOAT_WORD = r"^(?i) *[+-]?(inf|infinity|nan) *$"

# Type names in order of preference; the position breaks ties of the majority vote.
TYPE_NAMES = ["int", "float", "bool", "timestamp", "date", "string"]

SPARK_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "string": T.StringType(),
}


def is_missing(text: Column) -> Column:
    return text.isNull() | (text == "") | F.lower(text).isin(MISSING_WORDS)


def is_int(text: Column) -> Column:
    return text.rlike(INT_TEXT)


def is_float(text: Column) -> Column:
    return text.rlike(FLOAT_TEXT) | text.rlike(FLOAT_WORD)


def is_bool(text: Column) -> Column:
    return F.lower(text).isin(TRUE_WORDS + FALSE_WORDS)


def read_int(text: Column) -> Column:
    """32-bit integer, or null."""
    return F.when(is_int(text), F.trim(text).try_cast("int"))


def read_long(text: Column) -> Column:
    return F.when(is_int(text), F.trim(text).try_cast("bigint"))


def read_float(text: Column) -> Column:
    return F.when(is_float(text), F.trim(text).try_cast("double"))


def read_bool(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def _shape(pattern: str) -> str:
    """The anchored digit shape of a date pattern, e.g. ^[0-9]{4}-[0-9]{2}-[0-9]{2}$."""
    shape = pattern.replace("'T'", "T")
    for field, digits in {"yyyy": 4, "MM": 2, "dd": 2, "HH": 2, "mm": 2, "ss": 2}.items():
        shape = shape.replace(field, f"[0-9]{{{digits}}}")
    return f"^{shape}$"


def _read_moment(text: Column, patterns: list[str]) -> Column:
    """First pattern whose shape fits; the length is tested first, as it costs next to nothing."""
    read = None
    for pattern in patterns:
        fits = (F.length(text) == len(pattern.replace("'T'", "T"))) & text.rlike(_shape(pattern))
        moment = F.try_to_timestamp(text, F.lit(pattern))
        read = F.when(fits, moment) if read is None else read.when(fits, moment)
    return read


def read_timestamp(text: Column) -> Column:
    return _read_moment(text, TIMESTAMP_PATTERNS)


def read_date(text: Column) -> Column:
    return _read_moment(text, DATE_PATTERNS).cast("date")


def value_type(text: Column) -> Column:
    """Name of the first type the value reads as; 'string' for missing and for the rest."""
    return _first_type(text, F.lit("string"), F.lit("int"))


def value_kind(text: Column) -> Column:
    """Like `value_type`, with 'missing' apart, and whole numbers as 'int', 'wide' (64 bits) or
    'huge' (more)."""
    whole = (
        F.when(read_int(text).isNotNull(), "int")
        .when(read_long(text).isNotNull(), "wide")
        .otherwise("huge")
    )
    return _first_type(text, F.lit("missing"), whole)


def _first_type(text: Column, missing: Column, whole: Column) -> Column:
    return (
        F.when(is_missing(text), missing)
        .when(is_int(text), whole)
        .when(is_float(text), "float")
        .when(is_bool(text), "bool")
        .when(read_timestamp(text).isNotNull(), "timestamp")
        .when(read_date(text).isNotNull(), "date")
        .otherwise("string")
    )


def read_as(text: Column, type_name: str) -> Column:
    """The text converted to the type; null when it does not read as one."""
    readers = {
        "int": read_int,
        "long": read_long,
        "float": read_float,
        "bool": read_bool,
        # A plain date reads as a timestamp at midnight.
        "timestamp": lambda t: F.coalesce(read_timestamp(t), _read_moment(t, DATE_PATTERNS)),
        "date": read_date,
        "string": lambda t: t,
    }
    if type_name not in readers:
        raise ValueError(f"unknown type name: {type_name}")
    return readers[type_name](text)


def fits_type(value: Column, dtype: T.DataType, expected: str) -> Column:
    """True for null and for values of the expected type; text is judged by its content.

    Typed columns are judged by their type: whole numbers also fit 'float', booleans also fit
    'int', everything fits 'string'.
    """
    if expected not in SPARK_TYPES:
        raise ValueError(f"unknown type name: {expected}")
    if isinstance(dtype, T.StringType):
        return value.isNull() | read_as(value, expected).isNotNull()
    natural = {
        "int": (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType),
        "long": (T.IntegralType, T.BooleanType),
        "float": (T.NumericType,),
        "bool": (T.BooleanType,),
        "timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType),
        "date": (T.DateType,),
        "string": (T.DataType,),
    }[expected]
    if isinstance(dtype, natural):
        return F.lit(True)
    if expected == "int" and isinstance(dtype, T.LongType):
        return value.isNull() | value.try_cast("int").isNotNull()
    return value.isNull()


def type_name_of(dtype: T.DataType) -> str:
    """The short type name closest to a Spark type."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.LongType):
        return "long"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.NumericType):
        return "float"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "string"
