"""Bad records: set apart with a reason, counted, and saved."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell
from rowgauge.functions.typing import fits_type, type_name_of
from rowgauge.operators.schema import apply_schema
from rowgauge.sources.writers import save_table

# Column Spark puts an unparsable line in, names of the error types.
CORRUPT = "_corrupt_record"
MALFORMED = "MALFORMED_ROW"
TYPE_ERROR = "TYPE_ERROR"


class Split(NamedTuple):
    good: DataFrame
    bad: DataFrame


def _text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, T.StringType()) for f in schema.fields]
        + [T.StructField(CORRUPT, T.StringType())]
    )


def read_csv_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType, **options
) -> DataFrame:
    """CSV as text, lines with too few or too many fields kept whole in `_corrupt_record`."""
    settings = {"header": "true", "nullValue": "", **options}
    return (
        spark.read.schema(_text_schema(schema))
        .options(**settings, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .csv(path)
    )


def read_json_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines as text, unparsable lines kept whole in `_corrupt_record`."""
    return (
        spark.read.schema(_text_schema(schema))
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .json(path)
    )


def quarantine(
    df: DataFrame,
    schema: T.StructType,
    dataset: str,
    recorded_at: str | datetime.datetime | None = None,
) -> Split:
    """Split text rows into those that read as the schema, converted, and the rest.

    The rest is (timestamp, dataset, error_type, error_message, record), `record` being the raw
    line or the row as JSON. Both sides are projections of the input; nothing is shuffled.
    """
    fields = [f for f in schema.fields if f.name in df.columns]
    unreadable = F.array_compact(
        F.array(
            *[
                F.when(
                    ~fits_type(cell(f.name), df.schema[f.name].dataType, type_name_of(f.dataType)),
                    F.lit(f.name),
                )
                for f in fields
            ]
        )
    )
    broken = cell(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    columns = [n for n in df.columns if n != CORRUPT]
    moment = F.current_timestamp() if recorded_at is None else F.lit(str(recorded_at)).cast("timestamp")

    good = apply_schema(df.filter(~broken & (F.size(unreadable) == 0)).select(*map(cell, columns)), schema)
    as_json = F.to_json(F.struct(*[cell(n) for n in columns]))
    bad = df.filter(broken | (F.size(unreadable) > 0)).select(
        moment.alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        F.when(broken, MALFORMED).otherwise(TYPE_ERROR).alias("error_type"),
        F.when(broken, F.lit("Line does not fit the columns"))
        .otherwise(F.concat(F.lit("Invalid type: "), F.array_join(unreadable, ", ")))
        .alias("error_message"),
        (F.coalesce(cell(CORRUPT), as_json) if CORRUPT in df.columns else as_json).alias("record"),
    )
    return Split(good, bad)


def record_malformed(
    df: DataFrame,
    dataset: str,
    error_type: str,
    error_message: str,
    recorded_at: str | datetime.datetime | None = None,
) -> DataFrame:
    """Rows already known to be bad, in the shape of the quarantine."""
    moment = F.current_timestamp() if recorded_at is None else F.lit(str(recorded_at)).cast("timestamp")
    return df.select(
        moment.alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        F.lit(error_type).alias("error_type"),
        F.lit(error_message).alias("error_message"),
        F.to_json(F.struct("*")).alias("record"),
    )


def quarantine_summary(bad: DataFrame) -> DataFrame:
    """(dataset, error_type, count)."""
    return bad.groupBy("dataset", "error_type").agg(F.count(F.lit(1)).alias("count"))


def save_rejects(bad: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Write bad records as JSON lines; write nothing and return False when there are none."""
    if bad.isEmpty():
        return False
    save_table(bad, path, "json", mode)
    return True


def log_rejects(bad: DataFrame, path: str, batch: str) -> None:
    """Write a batch's bad records to the log at `path`, in place of what this batch wrote before.

    A rerun of a batch, also one without bad records left, leaves its records in the log once. Each
    batch has a partition `batch=<name>` of its own, so batches may be written at the same time; a
    write that fails is mended by writing the batch again. Names are letters, digits, `_`, `-` and `.`.
    """
    if not re.fullmatch("[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"unfit name of a batch: {batch}")
    save_table(bad, f"{path.rstrip('/')}/batch={batch}", "json", "overwrite")


def read_rejects(
    spark: SparkSession, path: str, batches: Iterable[str] | None = None
) -> DataFrame:
    """(timestamp, dataset, error_type, error_message, record, batch) of a log, of all batches or some.

    Only the partitions of the batches asked for are read.
    """
    found = spark.read.schema(
        "timestamp timestamp, dataset string, error_type string, error_message string, record string, batch string"
    ).json(path)
    return found if batches is None else found.filter(F.col("batch").isin(list(batches)))
