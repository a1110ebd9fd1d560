"""Writing tables, and a shared place for intermediate ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell

FORMATS = ("parquet", "csv", "json")
MODES = ("overwrite", "append", "ignore", "error", "errorifexists")


def as_text_columns(df: DataFrame) -> DataFrame:
    """Nested and vector columns as JSON text, for formats that hold plain values only."""

    def plain(f: T.StructField):
        value = cell(f.name)
        if isinstance(f.dataType, VectorUDT):
            return F.to_json(vector_to_array(value)).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(value).alias(f.name)
        return value

    return df.select(*[plain(f) for f in df.schema.fields])


def _vectors_as_arrays(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            vector_to_array(cell(f.name)).alias(f.name)
            if isinstance(f.dataType, VectorUDT)
            else cell(f.name)
            for f in df.schema.fields
        ]
    )


def save_table(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", **options
) -> None:
    """Write a table: one pass, no counting. CSV gets a header."""
    if format not in FORMATS:
        raise ValueError(f"Unsupported file format: {format}")
    if mode not in MODES:
        raise ValueError(f"Unsupported mode: {mode}")
    settings = dict(options)
    if format == "csv":
        df = as_text_columns(df)
        settings.setdefault("header", "true")
    elif format == "json":
        df = _vectors_as_arrays(df)
    df.write.format(format).mode(mode).options(**settings).save(path)


def saved_rows(spark: SparkSession, path: str, format: str = "parquet") -> int:
    """Rows of a saved table, from the files rather than by computing the table again.

    Parquet answers from its footers; CSV is taken to have the header save_table writes.
    """
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", "true")
    return reader.load(path).count()


def save_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a metrics frame as JSON lines."""
    save_table(metrics, path, "json", mode)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir.

    Where the setting is absent, a session with a local master gets a temporary folder, once; a
    cluster session raises ValueError, since its executors would each write to their own disk.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rowgauge-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def use_shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a shared folder to write to."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
