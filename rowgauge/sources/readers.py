"""Reading tables: by extension, by directory, by catalog name."""

from __future__ import annotations

import datetime
import logging
import posixpath
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.operators.validate import CHECKS, validate_all, validate_groups
from rowgauge.sources.workbooks import read_xlsx

log = logging.getLogger(__name__)

# Reader options and their defaults. No other option reaches the reader.
CSV_OPTIONS = {
    "delimiter": ",",
    "header": "true",
    "inferSchema": "false",
    "encoding": "utf-8",
    "nullValue": "",
    "mode": "PERMISSIVE",
}
JSON_OPTIONS = {"multiline": "false", "encoding": "utf-8", "mode": "PERMISSIVE"}


def _options(defaults: Mapping[str, str], given: Mapping[str, object]) -> dict[str, object]:
    ignored = sorted(set(given) - set(defaults))
    if ignored:
        log.warning("reader options without effect: %s", ", ".join(ignored))
    return {name: given.get(name, default) for name, default in defaults.items()}


def _reader(spark: SparkSession, schema: T.StructType | str | None):
    return spark.read if schema is None else spark.read.schema(schema)


def read_csv(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """CSV with a header; every column is text unless a schema is given; empty means null."""
    return _reader(spark, schema).options(**_options(CSV_OPTIONS, options)).csv(path)


def read_json(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """JSON lines. Give a schema for large inputs: finding one reads all the data."""
    return _reader(spark, schema).options(**_options(JSON_OPTIONS, options)).json(path)


def read_parquet(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    _options({}, options)
    return _reader(spark, schema).parquet(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv,
    "json": read_json,
    "parquet": read_parquet,
    "xlsx": read_xlsx,
}


def format_of(path: str) -> str:
    """The format named by the path's extension, whatever its case."""
    extension = posixpath.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if extension not in READERS:
        raise ValueError(f"Unsupported file format: {extension or path}")
    return extension


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read a file or a directory of files; `format` overrules the extension."""
    name = format_of(path) if format is None else format.lower().lstrip(".")
    if name not in READERS:
        raise ValueError(f"Unsupported file format: {name}")
    return READERS[name](spark, path, **options)


class Validated(NamedTuple):
    rows: DataFrame
    report: DataFrame


def read_validated(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    expected_schema: T.StructType | None = None,
    **options,
) -> Validated:
    """The table and its validation report."""
    rows = read_table(spark, path, format, **options)
    return Validated(rows, validate_all(rows, expected_schema=expected_schema))


def list_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> list[str]:
    """Sorted paths of the files that match, and of the folders that match, which hold a table's part files.

    File contents are not read. Files in a folder that matches are parts of its table, and not listed.
    """
    folders = _matching_folders(spark, directory, pattern)
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(directory)
        .select("path")
    )
    files = [row["path"] for row in listing.collect()]
    return sorted([*folders, *(f for f in files if not f.startswith(tuple(f"{folder}/" for folder in folders)))])


def _matching_folders(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """Paths of the folders in a directory whose names match; names that Spark takes for hidden are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    wanted = jvm.org.apache.hadoop.fs.Path(directory, pattern)
    found = wanted.getFileSystem(conf).globStatus(wanted) or []
    return [
        status.getPath().toString() for status in found
        if status.isDirectory() and not status.getPath().getName().startswith((".", "_"))
    ]


class Directory(NamedTuple):
    """Tables by name of file or folder, the reason for each that could not be opened, and reports if asked for."""

    tables: dict[str, DataFrame]
    failures: dict[str, str]
    reports: dict[str, DataFrame]


def read_directory(
    spark: SparkSession,
    directory: str,
    pattern: str = "*.csv",
    format: str | None = None,
    validate: bool = False,
    expected_schema: T.StructType | None = None,
    **options,
) -> Directory:
    """One frame per file, or per folder of part files whose name matches. One that cannot be opened is
    reported and skipped.

    With `validate`, every table gets its validation report.
    """
    found = Directory({}, {}, {})
    for path in list_files(spark, directory, pattern):
        name = posixpath.basename(path)
        try:
            rows = read_table(spark, path, format, **options)
            if validate:
                found.reports[name] = validate_all(rows, expected_schema=expected_schema)
            found.tables[name] = rows
        except (PySparkException, ValueError) as error:
            log.error("cannot read %s: %s", name, error)
            found.failures[name] = str(error)
        except Exception as error:  # Java errors outside PySpark's own hierarchy
            if type(error).__module__.partition(".")[0] != "py4j":
                raise
            log.error("cannot read %s: %s", name, error)
            found.failures[name] = str(error)
    return found


def read_directory_as_one(
    spark: SparkSession,
    directory: str,
    pattern: str = "*.csv",
    format: str = "csv",
    schema=None,
    **options,
) -> DataFrame:
    """All files of one layout as a single frame with a `file_name` column."""
    frame = _files_of_one_layout(spark, directory, pattern, format, schema, options)
    return frame.select("*", F.col("_metadata.file_name").alias("file_name"))


def _files_of_one_layout(
    spark: SparkSession, directory: str, pattern: str, format: str, schema, options: Mapping[str, object]
) -> DataFrame:
    defaults = {"csv": CSV_OPTIONS, "json": JSON_OPTIONS, "parquet": {}}
    if format not in defaults:
        raise ValueError(f"Unsupported file format: {format}")
    reader = _reader(spark, schema).options(**_options(defaults[format], options))
    return reader.option("pathGlobFilter", pattern).format(format).load(directory)


def validate_directory(
    spark: SparkSession,
    directory: str,
    pattern: str = "*.csv",
    format: str = "csv",
    schema=None,
    checks: Iterable[str] = CHECKS,
    expected_schema: T.StructType | None = None,
    expected_types: dict[str, str] | None = None,
    run_at: str | datetime.datetime | None = None,
    **options,
) -> DataFrame:
    """A report for each file: (file_path, check, is_valid, violations, run_at).

    The files have one layout. All are read in one scan and judged in one aggregate by file (see
    `validate_groups`), so there is no job per file and no path comes to the driver. Files without
    rows come from the listing, which reads no contents, and have no violations but of the schema.
    """
    path = F.col("_metadata.file_path").alias("__file_path")
    rows = _files_of_one_layout(spark, directory, pattern, format, schema, options).select("*", path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select(path)
    return validate_groups(
        rows, ["__file_path"], checks, expected_schema, expected_types, run_at, files
    ).withColumnRenamed("__file_path", "file_path")


@dataclass(frozen=True)
class TableSpec:
    """A named table: where it lies, how to read it, and what to expect of it."""

    path: str
    format: str | None = None
    pattern: str | None = None
    rows_expected: int | None = None
    columns: int | None = None
    tables_expected: int | None = None
    options: Mapping[str, object] = field(default_factory=dict)


class Catalog:
    """Named tables given by the caller. A spec with a pattern stands for a directory."""

    def __init__(self, specs: Mapping[str, TableSpec]):
        self.specs = dict(specs)

    def spec(self, name: str) -> TableSpec:
        if name not in self.specs:
            raise ValueError(f"Unknown dataset: {name}")
        return self.specs[name]

    def load(
        self, spark: SparkSession, name: str, validate: bool = False
    ) -> DataFrame | Validated | Directory:
        """The table, with `validate` also its report; a directory's come per file."""
        spec = self.spec(name)
        if spec.pattern is not None:
            return read_directory(
                spark, spec.path, spec.pattern, spec.format, validate, **spec.options
            )
        read = read_validated if validate else read_table
        return read(spark, spec.path, spec.format, **spec.options)

    def expectations(self, spark: SparkSession) -> DataFrame:
        """(dataset, check, expected, actual, is_valid) for every spec.

        Rows and columns, and for a directory the number of tables that could be opened; its rows
        are those of all tables, its columns those that any of them has.
        """
        parts = []
        for name, spec in self.specs.items():
            loaded = self.load(spark, name)
            frames = list(loaded.tables.values()) if isinstance(loaded, Directory) else [loaded]
            columns = len({c for frame in frames for c in frame.columns})
            checks = [("rows", spec.rows_expected, F.col("n")), ("columns", spec.columns, F.lit(columns))]
            if spec.pattern is not None:
                checks.append(("tables", spec.tables_expected, F.lit(len(frames))))
            rows = F.array(
                *[
                    F.struct(
                        F.lit(check).alias("check"),
                        F.lit(expected).cast("bigint").alias("expected"),
                        actual.cast("bigint").alias("actual"),
                    )
                    for check, expected, actual in checks
                ]
            )
            counts = [frame.agg(F.count(F.lit(1)).alias("n")) for frame in frames]
            counted = reduce(DataFrame.unionAll, counts) if counts else spark.range(0).select(F.col("id").alias("n"))
            parts.append(
                counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
                    F.lit(name).alias("dataset"), F.inline(rows)
                )
            )
        if not parts:
            raise ValueError("no spec in the catalog")
        verdict = F.coalesce(F.col("expected") == F.col("actual"), F.lit(True))
        return reduce(DataFrame.unionAll, parts).select("*", verdict.alias("is_valid"))


def available(
    spark: SparkSession, paths: Mapping[str, str], **options
) -> dict[str, DataFrame]:
    """Those of the named sources that exist."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = read_table(spark, path, **options)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("source %s is absent: %s", name, path)
    return found


def source_inventory(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(name, status, rows) of named sources; absent ones have null rows."""
    found = available(spark, paths)
    parts = []
    for name in paths:
        if name in found:
            counted = found[name].agg(F.count(F.lit(1)).alias("rows"))
        else:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))
        status = "loaded" if name in found else "missing"
        parts.append(counted.select(F.lit(name).alias("name"), F.lit(status).alias("status"), "rows"))
    return reduce(DataFrame.unionAll, parts)
