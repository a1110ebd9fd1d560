"""Queries: reading, writing and quarantine. Each writes a given table out and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.operators import metrics
from rowgauge.operators.schema import apply_schema
from rowgauge.sources import quarantine, readers, writers
from rowgauge.sources.workbooks import register_xlsx
from workload.quality import ALL_METRICS, COUNTED, WITH
from workload.registry import query
from workload.workbook_fixture import write_workbooks
from workload.types import EXPECTED, read_sql, valid_sql
from workload.views import (
    DIRTY_ORDERS,
    RAW_STRINGS,
    REFERENCE_DATE,
    dirty_orders,
    fixed,
    raw_strings,
    sql_fixed,
    table,
)

ORDER_TYPES = (
    T.StructType()
    .add("o_orderkey", T.LongType())
    .add("o_custkey", T.LongType())
    .add("o_orderstatus", T.StringType())
    .add("o_totalprice", T.DoubleType())
    .add("o_orderdate", T.TimestampType())
    .add("o_orderpriority", T.StringType())
)


def _texts(df: DataFrame) -> DataFrame:
    """Orders with the date in a form the readers know."""
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _typed(df: DataFrame) -> DataFrame:
    found = apply_schema(df, ORDER_TYPES)
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


DIRTY = f"WITH {DIRTY_ORDERS} SELECT * FROM dirty_orders"


@query("scan_csv", DIRTY)
def _(spark, sf):
    path = writers.scratch_path(spark, "scan") + ".csv"
    writers.save_table(_texts(dirty_orders(spark, sf)), path, "csv")
    return _typed(readers.read_table(spark, path))


@query("scan_json", DIRTY)
def _(spark, sf):
    path = writers.scratch_path(spark, "scan") + ".json"
    writers.save_table(_texts(dirty_orders(spark, sf)), path, "json")
    return _typed(readers.read_table(spark, path))


@query("scan_parquet", "SELECT * FROM orders")
def _(spark, sf):
    return readers.read_table(spark, f"{sf}/orders.parquet")


@query(
    "scan_validated",
    f'WITH {DIRTY_ORDERS} SELECT "check", is_valid, violations FROM (VALUES '
    "('schema', true, CAST(0 AS BIGINT)), ('data_types', true, CAST(0 AS BIGINT))) "
    't("check", is_valid, violations) UNION ALL '
    "SELECT 'nulls', n = 0, n FROM (SELECT count(*) FILTER (o_custkey IS NULL) "
    "+ count(*) FILTER (o_orderstatus IS NULL) + count(*) FILTER (o_totalprice IS NULL) "
    "+ count(*) FILTER (o_orderdate IS NULL) + count(*) FILTER (o_orderpriority IS NULL) AS n "
    "FROM dirty_orders) UNION ALL SELECT 'duplicates', n = 0, n FROM "
    "(SELECT (SELECT count(*) FROM dirty_orders) - count(*) AS n FROM (SELECT DISTINCT * FROM dirty_orders))",
)
def _(spark, sf):
    path = writers.scratch_path(spark, "validated") + ".parquet"
    writers.save_table(dirty_orders(spark, sf), path)
    return readers.read_validated(spark, path).report.drop("run_at")


def _by_file_sql() -> str:
    nulls = " + ".join(f"count(*) FILTER ({n} IS NULL)" for n in ORDER_TYPES.fieldNames())
    return (
        f"WITH {DIRTY_ORDERS}, parts AS (SELECT *, o_orderkey % 4 AS part FROM dirty_orders), "
        f"counted AS (SELECT part, {nulls} AS nulls, count(*) AS n, count(o_orderpriority) AS wrong "
        "FROM parts GROUP BY part), d AS (SELECT part, count(*) AS n FROM (SELECT DISTINCT * FROM parts) GROUP BY part), "
        "v AS (SELECT part, 'nulls' AS \"check\", nulls AS violations FROM counted UNION ALL "
        "SELECT part, 'duplicates', counted.n - d.n FROM counted JOIN d USING (part) UNION ALL "
        "SELECT part, 'data_types', wrong FROM counted UNION ALL SELECT part, 'schema', 6 FROM counted) "
        "SELECT CAST(part AS INTEGER) AS part, \"check\", violations = 0 AS is_valid, violations FROM v"
    )


@query("validate_directory", _by_file_sql())
def _(spark, sf):
    """Four files of CSV; a text column is expected to hold whole numbers, and six columns are too many."""
    path = writers.scratch_path(spark, "by_file")
    orders = _texts(dirty_orders(spark, sf)).withColumn("part", F.col("o_orderkey") % 4)
    orders.repartition("part").write.partitionBy("part").option("header", True).csv(path)
    found = readers.validate_directory(
        spark, f"{path}/*", "*.csv", expected_schema=T.StructType(),
        expected_types={"o_totalprice": "float", "o_orderpriority": "int"},
    )
    part = F.regexp_extract("file_path", "part=([0-9]+)", 1).cast("int")
    return found.select(part.alias("part"), "check", "is_valid", "violations")


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@query(
    "scan_directory",
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file_name, count(*) AS rows FROM {t}" for t in TABLES
    ),
)
def _(spark, sf):
    tables = readers.read_directory(spark, sf, "*.parquet").tables
    counts = [
        frame.agg(F.lit(name).alias("file_name"), F.count(F.lit(1)).alias("rows"))
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


@query("scan_directory_as_one", f"WITH {DIRTY_ORDERS} SELECT *, true AS from_csv FROM dirty_orders")
def _(spark, sf):
    path = writers.scratch_path(spark, "parts")
    orders = _texts(dirty_orders(spark, sf))
    writers.save_table(orders.repartition(4, "o_orderpriority"), path, "csv")
    found = readers.read_directory_as_one(spark, path, "*.csv")
    return _typed(found.withColumn("from_csv", F.col("file_name").endswith(".csv")).drop("file_name"))


@query(
    "catalog_expectations",
    "SELECT 'orders' AS dataset, 'rows' AS \"check\", CAST(15000 AS BIGINT) AS expected, "
    "count(*) AS actual, count(*) = 15000 AS is_valid FROM orders UNION ALL "
    "SELECT 'orders', 'columns', 6, 6, true UNION ALL "
    "SELECT 'customer', 'rows', 1, count(*), count(*) = 1 FROM customer UNION ALL "
    "SELECT 'customer', 'columns', NULL, 5, true",
)
def _(spark, sf):
    specs = {
        "orders": readers.TableSpec(f"{sf}/orders.parquet", rows_expected=15000, columns=6),
        "customer": readers.TableSpec(f"{sf}/customer.parquet", rows_expected=1),
    }
    return readers.Catalog(specs).expectations(spark)


@query(
    "source_inventory",
    "SELECT 'labels' AS name, 'loaded' AS status, count(*) AS rows FROM labels UNION ALL "
    "SELECT 'documents', 'loaded', count(*) FROM documents UNION ALL SELECT 'reviews', 'missing', NULL",
)
def _(spark, sf):
    names = ("labels", "documents", "reviews")
    return readers.source_inventory(spark, {n: f"{sf}/{n}.parquet" for n in names})


# Sinks ----------------------------------------------------------------------------------------


@query("roundtrip_parquet", DIRTY)
def _(spark, sf):
    path = writers.scratch_path(spark, "out") + ".parquet"
    writers.save_table(dirty_orders(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "roundtrip_csv",
    "SELECT vec_id, label, len(embedding) AS width, CAST(list_min(embedding) AS DOUBLE) AS smallest, "
    "CAST(list_max(embedding) AS DOUBLE) AS largest, "
    f"{sql_fixed('list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i))', 4)} AS weighed "
    "FROM embeddings",
)
def _(spark, sf):
    path = writers.scratch_path(spark, "out") + ".csv"
    writers.save_table(table(spark, sf, "embeddings"), path, "csv", escape='"')
    found = spark.read.csv(path, header=True, escape='"')
    vector = F.from_json("embedding", "array<float>")
    weighed = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return found.select(
        F.col("vec_id").try_cast("bigint").alias("vec_id"),
        F.col("label").try_cast("int").alias("label"),
        F.size(vector).cast("bigint").alias("width"),
        F.array_min(vector).cast("double").alias("smallest"),
        F.array_max(vector).cast("double").alias("largest"),
        fixed(F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b), 4).alias("weighed"),
    )


@query("roundtrip_json", f"{WITH}, {COUNTED} {ALL_METRICS}")
def _(spark, sf):
    path = writers.scratch_path(spark, "metrics")
    writers.save_metrics(metrics.all_metrics(dirty_orders(spark, sf), REFERENCE_DATE), path)
    return spark.read.schema(
        "metric string, level string, column_name string, value double"
    ).json(path)


# Quarantine -----------------------------------------------------------------------------------

RAW_TYPES = (
    T.StructType()
    .add("event_id", T.LongType())
    .add("i", T.IntegerType())
    .add("f", T.DoubleType())
    .add("b", T.BooleanType())
    .add("d", T.DateType())
    .add("t", T.TimestampType())
)


def _raw_csv(spark, sf, which=None) -> DataFrame:
    """Events as CSV lines; every 25th line lacks a field, every 40th has one too many."""
    path = writers.scratch_path(spark, "raw")
    raw = raw_strings(spark, sf) if which is None else raw_strings(spark, sf).filter(which)
    full = F.concat_ws(",", "event_id", "i", "f", "b", "d", "t")
    line = (
        F.when(F.col("event_id") % 25 == 0, F.concat_ws(",", "event_id", "i", "f", "b", "d"))
        .when(F.col("event_id") % 40 == 0, F.concat_ws(",", full, F.lit("extra")))
        .otherwise(full)
    )
    raw.select(line.alias("value")).write.text(path)
    return quarantine.read_csv_with_rejects(spark, path, RAW_TYPES, header="false")


def _split(spark, sf) -> quarantine.Split:
    return quarantine.quarantine(_raw_csv(spark, sf), RAW_TYPES, "events", "2024-02-01")


_BROKEN = "(event_id % 25 = 0 OR event_id % 40 = 0)"
_READABLE = " AND ".join(valid_sql(c) for c in EXPECTED)


@query(
    "quarantine_good",
    f"WITH {RAW_STRINGS} SELECT event_id, "
    + ", ".join(f"{read_sql(c, t)} AS {c}" for c, t in EXPECTED.items())
    + f" FROM raw_strings WHERE NOT {_BROKEN} AND {_READABLE}",
)
def _(spark, sf):
    good = _split(spark, sf).good
    return good.withColumn("t", F.col("t").cast("timestamp_ntz"))


_FULL = "concat_ws(',', CAST(event_id AS VARCHAR), i, f, b, d, t)"
_BAD_NAMES = ", ".join(f"CASE WHEN NOT {valid_sql(c)} THEN '{c}' END" for c in EXPECTED)
_BAD = (
    f"SELECT 'events' AS dataset, CASE WHEN {_BROKEN} THEN 'MALFORMED_ROW' ELSE 'TYPE_ERROR' END AS error_type, "
    f"CASE WHEN {_BROKEN} THEN 'Line does not fit the columns' "
    f"ELSE 'Invalid type: ' || concat_ws(', ', {_BAD_NAMES}) END AS error_message, "
    f"CASE WHEN event_id % 25 = 0 THEN concat_ws(',', CAST(event_id AS VARCHAR), i, f, b, d) "
    f"WHEN event_id % 40 = 0 THEN {_FULL} || ',extra' ELSE "
    "'{\"event_id\":\"' || event_id || '\",\"i\":\"' || i || '\",\"f\":\"' || f || '\",\"b\":\"' || b "
    "|| '\",\"d\":\"' || d || '\",\"t\":\"' || t || '\"}' END AS record "
    f"FROM raw_strings WHERE {_BROKEN} OR NOT ({_READABLE})"
)


@query("quarantine_bad", f"WITH {RAW_STRINGS} {_BAD}")
def _(spark, sf):
    return _split(spark, sf).bad.drop("timestamp")


@query(
    "quarantine_summary",
    f"WITH {RAW_STRINGS}, bad AS ({_BAD}) SELECT dataset, error_type, count(*) AS count FROM bad GROUP BY ALL",
)
def _(spark, sf):
    return quarantine.quarantine_summary(_split(spark, sf).bad)


@query(
    "record_malformed",
    "SELECT 'orders' AS dataset, 'MISSING_VALUE' AS error_type, 'No customer' AS error_message, "
    "'{\"o_orderkey\":' || o_orderkey || '}' AS record FROM orders WHERE o_orderkey % 7 = 0",
)
def _(spark, sf):
    nameless = dirty_orders(spark, sf).filter("o_custkey IS NULL").select("o_orderkey").distinct()
    found = quarantine.record_malformed(nameless, "orders", "MISSING_VALUE", "No customer")
    return found.drop("timestamp")


def _workbooks(spark, sf) -> str:
    """Orders as workbooks in a new folder, in two layouts."""
    path = writers.scratch_path(spark, "workbooks")
    orders = _texts(dirty_orders(spark, sf)).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    tasks = max(4, spark.sparkContext.defaultParallelism)
    write_workbooks(orders.repartition(tasks, "o_orderkey"), path)
    return path


@query("scan_xlsx", DIRTY)
def _(spark, sf):
    found = readers.read_table(spark, _workbooks(spark, sf), format="xlsx")
    return _typed(found.select(ORDER_TYPES.fieldNames()))


@query("scan_xlsx_source", DIRTY)
def _(spark, sf):
    register_xlsx(spark)
    found = spark.read.format("xlsx").load(_workbooks(spark, sf))
    return _typed(found.select(ORDER_TYPES.fieldNames()))


# One log of many batches ----------------------------------------------------------------------


@query(
    "reject_log",
    f"WITH {RAW_STRINGS} " + _BAD.replace("SELECT ", "SELECT 'part-' || (event_id % 3) AS batch, ", 1),
)
def _(spark, sf):
    path = writers.scratch_path(spark, "rejects")
    for part in (0, 1, 2, 1):  # a batch that is written again replaces itself
        raw = _raw_csv(spark, sf, F.col("event_id") % 3 == part)
        bad = quarantine.quarantine(raw, RAW_TYPES, "events", "2024-02-01").bad
        quarantine.log_rejects(bad, path, f"part-{part}")
    return quarantine.read_rejects(spark, path).drop("timestamp")
