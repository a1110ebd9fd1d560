"""Views with known faults over the given tables, in Spark and in SQL.

The given tables hold no null and no duplicate row, so most measures would be trivial on them.
Each view damages a whole table by a rule on its key; the SQL text says the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE_DATE = "2001-08-05"

DIRTY_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderdate",
    "o_orderpriority",
]
DIRTY_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]

# Column -> modulus of the order key at which it is null.
DIRTY_MODULI = {
    "o_custkey": 7,
    "o_orderstatus": 11,
    "o_totalprice": 13,
    "o_orderdate": 17,
    "o_orderpriority": 5,
}
COPY_MODULUS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with nulls in five columns and a second copy of every tenth row; one scan."""
    key = F.col("o_orderkey")
    copies = F.when(key % COPY_MODULUS == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return (
        table(spark, sf_dir, "orders")
        .select(
            *[
                F.when(key % DIRTY_MODULI[c] != 0, F.col(c)).alias(c) if c in DIRTY_MODULI
                else F.col(c)
                for c in DIRTY_COLUMNS
            ],
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


_DAMAGED = ", ".join(
    f"CASE WHEN o_orderkey % {DIRTY_MODULI[c]} <> 0 THEN {c} END AS {c}" if c in DIRTY_MODULI else c
    for c in DIRTY_COLUMNS
)
DIRTY_ORDERS = f"""damaged AS (SELECT {_DAMAGED} FROM orders),
dirty_orders AS (SELECT * FROM damaged
                 UNION ALL SELECT * FROM damaged WHERE o_orderkey % {COPY_MODULUS} = 0)"""


# Lineitem column -> modulus of the order key at which it is null.
WIDE_MODULI = {"l_quantity": 3, "l_returnflag": 7, "l_shipdate": 11}


def wide_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with nulls in three columns."""
    lineitem = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return lineitem.select(
        *[
            F.when(key % WIDE_MODULI[c] != 0, F.col(c)).alias(c) if c in WIDE_MODULI else F.col(c)
            for c in lineitem.columns
        ]
    )


WIDE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
WIDE_NULLS = "wide_nulls AS (SELECT " + ", ".join(
    f"CASE WHEN l_orderkey % {WIDE_MODULI[c]} <> 0 THEN {c} END AS {c}" if c in WIDE_MODULI else c
    for c in WIDE_COLUMNS
) + " FROM lineitem)"


def sql_percent(part: str, whole: str) -> str:
    return (
        f"coalesce({sql_rounded(f'CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0.0) * 100')}"
        ", 0.0)"
    )


def sql_rounded(value: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def fixed(value: Column, digits: int = 6) -> Column:
    """A per-row double cut to some decimals for comparison; plain arithmetic, so it is cheap."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def sql_fixed(value: str, digits: int = 6) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"floor(CAST({value} AS DOUBLE) * {scale} + 0.5::DOUBLE) / {scale}"


def sql_age(moment: str, reference: str = REFERENCE_DATE) -> str:
    """Age score of a timestamp expression in SQL."""
    return (
        f"CASE WHEN {moment} IS NOT NULL THEN CAST(greatest(0, least(100, 100 - 10 * floor("
        f"(epoch_us(TIMESTAMP '{reference}') - epoch_us(CAST({moment} AS TIMESTAMP)))"
        f" / 86400000000))) AS DOUBLE) END"
    )


def label_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label dimensions by rule on the order key, the label wrong at every 101st key."""
    key = F.col("o_orderkey")
    dims = {"completeness": 2, "consistency": 3, "validity": 5, "accuracy": 7}
    marked = table(spark, sf_dir, "orders").select(
        "o_orderkey", *[(key % m != 0).cast("int").alias(d) for d, m in dims.items()]
    )
    passed = sum((F.col(d) for d in dims), F.lit(0))
    by_rule = F.when(passed >= 3, 1).otherwise(0)
    return marked.withColumn(
        "final_label", F.when(key % 101 == 0, 1 - by_rule).otherwise(by_rule)
    )


LABEL_DIMS = """marked AS (SELECT o_orderkey, CAST(o_orderkey % 2 <> 0 AS INTEGER) AS completeness,
    CAST(o_orderkey % 3 <> 0 AS INTEGER) AS consistency,
    CAST(o_orderkey % 5 <> 0 AS INTEGER) AS validity,
    CAST(o_orderkey % 7 <> 0 AS INTEGER) AS accuracy FROM orders),
ruled AS (SELECT *, completeness + consistency + validity + accuracy AS passed,
    CASE WHEN completeness + consistency + validity + accuracy >= 3 THEN 1 ELSE 0 END AS by_rule
    FROM marked),
label_dims AS (SELECT o_orderkey, completeness, consistency, validity, accuracy,
    CASE WHEN o_orderkey % 101 = 0 THEN 1 - by_rule ELSE by_rule END AS final_label FROM ruled)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored records: label, prediction, a score with ties, and a dataset name."""
    key = F.col("event_id")
    truth = key % 3 == 0
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("dataset"),
        truth.cast("int").alias("truth"),
        (truth != (key % 10 == 0)).cast("int").alias("predicted"),
        ((key * 7919 % 1000) / 2000.0 + F.when(truth, 0.25).otherwise(0.0))
        .cast("double")
        .alias("score"),
    )


SCORED = """scored AS (SELECT event_id, event_type AS dataset, CAST(event_id % 3 = 0 AS INTEGER) AS truth,
    CAST((event_id % 3 = 0) <> (event_id % 10 = 0) AS INTEGER) AS predicted,
    CAST(event_id * 7919 % 1000 AS DOUBLE) / 2000.0
      + CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 0.0 END AS score FROM events)"""


def label_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with a second copy of every twentieth document's row."""
    copies = F.when(F.col("doc_id") % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return table(spark, sf_dir, "labels").select("*", F.explode(copies).alias("copy")).drop("copy")


LABEL_COPIES = """label_copies AS (SELECT * FROM labels
    UNION ALL SELECT * FROM labels WHERE doc_id % 20 = 0)"""


def raw_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text: `s` of eight kinds, and one column per type with one value in nine bad."""
    key = F.col("event_id")
    number = key.cast("string")
    kind = F.pmod(key, F.lit(8))
    s = (
        F.when(kind == 0, number)
        .when(kind == 1, "3.5")
        .when(kind == 2, "yes")
        .when(kind == 3, "2024-01-02")
        .when(kind == 4, "2024-01-02 03:04:05")
        .when(kind == 5, "abc")
        .when(kind == 6, "")
    )
    day = F.lpad((key % 28 + 1).cast("string"), 2, "0")

    def spoiled(place: int, bad: str, good) -> Column:
        return F.when(key % 9 == place, bad).otherwise(good)

    return table(spark, sf_dir, "events").select(
        "event_id",
        s.alias("s"),
        spoiled(0, "x1", number).alias("i"),
        spoiled(1, "n/a", F.concat(number, F.lit(".5"))).alias("f"),
        spoiled(2, "maybe", F.when(key % 2 == 0, "true").otherwise("No")).alias("b"),
        spoiled(3, "2024-02-31", F.concat(F.lit("2024-01-"), day)).alias("d"),
        spoiled(4, "2024-01-05 25:00:00", F.concat(F.lit("2024-01-"), day, F.lit(" 06:07:08"))).alias("t"),
    )


_DAY = "lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0')"
RAW_STRINGS = f"""raw_strings AS (SELECT event_id,
    CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '3.5' WHEN 2 THEN 'yes'
      WHEN 3 THEN '2024-01-02' WHEN 4 THEN '2024-01-02 03:04:05' WHEN 5 THEN 'abc'
      WHEN 6 THEN '' END AS s,
    CASE WHEN event_id % 9 = 0 THEN 'x1' ELSE CAST(event_id AS VARCHAR) END AS i,
    CASE WHEN event_id % 9 = 1 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) || '.5' END AS f,
    CASE WHEN event_id % 9 = 2 THEN 'maybe' WHEN event_id % 2 = 0 THEN 'true' ELSE 'No' END AS b,
    CASE WHEN event_id % 9 = 3 THEN '2024-02-31' ELSE '2024-01-' || {_DAY} END AS d,
    CASE WHEN event_id % 9 = 4 THEN '2024-01-05 25:00:00'
      ELSE '2024-01-' || {_DAY} || ' 06:07:08' END AS t FROM events)"""
