"""Queries: type inference, type checks, conversion, and model input columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell
from rowgauge.operators import metrics, schema, validate
from workload.registry import query
from workload.views import DIRTY_ORDERS, RAW_STRINGS, dirty_orders, raw_strings, sql_percent, table

TEXTS = ["s", "i", "f", "b", "d", "t"]
EXPECTED = {"i": "int", "f": "float", "b": "bool", "d": "date", "t": "timestamp"}

INT_TEXT = "^ *[+-]?[0-9]+ *$"
FLOAT_TEXT = "^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$"
WORDS = "('true','1','yes','y','on','false','0','no','n','off')"
DATES = {
    "[0-9]{4}-[0-9]{2}-[0-9]{2}": "%Y-%m-%d",
    "[0-9]{4}/[0-9]{2}/[0-9]{2}": "%Y/%m/%d",
    "[0-9]{2}/[0-9]{2}/[0-9]{4}": "%m/%d/%Y",
    "[0-9]{2}-[0-9]{2}-[0-9]{4}": "%d-%m-%Y",
}
TIMES = {
    "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}": "%Y-%m-%d %H:%M:%S",
    "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}": "%Y-%m-%dT%H:%M:%S",
}


def moment_sql(c: str, shapes: dict[str, str]) -> str:
    parts = [
        f"CASE WHEN regexp_matches({c}, '^{shape}$') THEN try_strptime({c}, '{fmt}') END"
        for shape, fmt in shapes.items()
    ]
    return f"coalesce({', '.join(parts)})"


def type_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' OR lower({c}) IN ('null','none','nan') THEN 'string' "
        f"WHEN regexp_matches({c}, '{INT_TEXT}') THEN 'int' "
        f"WHEN regexp_matches({c}, '{FLOAT_TEXT}') "
        f"OR regexp_matches(lower({c}), '^ *[+-]?(inf|infinity|nan) *$') THEN 'float' "
        f"WHEN lower({c}) IN {WORDS} THEN 'bool' "
        f"WHEN {moment_sql(c, TIMES)} IS NOT NULL THEN 'timestamp' "
        f"WHEN {moment_sql(c, DATES)} IS NOT NULL THEN 'date' ELSE 'string' END"
    )


def read_sql(c: str, kind: str) -> str:
    return {
        "int": f"CASE WHEN regexp_matches({c}, '{INT_TEXT}') THEN TRY_CAST(trim({c}) AS INTEGER) END",
        "float": f"CASE WHEN regexp_matches({c}, '{FLOAT_TEXT}') THEN TRY_CAST(trim({c}) AS DOUBLE) END",
        "bool": f"CASE WHEN lower({c}) IN {WORDS} THEN lower({c}) IN ('true','1','yes','y','on') END",
        "date": f"CAST({moment_sql(c, DATES)} AS DATE)",
        "timestamp": f"CAST({moment_sql(c, TIMES | DATES)} AS TIMESTAMP)",
    }[kind]


@query(
    "infer_value_type",
    f"WITH {RAW_STRINGS}, l AS (SELECT event_id, unnest(['s','i','f','b','d','t']) AS column_name, "
    f"unnest([s, i, f, b, d, t]) AS v FROM raw_strings) SELECT event_id, column_name, {type_sql('v')} "
    "AS value_type FROM l",
)
def _(spark, sf):
    long = raw_strings(spark, sf).unpivot(["event_id"], TEXTS, "column_name", "v")
    return schema.infer_value_types(long, "v").select("event_id", "column_name", "value_type")


_VOTES = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, ty, count(*) AS n FROM typed_{c} "
    "WHERE ty <> 'string' GROUP BY ty"
    for i, c in enumerate(TEXTS)
)
_TYPED = ", ".join(
    f"typed_{c} AS (SELECT {type_sql(c)} AS ty FROM raw_strings)" for c in TEXTS
)


@query(
    "infer_column_type",
    f"WITH {RAW_STRINGS}, {_TYPED}, votes AS ({_VOTES}), ranked AS (SELECT *, row_number() OVER ("
    "PARTITION BY column_name ORDER BY n DESC, list_position(['int','float','bool','timestamp','date'], ty)"
    ") AS rn FROM votes) SELECT ordinal, column_name, ty AS inferred_type FROM ranked WHERE rn = 1",
)
def _(spark, sf):
    return schema.infer_column_types(raw_strings(spark, sf), TEXTS)


_STRICT = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)",
    "o_totalprice": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)",
    "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')",
    "o_orderstatus": "o_orderstatus",
}


def _strict_sql(ordinal: int, c: str) -> str:
    kinds = f"(SELECT DISTINCT {type_sql(_STRICT[c])} AS ty FROM dirty_orders WHERE {c} IS NOT NULL)"
    return (
        f"SELECT {ordinal} AS ordinal, '{c}' AS column_name, CASE WHEN count(*) = 1 THEN max(ty) "
        f"WHEN count(*) = count(*) FILTER (ty IN ('int', 'float')) THEN 'float' ELSE 'string' END "
        f"AS inferred_type FROM {kinds}"
    )


@query(
    "infer_column_type_strict",
    f"WITH {DIRTY_ORDERS} " + " UNION ALL ".join(_strict_sql(i, c) for i, c in enumerate(_STRICT)),
)
def _(spark, sf):
    texts = dirty_orders(spark, sf).select(
        F.col("o_orderkey").cast("string"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        "o_orderstatus",
    )
    return schema.infer_column_types(texts, policy="strict")


@query(
    "apply_inferred_schema",
    f"WITH {RAW_STRINGS} SELECT event_id, "
    + ", ".join(f"{read_sql(c, t)} AS {c}" for c, t in EXPECTED.items())
    + " FROM raw_strings",
)
def _(spark, sf):
    texts = raw_strings(spark, sf).drop("s")
    found = schema.apply_schema(texts, schema.infer_schema(texts, list(EXPECTED)))
    return found.withColumn("t", F.col("t").cast("timestamp_ntz"))


def valid_sql(c: str) -> str:
    return f"({c} IS NULL OR {read_sql(c, EXPECTED[c])} IS NOT NULL)"


@query(
    "type_check",
    f"WITH {RAW_STRINGS} SELECT event_id, i, f, b, d, t, "
    + ", ".join(f"{valid_sql(c)} AS {c}_valid" for c in EXPECTED)
    + " FROM raw_strings",
)
def _(spark, sf):
    return schema.type_check(raw_strings(spark, sf).drop("s"), EXPECTED)


@query(
    "validate_types",
    f"WITH {RAW_STRINGS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS expected_type, count(*) AS checked, "
        f"count(*) FILTER (NOT {valid_sql(c)}) AS invalid_count, "
        f"CASE WHEN count(*) FILTER (NOT {valid_sql(c)}) = 0 THEN 'valid' ELSE 'invalid' END AS status "
        "FROM raw_strings"
        for c, t in EXPECTED.items()
    ),
)
def _(spark, sf):
    return validate.validate_types(raw_strings(spark, sf), EXPECTED)


@query(
    "type_validity_column",
    f"WITH {RAW_STRINGS} "
    + " UNION ALL ".join(
        f"SELECT 'type_validity' AS metric, 'column' AS level, '{c}' AS column_name, "
        f"{sql_percent(f'count(*) FILTER ({valid_sql(c)})', 'count(*)')} AS value FROM raw_strings"
        for c in EXPECTED
    ),
)
def _(spark, sf):
    return metrics.type_validity_column(raw_strings(spark, sf), EXPECTED)


_FITTING = " + ".join(f"CAST({valid_sql(c)} AS INTEGER)" for c in EXPECTED)


@query(
    "type_validity_dataset",
    f"WITH {RAW_STRINGS} SELECT 'type_validity' AS metric, 'dataset' AS level, "
    "CAST(NULL AS VARCHAR) AS column_name, "
    f"{sql_percent(f'sum({_FITTING})', f'count(*) * {len(EXPECTED)}')} AS value FROM raw_strings",
)
def _(spark, sf):
    return metrics.type_validity_dataset(raw_strings(spark, sf), EXPECTED)


@query(
    "type_validity_row",
    f"WITH {RAW_STRINGS} SELECT event_id, CAST({_FITTING} AS DOUBLE) / {len(EXPECTED)} * 100 "
    "AS row_type_validity FROM raw_strings",
)
def _(spark, sf):
    found = schema.row_type_validity(raw_strings(spark, sf), EXPECTED)
    return found.select("event_id", "row_type_validity")


@query(
    "validate_schema",
    "SELECT column_name, CASE column_name WHEN 'o_orderkey' THEN 'bigint' WHEN 'o_totalprice' THEN "
    "'string' WHEN 'o_note' THEN 'string' END AS expected_type, CASE column_name WHEN 'o_note' THEN NULL "
    "WHEN 'o_totalprice' THEN 'double' WHEN 'o_orderdate' THEN 'timestamp_ntz' WHEN 'o_orderkey' THEN 'bigint' "
    "WHEN 'o_custkey' THEN 'bigint' ELSE 'string' END AS actual_type, CASE column_name WHEN 'o_orderkey' "
    "THEN 'valid' WHEN 'o_totalprice' THEN 'type_mismatch' WHEN 'o_note' THEN 'missing' ELSE 'unexpected' "
    "END AS status FROM (SELECT column_name FROM (DESCRIBE orders) UNION ALL SELECT 'o_note')",
)
def _(spark, sf):
    expected = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_totalprice", T.StringType()),
            T.StructField("o_note", T.StringType()),
        ]
    )
    return validate.validate_schema(table(spark, sf, "orders"), expected).drop("nullable")


@query(
    "cast_features",
    f"WITH {RAW_STRINGS} SELECT event_id, "
    + ", ".join(f"coalesce({read_sql(c, 'float')}, 0.0) AS {c}" for c in TEXTS)
    + " FROM raw_strings",
)
def _(spark, sf):
    return schema.numeric_features(raw_strings(spark, sf), TEXTS).select(
        "event_id", *[cell(c) for c in TEXTS]
    )
