"""Text columns as numbers for a model: codes where there are few values, means of the target for many."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.functions.cells import cell
from rowgauge.functions.typing import read_as
from rowgauge.sources.writers import use_shared_folder

#: A text column of so many values at most has a code for each.
FEW = 64
#: Parts of the training rows: a row's mean is taken over the rows of the others.
PARTS = 5
#: Rows of the whole table's mean that every value's mean is drawn to.
PRIOR = 10.0

# Plain names for the join, whatever the table's columns are called.
_VALUE, _TOTALS, _COUNTS, _PART = "__encoded_value", "__encoded_totals", "__encoded_counts", "__encoded_part"


def _part(columns: list[str]) -> Column:
    """A row's part; equal rows are in one, so none is a witness for its copy."""
    return F.pmod(F.xxhash64(*[cell(c).cast("string") for c in columns]), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class TextEncoder:
    """Fitted by fit_text. `codes` has at most FEW entries a column; `means` are tables that stay distributed."""

    columns: list[str] = field(default_factory=list)
    codes: dict[str, dict[str, float]] = field(default_factory=dict)
    means: dict[str, DataFrame] = field(default_factory=dict)
    whole: float = 0.0

    def apply(self, df: DataFrame, training: bool = False) -> DataFrame:
        """`df` with its text columns as numbers, in the same order.

        `training` rows get means over the rows of the other parts, so that no row's own label is in
        its feature; new rows get those over all. Values that were not seen have code 0, or the mean
        of the whole; nulls have code 0 or that mean too.
        """
        names = df.columns
        if self.means:
            df = df.withColumn(_PART, _part(self.columns))
        for name, table in self.means.items():
            joined = df.join(table, cell(name) == F.col(_VALUE), "left")
            total, count = (F.aggregate(c, F.lit(0.0), lambda x, y: x + y) for c in (_TOTALS, _COUNTS))
            if training:
                total, count = (x - F.get(F.col(c), F.col(_PART)) for x, c in ((total, _TOTALS), (count, _COUNTS)))
            mean = (total + PRIOR * self.whole) / (count + PRIOR)
            df = joined.withColumn(name, F.coalesce(mean, F.lit(self.whole))).drop(_VALUE, _TOTALS, _COUNTS)
        coded = {}
        for name, codes in self.codes.items():
            table = F.create_map(*[x for value, code in codes.items() for x in (F.lit(value), F.lit(code))])
            found = F.element_at(table, cell(name)) if codes else F.lit(None).cast("double")
            coded[name] = F.coalesce(found, F.lit(0.0))
        return df.select(*[coded[n].alias(n) if n in coded else cell(n) for n in names])


def fit_text(df: DataFrame, columns: Iterable[str], target: str | None = None, few: int = FEW) -> TextEncoder:
    """An encoder of the text columns among `columns`; runs a job for each and one for all.

    A column whose cells all read as numbers is left as it is. One of `few` values or fewer gets codes
    1, 2, ... by falling number of rows, then by value. One of more values gets for each value the
    mean of `target`, a number, drawn to that of all rows by PRIOR rows; without a target, the value's
    share of all rows. Only values and sums are shuffled, combined before, so a value that is a third
    of all rows is no burden; at most `few` + 1 values of a column come to the driver. Tables of means
    are written to the shared folder.
    """
    columns = list(columns)
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return TextEncoder(columns)
    value = F.lit(1.0) if target is None else cell(target).cast("double")
    found = df.agg(
        F.avg(value).alias("whole"), F.count(F.lit(1)).alias("n"),
        *[F.count_if((F.trim(cell(c)) != "") & read_as(cell(c), "float").isNull()).alias(f"words{i}") for i, c in enumerate(texts)],
    ).first()
    codes, means = {}, {}
    for i, name in enumerate(texts):
        if not found[f"words{i}"]:
            continue
        rows = df.select(cell(name).alias(_VALUE), value.alias("y"), _part(columns).alias(_PART)).where(F.col(_VALUE).isNotNull())
        first = rows.groupBy(_VALUE).count().orderBy(F.desc("count"), _VALUE).limit(few + 1).collect()
        if len(first) <= few:
            codes[name] = {r[0]: float(k + 1) for k, r in enumerate(first)}
            continue
        use_shared_folder(df.sparkSession)
        if target is None:
            # PRIOR rows of share 0 or so would only scale what is a share already.
            share = (F.count(F.lit(1)) / F.lit(float(found.n))).alias("share")
            table = rows.groupBy(_VALUE).agg(share).select(
                _VALUE, F.array(F.col("share") * PRIOR).alias(_TOTALS), F.array(F.lit(0.0)).alias(_COUNTS)
            )
        else:
            parts = [F.col(_PART) == k for k in range(PARTS)]
            table = rows.groupBy(_VALUE).agg(
                F.array(*[F.coalesce(F.sum(F.when(p, F.col("y"))), F.lit(0.0)) for p in parts]).alias(_TOTALS),
                F.array(*[F.count_if(p).cast("double") for p in parts]).alias(_COUNTS),
            )
        means[name] = table.checkpoint()
    return TextEncoder(columns, codes, means, float(found.whole or 0.0) if target is not None else 0.0)
