"""Age score: 100 for today, ten points less for every full day, never outside 0..100."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points lost per day of age, score of a table without dates.
POINTS_PER_DAY = 10
NO_DATE_SCORE = 100.0

MICROS_PER_DAY = 86_400_000_000


def reference_point(reference_date: str | datetime.date | datetime.datetime | None) -> Column:
    """The moment ages are measured at; the start of the query when none is given."""
    if reference_date is None:
        return F.current_timestamp()
    return F.lit(str(reference_date)).cast("timestamp")


def age_score(moment: Column, reference: Column) -> Column:
    """Score of one moment; null for a null moment. Part days are floored."""
    micros = F.unix_micros(reference) - F.unix_micros(moment.cast("timestamp"))
    days = F.floor(micros / F.lit(MICROS_PER_DAY))
    score = F.lit(100) - days * F.lit(POINTS_PER_DAY)
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("double")
    return F.when(moment.isNotNull(), bounded)
