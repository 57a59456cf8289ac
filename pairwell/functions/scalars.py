"""Column functions of the study: keys, bins, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(start, end) -> Column:
    return F.datediff(F.col(end) if isinstance(end, str) else end, F.col(start) if isinstance(start, str) else start)


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")


def year_week(day: Column) -> Column:
    """Calendar year followed by the ISO week, so 2021-01-03 gives 202153."""
    return F.concat(F.year(day).cast("string"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def month_label(key: Column) -> Column:
    """``yyyymm`` shown as ``mm-yyyy``."""
    return F.regexp_replace(key, r"(\d{4})(\d{2})", "$2-$1")


def bin_left_closed(value: Column, breaks, labels) -> Column:
    """Label of the bin [break, next break); the last is open above. Below the first break the result is NULL."""
    chain = F.when(value.isNull() | (value < breaks[0]), F.lit(None).cast("string"))
    for upper, label in zip(breaks[1:], labels):
        chain = chain.when(value < upper, F.lit(label))
    return chain.otherwise(F.lit(labels[len(breaks) - 1]))


def arm_of(case_flag: Column, control_flag: Column) -> Column:
    """'1' for a treated subject, else '0' for an untreated one, else missing."""
    return F.when(case_flag == "1", F.lit("1")).when(control_flag == "1", F.lit("0"))
