"""Text of report tables. Numbers are rounded from their binary value, half to even, as C's printf does."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fixed(value, digits: int) -> str:
    if value is None:
        return "NA"
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Inf" if value > 0 else "-Inf"
    return f"{value:.{digits}f}"


@F.pandas_udf(T.StringType())
def _fixed_udf(value: pd.Series, digits: pd.Series) -> pd.Series:
    # a NULL arrives as NaN in a float series; callers mark it before
    return pd.Series([_fixed(v, int(d)) for v, d in zip(value, digits)])


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text; ``NA`` for NULL, ``NaN`` and ``Inf`` as such. For report rows only."""
    return F.when(value.isNull(), F.lit("NA")).otherwise(_fixed_udf(value.cast("double"), F.lit(digits)))


def percent_of(n: Column, total: Column) -> Column:
    """Count with its percentage: ``12(3.40%)``. A share of nothing is NaN."""
    share = F.when(total == 0, F.lit(float("nan"))).otherwise(n / total * 100)
    return F.concat(n.cast("string"), F.lit("("), fixed(share, 2), F.lit("%)"))
