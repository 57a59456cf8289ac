"""Day-window joins of event rows to one index row per subject, and pair joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.skew import HotKeys, attach


def join_within_days(
    events: DataFrame, index: DataFrame, id: str, start: str, end: str, index_date: str, lo: int, hi: int,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Events that start within [lo, hi] days of the subject's index date and are still open on it."""

    def window(l, r):
        return F.datediff(l(start), r(index_date)).between(lo, hi) & (
            l(end).isNull() | (r(index_date) <= l(end))
        )

    return attach(events.filter(F.col(start).isNotNull()), index, [id], "inner", condition=window, hot=hot)


def join_lookback(
    events: DataFrame, index: DataFrame, id: str, start: str, index_date: str, min_days: int, max_days: int,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Events strictly more than ``min_days`` and strictly less than ``max_days`` days before the index date."""

    def window(l, r):
        days = F.datediff(r(index_date), l(start))
        return (days > min_days) & (days < max_days)

    return attach(events.filter(F.col(start).isNotNull()), index, [id], "inner", condition=window, hot=hot)


def join_during(
    updates: DataFrame, stays: DataFrame, id: str, at: str, start: str, n_days: str,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Updates between the start of the subject's stay and ``n_days`` (a column of ``stays``) later, both ends in."""

    def window(l, r):
        return F.datediff(l(at), r(start)).between(0, r(n_days))

    return attach(updates.filter(F.col(at).isNotNull()), stays, [id], "inner", condition=window, hot=hot)


def pair_wide(df: DataFrame, pair: str, arm: str, cols: list[str]) -> DataFrame:
    """One row per complete 1:1 pair with ``<col>_case`` and ``<col>_control``; one aggregate instead of a self-join.

    A pair without exactly one row on each side is not a pair and is left out.
    """
    case, control = F.col(arm) == "1", F.col(arm) == "0"
    row = F.struct(*cols)
    sides = (
        df.filter(F.col(pair).isNotNull())
        .groupBy(pair)
        .agg(
            F.count_if(case).alias("_n1"),
            F.count_if(control).alias("_n0"),
            F.max(F.when(case, row)).alias("_case"),
            F.max(F.when(control, row)).alias("_control"),
        )
        .filter("_n1 = 1 AND _n0 = 1")
    )
    return sides.select(
        pair,
        *[F.col(f"_case.{c}").alias(f"{c}_case") for c in cols],
        *[F.col(f"_control.{c}").alias(f"{c}_control") for c in cols],
    )
