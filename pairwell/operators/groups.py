"""First row of a group, complete groups, merged intervals, wide to long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.skew import HotKeys, attach


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each group. ``order`` should be total; use ``asc_nulls_last`` / ``desc_nulls_last``.

    Spark keeps one row per group in every map task before it shuffles (group limit), so a hot group is cheap.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def complete_groups(df: DataFrame, key: str, n: int, hot: HotKeys = HotKeys(())) -> DataFrame:
    """Rows whose group has exactly ``n`` members.

    The group sizes are aggregated first and joined back, so that a group that is far too large is never gathered. No
    key is counted to find hot groups: hand ``hot`` over where some group may hold a large share of the rows.
    """
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return attach(df, sizes.filter(F.col("_n") == n).select(key), [key], "inner", hot=hot)


def complete_pairs(df: DataFrame, key: str) -> DataFrame:
    """Rows whose group has exactly two members, in one aggregate: the smallest and the largest row of each group."""
    row = F.struct(*df.columns)
    pairs = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_a"), F.max(row).alias("_b"))
        .filter("_n = 2")
    )
    return pairs.select(F.inline(F.array("_a", "_b")))


def merge_intervals(df: DataFrame, id: str, start: str, end: str) -> DataFrame:
    """Merge overlapping or touching day intervals per subject: a new one begins only after the running end.

    Rows with the same start collapse to their latest end before the window, so a subject has at most one row per
    calendar day there, however many rows it had.
    """
    days = df.dropna(subset=[id, start, end]).groupBy(id, start).agg(F.max(end).alias(end))
    ordered = Window.partitionBy(id).orderBy(start)
    fresh = F.coalesce((F.col(start) > _seen(ordered, end)).cast("int"), F.lit(0))
    islands = days.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(ordered))
    return islands.groupBy(id, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def _seen(ordered, end: str) -> Column:
    """Latest end among the earlier rows."""
    return F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))


def newly_covered(id: str, start: str, end: str) -> Column:
    """Days a row adds to the union of the subject's earlier intervals; the sum is the length of the merged intervals.

    Expects one row per (id, start) with its latest end. A row without an end adds nothing (NULL).
    """
    seen = _seen(Window.partitionBy(id).orderBy(start), end)
    return F.when(F.col(end).isNotNull(), F.greatest(F.lit(0), F.datediff(F.col(end), F.greatest(F.col(start), seen))))


def total_days(intervals: DataFrame, id: str, start: str, end: str, out: str) -> DataFrame:
    """Days covered per subject; an interval that starts and ends on one day counts 0."""
    return intervals.groupBy(id).agg(F.sum(F.datediff(F.col(end), F.col(start))).cast("bigint").alias(out))


def first_last_to_long(
    df: DataFrame, id: str, first: tuple[str, str], last: tuple[str, str], names: tuple[str, str]
) -> DataFrame:
    """A (value, date) pair for the first and one for the last update become two rows, in one scan.

    ``which`` is 1 for the first update and 2 for the last.
    """
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("which"), F.col(v).alias(names[0]), F.col(d).alias(names[1]))
            for i, (v, d) in enumerate((first, last), 1)
        ]
    )
    return df.select(id, F.explode(rows).alias("_u")).select(id, "_u.*")
