"""Grouped summaries.

The reports ask for many groupings of the same few categories. Each starts from a cell table: one aggregate over the
rows by all categories, after which every grouping is a sum over a table whose size depends on the categories only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE, CONTROL = "1", "0"


def conditional_counts(df: DataFrame, keys: list[str], arm: str, event: Column) -> DataFrame:
    """Subjects and events per arm with rates; a rate over an empty arm is NULL."""
    hit = F.coalesce(event, F.lit(False))
    case, control = F.col(arm) == CASE, F.col(arm) == CONTROL
    counts = df.groupBy(*keys).agg(
        F.count_if(case).alias("case_n"),
        F.count_if(control).alias("control_n"),
        F.count_if(case & hit).alias("case_event_n"),
        F.count_if(control & hit).alias("control_event_n"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "case_event_p": F.try_divide("case_event_n", "case_n"),
            "control_event_p": F.try_divide("control_event_n", "control_n"),
        }
    )


@dataclass(frozen=True)
class Grouping:
    """One way to group a cell table. Keys and condition are functions of a column lookup ``c(name)``."""

    description: str
    keys: dict
    where: Callable | None = None

    def member(self, keys: list[str], sides: tuple) -> Column:
        """The group a cell belongs to, or NULL. With two sides both must fall into the same group."""
        first = sides[0]
        row = F.struct(
            F.lit(self.description).alias("description"),
            *[(self.keys[k](first) if k in self.keys else F.lit(None)).cast("string").alias(k) for k in keys],
            F.lit("/".join(self.keys)).alias("grouping"),
        )
        conds = [self.where(c) for c in sides] if self.where else []
        conds += [fn(first).eqNullSafe(fn(c)) for c in sides[1:] for fn in self.keys.values()]
        return F.when(reduce(lambda a, b: a & b, conds), row) if conds else row


def stack_groupings(
    cells: DataFrame, groupings: list[Grouping], keys: list[str], sums: list[str], sides: tuple = (F.col,)
) -> DataFrame:
    """Several groupings of one cell table under each other; a key that a grouping lacks is NULL.

    A cell is copied to the groups it belongs to and all are summed in one aggregate.
    """
    members = F.array_compact(F.array(*[g.member(keys, sides) for g in groupings]))
    rows = cells.select(F.explode(members).alias("_g"), *sums).select("_g.*", *sums)
    return rows.groupBy("description", "grouping", *keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])


def quantiles_by(df: DataFrame, col: str, arm: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles (linear interpolation) of a whole-number measure, overall and per arm.

    Counts per value come first, so the quantile buffer holds the distinct values (ages in years), not the rows.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(arm, col).agg(F.count(F.lit(1)).alias("_n"))
    both = counts.select(
        F.explode(F.array(F.lit("all"), F.coalesce(F.col(arm), F.lit("none")))).alias("grp"), F.col(col), "_n"
    )
    q = F.percentile(F.col(col), F.array(*[F.lit(p) for p in probs]), F.col("_n"))
    return (
        both.groupBy("grp")
        .agg(F.sum("_n").alias("n"), q.alias("_q"))
        .select("grp", "n", *[F.col("_q")[i].alias(f"q{round(p * 100)}") for i, p in enumerate(probs)])
    )


def value_sketches(df: DataFrame, col: str, keys: list[str], k: int = 400) -> DataFrame:
    """A quantile sketch per group: keys, n, sketch. Its size follows from ``k``, not from the rows or distinct values.

    Sketches are made in the map tasks and merged; kept as a column, those of parts (days, files) can be merged later by
    :func:`merged_sketches` into the sketch of the whole.
    """
    value = F.col(col).cast("double")
    rows = df.filter(value.isNotNull() & ~F.isnan(value))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of finer groups merged to those of ``keys``."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def rank_error(k: int = 400) -> float:
    """The stated error of a sketch: a quantile's rank is off by at most this share of the rows, in 99 of 100 cases."""
    return 2.446 / k**0.9433


def sketched_quantiles(sketches: DataFrame, keys: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Long table keys, n, prob, value: for values so many that :func:`quantiles_by`, which counts each, is no longer small."""
    at = [F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs]
    return sketches.select(*keys, "n", F.inline(F.array(*at)))


def shares_by(cells: DataFrame, key: str, arm: str, n: str = "n") -> DataFrame:
    """Count and share per level of ``key``, overall and inside each arm, from a cell table with counts ``n``."""
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0)).cast("bigint")
    levels = cells.groupBy(key).agg(
        F.sum(n).cast("bigint").alias("general_n"),
        count(F.col(arm) == CASE).alias("case_n"),
        count(F.col(arm) == CONTROL).alias("control_n"),
    )
    # the totals are one row of their own, which Spark fetches as a scalar
    totals = levels.select(F.struct(*[F.sum(c).alias(c) for c in ("general_n", "case_n", "control_n")])).scalar()
    share = lambda c: F.try_divide(c, totals[c])
    return levels.select(
        key,
        "general_n",
        share("general_n").alias("general_p"),
        "case_n",
        share("case_n").alias("case_p"),
        "control_n",
        share("control_n").alias("control_p"),
    )


def frequency(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicate_counts(df: DataFrame, id: str, key: str) -> DataFrame:
    """Row count, distinct rows, their difference, and how many (id, key) pairs there are beyond one per id."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    pairs = copies.groupBy(id, key).agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"))
    ids = pairs.groupBy(id).agg(
        F.sum("_c").alias("_c"), F.sum("_d").alias("_d"), F.count(F.lit(1)).alias("_p")
    )
    out = ids.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_d"), F.lit(0)).alias("unique_rows"),
        (F.coalesce(F.sum("_p"), F.lit(0)) - F.count(F.lit(1))).alias("extra_keys"),
    )
    return out.select(
        "n_rows", "unique_rows", (F.col("n_rows") - F.col("unique_rows")).alias("removed_rows"), "extra_keys"
    )


def histogram(df: DataFrame, bucket: str, arm: str, keep_null_arm: bool = False) -> DataFrame:
    """Rows per bucket and arm; rows without an arm are dropped unless asked for."""
    rows = df.filter(F.col(bucket).isNotNull())
    if not keep_null_arm:
        rows = rows.filter(F.col(arm).isNotNull())
    return rows.groupBy(bucket, arm).agg(F.count(F.lit(1)).alias("n"))
