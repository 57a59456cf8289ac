"""Kaplan-Meier curves, numbers at risk and log-rank tests.

Everything starts from counts per (group, arm, day). That table is bounded by the follow-up limit, so the running sums
of a curve run over at most that many rows, and several groupings are built from one scan of the subjects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions.tails import chi2_tail

Z95 = 1.959963984540054


def event_table(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """Subjects leaving (``m``) and events (``d``) per group and time."""
    return (
        df.filter(F.col(time).isNotNull() & F.col(event).isNotNull())
        .groupBy(*by, F.col(time).alias("time"))
        .agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(event).cast("bigint")).alias("d"))
    )


def regroup(table: DataFrame, groupings: list[tuple[str, Column, Column | None]], arm: str) -> DataFrame:
    """Sum a fine event table into several curve families: (name, label of the facet, optional condition)."""
    member = []
    for name, label, cond in groupings:
        row = F.struct(F.lit(name).alias("curve"), label.cast("string").alias("facet"))
        member.append(F.when(cond, row) if cond is not None else row)
    return (
        table.select(F.explode(F.array_compact(F.array(*member))).alias("_g"), arm, "time", "m", "d")
        .select("_g.*", arm, "time", "m", "d")
        .groupBy("curve", "facet", arm, "time")
        .agg(F.sum("m").alias("m"), F.sum("d").alias("d"))
    )


def km_from_table(table: DataFrame, by: list[str]) -> DataFrame:
    """Survival, standard error of its log, and log-type 95% limits from an event table."""
    down = Window.partitionBy(*by).orderBy(F.desc("time"))
    up = Window.partitionBy(*by).orderBy("time")
    n, d = F.col("n_risk"), F.col("d")
    done = F.max(d == n).over(up)
    alive = F.when(d < n, F.log((n - d) / n)).otherwise(F.lit(0.0))
    spread = F.when(d < n, d / (n * (n - d).cast("double"))).otherwise(F.lit(0.0))
    curve = table.withColumn("n_risk", F.sum("m").over(down)).select(
        *by,
        F.col("time").cast("int").alias("time"),
        n.cast("bigint").alias("n_risk"),
        d.cast("bigint").alias("n_event"),
        (F.col("m") - d).cast("bigint").alias("n_censor"),
        F.when(done, F.lit(0.0)).otherwise(F.exp(F.sum(alive).over(up))).alias("surv"),
        F.when(~done, F.sqrt(F.sum(spread).over(up))).alias("std_err"),
    )
    width = F.lit(Z95) * F.col("std_err")
    return curve.withColumns(
        {
            "lower": F.col("surv") * F.exp(-width),
            "upper": F.least(F.lit(1.0), F.col("surv") * F.exp(width)),
        }
    )


def km_curve(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """Kaplan-Meier curve per group of ``by`` (the arm included)."""
    return km_from_table(event_table(df, time, event, by), by)


def at_risk(table: DataFrame, by: list[str], step: int, upto: int) -> DataFrame:
    """Number still at risk on the day grid 0, step, ... upto, from an event table; zero where nobody is left."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(upto), F.lit(step))).alias("at")
    rows = table.select(*by, "time", "m", grid)
    still = F.sum(F.when(F.col("time") >= F.col("at"), F.col("m")).otherwise(F.lit(0)))
    return rows.groupBy(*by, "at").agg(still.cast("bigint").alias("n_risk"))


def logrank_from_table(table: DataFrame, by: list[str], arm: str) -> DataFrame:
    """Two-sample log-rank test per group: observed, expected and variance of the treated arm, statistic and p."""
    side = lambda a, c: F.sum(F.when(F.col(arm) == a, F.col(c)).otherwise(F.lit(0)))
    days = (
        table.filter(F.col(arm).isin("0", "1"))
        .groupBy(*by, "time")
        .agg(side("1", "m").alias("m1"), side("0", "m").alias("m0"), side("1", "d").alias("d1"), side("0", "d").alias("d0"))
    )
    down = Window.partitionBy(*by).orderBy(F.desc("time"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    d = (F.col("d1") + F.col("d0")).cast("double")
    risk = days.withColumn("n1", F.sum("m1").over(down)).withColumn("n", F.sum(F.col("m1") + F.col("m0")).over(down))
    variance = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / F.nullif(n - 1, F.lit(0.0))).otherwise(F.lit(0.0))
    sums = (
        risk.filter(F.col("d1") + F.col("d0") > 0)
        .groupBy(*by)
        .agg(
            F.sum("d1").cast("bigint").alias("observed"),
            F.sum(d * n1 / n).alias("expected"),
            F.sum(variance).alias("variance"),
        )
    )
    gap = F.col("observed") - F.col("expected")
    out = sums.withColumn("chisq", F.try_divide(gap * gap, F.col("variance")))
    return out


def with_logrank_p(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p", chi2_tail(F.col("chisq")))


def logrank(df: DataFrame, time: str, event: str, arm: str, by: list[str]) -> DataFrame:
    """Log-rank test between the arms per group of ``by`` (at least one column)."""
    return with_logrank_p(logrank_from_table(event_table(df, time, event, [*by, arm]), by, arm))
