"""Exact and paired tests on tables of counts, one row per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.tails import chi2_tail, fisher_test


def fisher_exact(counts: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Add ``fisher_p``, ``fisher_or``, ``fisher_lo`` and ``fisher_hi`` for the table [[a, b], [c, d]]; rows are arms."""
    tested = counts.withColumn("_f", fisher_test(F.col(a), F.col(b), F.col(c), F.col(d)))
    return tested.withColumns(
        {"fisher_p": F.col("_f.p"), "fisher_or": F.col("_f.odds"), "fisher_lo": F.col("_f.lo"), "fisher_hi": F.col("_f.hi")}
    ).drop("_f")


def mcnemar_statistic(b, c):
    """(|b - c| - 1)^2 / (b + c); no correction when b = c, NaN without discordant pairs."""
    gap = F.abs(F.col(b) - F.col(c)).cast("double")
    corrected = F.when(gap == 0, F.lit(0.0)).otherwise((gap - 1) * (gap - 1) / (F.col(b) + F.col(c)))
    return F.when(F.col(b) + F.col(c) == 0, F.lit(float("nan"))).otherwise(corrected)


def mcnemar(counts: DataFrame, b: str, c: str) -> DataFrame:
    """Add ``mcnemar_stat`` and ``mcnemar_p`` from the two discordant pair counts."""
    return counts.withColumn("mcnemar_stat", mcnemar_statistic(b, c)).withColumn(
        "mcnemar_p", chi2_tail(F.col("mcnemar_stat"))
    )
