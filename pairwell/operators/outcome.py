"""Outcome tables: events per arm with exact and paired tests, for a list of groupings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.operators.aggregate import CASE, CONTROL, Grouping, stack_groupings, with_rates
from pairwell.operators.inference import fisher_exact, mcnemar
from pairwell.operators.joins import pair_wide

KEYS = ["age_group", "sex", "first_state"]
_CELL = ["age_group_narrow", "age_group", "sex", "first_state", "older"]


def _key(name: str):
    return lambda c: c(name)


def _older(c):
    return c("older")


def _merged(name: str, *members: str) -> Grouping:
    return Grouping(
        "Patient aged 55 and above status at admission",
        {"first_state": lambda c: F.when(c("first_state").isin(*members), F.lit(name))},
        lambda c: c("older") & c("first_state").isin(*members),
    )


# Descriptions of the groupings as they appear in the outcome tables.
BASIC_GROUPINGS = [
    Grouping("Narrow age group", {"age_group": _key("age_group_narrow"), "sex": _key("sex")}),
    Grouping("Wider age group", {"age_group": _key("age_group"), "sex": _key("sex")}),
    Grouping("Wider age group", {"age_group": _key("age_group")}),
    Grouping("Patient aged 55 and above", {"sex": _key("sex")}, _older),
    Grouping("Patient aged 55 and above", {}, _older),
]
STATUS_GROUPINGS = [
    Grouping("Patient aged 55 and above status at admission", {"first_state": _key("first_state")}, _older),
    _merged("severe_critical", "severe", "critical"),
    _merged("moderate_severe", "moderate", "severe"),
    _merged("moderate_severe_critical", "moderate", "severe", "critical"),
]
ALL_GROUPINGS = BASIC_GROUPINGS + STATUS_GROUPINGS


def outcome_cells(study: DataFrame, outcome: str, older_age: int = 55) -> DataFrame:
    """Subjects and events per arm and category cell: the one pass over the subjects behind an outcome table."""
    event = F.coalesce(F.col(outcome).cast("string") == "1", F.lit(False))
    case, control = F.col("arm") == CASE, F.col("arm") == CONTROL
    return (
        study.withColumn("older", F.coalesce(F.col("age") >= older_age, F.lit(False)))
        .groupBy(*_CELL)
        .agg(
            F.count_if(case).alias("case_n"),
            F.count_if(control).alias("control_n"),
            F.count_if(case & event).alias("case_event_n"),
            F.count_if(control & event).alias("control_event_n"),
        )
    )


def pair_cells(study: DataFrame, outcome: str, older_age: int = 55) -> DataFrame:
    """Discordant pairs per combination of the two members' categories."""
    rows = study.withColumn("older", F.coalesce(F.col("age") >= older_age, F.lit(False))).withColumn(
        "event", F.col(outcome).cast("string") == "1"
    )
    wide = pair_wide(rows, "subclass", "arm", [*_CELL, "event"])
    sides = [f"{c}_{s}" for s in ("case", "control") for c in _CELL]
    return wide.groupBy(*sides).agg(
        F.count_if(F.col("event_case") & ~F.col("event_control")).alias("case_only"),
        F.count_if(~F.col("event_case") & F.col("event_control")).alias("control_only"),
    )


def outcome_counts(study: DataFrame, groupings: list[Grouping], outcome: str, older_age: int = 55) -> DataFrame:
    """Counts, rates and discordant pairs per group; a pair counts in a group only if both members are in it."""
    sums = ["case_n", "control_n", "case_event_n", "control_event_n"]
    counts = stack_groupings(outcome_cells(study, outcome, older_age), groupings, KEYS, sums)
    case_side = lambda name: F.col(f"{name}_case")
    control_side = lambda name: F.col(f"{name}_control")
    pairs = stack_groupings(
        pair_cells(study, outcome, older_age),
        groupings,
        KEYS,
        ["case_only", "control_only"],
        (case_side, control_side),
    )
    on = ["description", "grouping", *KEYS]
    right = pairs.select(*[F.col(c).alias(f"_p_{c}") for c in on], "case_only", "control_only")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in on])
    joined = counts.join(right, same, "left").select(
        "description",
        *KEYS,
        *sums,
        F.coalesce("case_only", F.lit(0)).alias("case_only"),
        F.coalesce("control_only", F.lit(0)).alias("control_only"),
    )
    return with_rates(joined)


def with_tests(counts: DataFrame) -> DataFrame:
    """Add Fisher's and McNemar's tests to a table of group counts."""
    table = counts.withColumns(
        {"_a": F.col("control_n") - F.col("control_event_n"), "_c": F.col("case_n") - F.col("case_event_n")}
    )
    tested = fisher_exact(table, "_a", "control_event_n", "_c", "case_event_n").drop("_a", "_c")
    return mcnemar(tested, "case_only", "control_only")


def outcome_summary(
    study: DataFrame, groupings: list[Grouping], outcome: str, older_age: int = 55
) -> DataFrame:
    """The outcome table with tests."""
    return with_tests(outcome_counts(study, groupings, outcome, older_age))
