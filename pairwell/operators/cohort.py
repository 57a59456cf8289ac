"""Cohort filters with attrition, sub-cohorts, and time-to-event columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.config import StudyConfig
from pairwell.operators.groups import complete_pairs


def cohort_steps(cfg: StudyConfig) -> list[tuple[str, Column]]:
    """The inclusion rules in order. An unknown condition drops the row."""
    complete = reduce(
        lambda a, b: a & b, [F.col(c).isNotNull() for c in ("arm", "age_group", "sex", "index_date")]
    )
    undated_death = (F.col("ind_death") == "1") & F.col("death_date").isNull()
    return [
        ("complete", complete),
        ("death_dated", ~undated_death),
        ("in_period", F.col("index_date").between(F.lit(cfg.study_start), F.lit(cfg.study_end))),
        ("min_age", F.col("age") >= cfg.min_age),
        ("not_during_prior", F.col("during_prior") == "0"),
        ("status_known", F.col("first_state") != "hospitalization_unknown"),
    ]


def cohort(base: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Subjects that pass every rule."""
    for _, cond in cohort_steps(cfg):
        base = base.filter(cond)
    return base


def attrition_steps(cfg: StudyConfig) -> list[tuple[str, Column]]:
    """All subjects, and those left after each rule: (name, condition)."""
    passed, steps = F.lit(True), [("all", F.lit(True))]
    for name, cond in cohort_steps(cfg):
        passed = passed & F.coalesce(cond, F.lit(False))
        steps.append((name, passed))
    return steps


def attrition_counts(cfg: StudyConfig) -> list[Column]:
    """The numbers behind the attrition table, as aggregates: for a pass of their own, or to be observed while the
    subject table is written."""
    counts = []
    for i, (_, cond) in enumerate(attrition_steps(cfg)):
        counts += [
            F.count_if(cond).alias(f"n{i}"),
            F.count_if(cond & (F.col("arm") == "1")).alias(f"c{i}"),
            F.count_if(cond & (F.col("arm") == "0")).alias(f"k{i}"),
        ]
    return counts


ATTRITION_TYPE = "step int, description string, n bigint, case_n bigint, control_n bigint"


def attrition_table(spark: SparkSession, counts: dict[str, int], cfg: StudyConfig) -> DataFrame:
    """How many subjects, and how many per arm, are left after each rule, from counts observed before."""
    names = [name for name, _ in attrition_steps(cfg)]
    return spark.createDataFrame([(i, d, *(counts[f"{x}{i}"] for x in "nck")) for i, d in enumerate(names)], ATTRITION_TYPE)


def attrition(base: DataFrame, cfg: StudyConfig) -> DataFrame:
    """How many subjects, and how many per arm, are left after each rule; one pass over the data."""
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("description"),
                F.col(f"n{i}").alias("n"),
                F.col(f"c{i}").alias("case_n"),
                F.col(f"k{i}").alias("control_n"),
            )
            for i, (name, _) in enumerate(attrition_steps(cfg))
        ]
    )
    return base.agg(*attrition_counts(cfg)).select(F.inline(lines))


def subcohort_with_partners(study: DataFrame, lo: int, hi: int, gap: str = "days_dose_to_index") -> DataFrame:
    """Treated subjects whose gap lies in [lo, hi] together with their matched partners."""
    chosen = (F.col("arm") == "1") & F.col(gap).between(lo, hi)
    pairs = study.filter(chosen).select("subclass").distinct()
    # a pair has one row per arm, so the join key repeats on neither side
    partners = study.filter("arm = '0'").join(pairs, "subclass", "left_semi").select(*study.columns)
    return study.filter(chosen).unionByName(partners)


def complete_pairs_cohort(study: DataFrame, allowed=("0", "1"), col: str = "ind_hospitalized") -> DataFrame:
    """Rows with a known status whose pair is still complete."""
    return complete_pairs(study.filter(F.col(col).isin(*allowed)), "subclass")


def censor_at(df: DataFrame, time: str, event: str, limit: int, origin: int = 0) -> DataFrame:
    """Time-to-event columns: no event or an event after ``limit`` is censored at ``limit``; time counts from origin."""
    late = F.coalesce(F.col(time) > limit, F.lit(False))
    return df.withColumns(
        {
            event: F.when(late, F.lit(0)).otherwise(F.col(event).try_cast("int")),
            time: F.least(F.coalesce(F.col(time), F.lit(limit)), F.lit(limit)) - origin,
        }
    )
