"""The whole study as one job: files in, report tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairwell.config import STATUS_LEVELS, StudyConfig
from pairwell.operators.clean import dedupe_rows
from pairwell.operators.cohort import attrition_counts, attrition_table, censor_at, cohort, complete_pairs_cohort, subcohort_with_partners
from pairwell.operators.derive import ID, subject_table, tag_master, tag_stays
from pairwell.operators.logit import Logit, fit_logit
from pairwell.operators.match import balance, balance_summary, match_nearest, match_summary, propensity
from pairwell.operators.models import fit_negbin, fit_poisson, model_cells
from pairwell.operators.outcome import ALL_GROUPINGS, BASIC_GROUPINGS, outcome_summary
from pairwell.operators.quality import without_tags
from pairwell.operators.report import demographic_table, export_outcome, params_table
from pairwell.operators.survival import (
    at_risk,
    event_table,
    km_from_table,
    logrank_from_table,
    regroup,
    with_logrank_p,
)
from pairwell.session import Tables
from pairwell.skew import HotKeys, attach, hot_keys
from pairwell.sources import tables as S
from pairwell.sources.delimited import read_delimited, write_csv, write_summary

MODEL_FACTORS = ["arm", "age_group", "sex"]


@dataclass
class Study:
    """Frames of one run. ``base``, ``pre`` and ``study`` are materialised, everything else is lazy.

    ``pre`` and ``study`` carry the score as ``distance``; ``left`` are the subjects left after each rule, counted while
    ``base`` was written; ``hot`` are the hot subjects of each source.
    """

    cfg: StudyConfig
    sources: dict
    master: DataFrame
    stays: DataFrame
    base: DataFrame
    pre: DataFrame
    study: DataFrame
    quarantine: DataFrame
    score: Logit
    left: dict[str, int]
    hot: dict[str, HotKeys]
    kept: Tables

    def close(self) -> None:
        """Remove the tables that the run kept; its frames cannot be read any more."""
        self.kept.close()

    def tables(self) -> dict[str, DataFrame]:
        """Every report table by name."""
        cfg, study = self.cfg, self.study
        hosp = complete_pairs_cohort(study)
        early = subcohort_with_partners(study, 0, 1)
        later = subcohort_with_partners(study, 2, 5)
        death, age = "ind_death", cfg.older_age
        samples = (self.pre, study, "arm", ["distance", "age", "index_day"], list(cfg.exact_keys))
        out = {
            "death": export_outcome(outcome_summary(study, ALL_GROUPINGS, death, age), cfg.min_cell),
            "death2d": export_outcome(outcome_summary(early, BASIC_GROUPINGS, death, age), cfg.min_cell),
            "death2t5d": export_outcome(outcome_summary(later, BASIC_GROUPINGS, death, age), cfg.min_cell),
            "hosp": export_outcome(outcome_summary(hosp, BASIC_GROUPINGS, "ind_hospitalized", age), cfg.min_cell),
            "params": params_table(cfg, self.sources, self.master, self.stays),
            "demographic": demographic_table(self.base, self.pre, study, cfg),
            "attrition": attrition_table(self.base.sparkSession, self.left, cfg),
            "match_summary": match_summary(self.pre, study, "arm"),
            "match_balance_summary": balance_summary(*samples),
            "balance": balance(*samples),
            "isolation_days": isolation_days(self.quarantine),
            "histogram_month": month_histogram(self.base),
            "histogram_days": days_histogram(self.stays, self.base, hot=self.hot["hospitalizations"]),
            "histogram_days_study": study_days_histogram(study),
        }
        for name, table in survival_tables(study, hosp, cfg).items():
            out[name] = table
        return out

    def models(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        """The model of the score and the five count models of days in hospital: (coefficients, fit) by name."""
        y = "duration_hospitalization"
        cells = model_cells(self.study, y, MODEL_FACTORS).persist()
        wide = [*MODEL_FACTORS, "ind_death", "first_state"]
        all_cells = model_cells(self.study, y, wide, exclude_dead=False)
        out = {
            "propensity": self.score.tables(self.study.sparkSession),
            "poisson": fit_poisson(cells, MODEL_FACTORS),
            "poisson_all": fit_poisson(cells, MODEL_FACTORS, interactions=True),
            "negbin": fit_negbin(cells, MODEL_FACTORS),
            "negbin_all": fit_negbin(cells, MODEL_FACTORS, interactions=True),
            "negbin_status": fit_negbin(all_cells, wide, order={"first_state": STATUS_LEVELS}),
        }
        cells.unpersist()
        return out


def month_histogram(base: DataFrame) -> DataFrame:
    """Subjects per month of the index date and arm; subjects without an arm are left out."""
    return base.filter(F.col("arm").isNotNull()).groupBy("index_month", "arm").agg(F.count(F.lit(1)).alias("n"))


def isolation_days(quarantine: DataFrame) -> DataFrame:
    """Records per start of isolation; a day key that is no date counts as missing."""
    return quarantine.groupBy("isolation_start").agg(F.count(F.lit(1)).alias("n"))


def days_histogram(
    stays: DataFrame, base: DataFrame, lo: int = -20, hi: int = 20, hot: HotKeys | None = None
) -> DataFrame:
    """Untagged dedicated stays per day since the index date and arm; the group without an arm is kept."""
    rows = without_tags(stays).filter("division = 'dedicated' AND arrival IS NOT NULL").select(ID, "arrival")
    days = lambda l, r: F.datediff(l("arrival"), r("index_date"))
    near = attach(
        rows,
        base.select(ID, "index_date", "arm"),
        [ID],
        "inner",
        condition=lambda l, r: days(l, r).between(lo, hi),
        hot=hot,
    )
    near = near.withColumn("days_index_to_stay", F.datediff("arrival", "index_date"))
    return near.groupBy("days_index_to_stay", "arm").agg(F.count(F.lit(1)).alias("n"))


def study_days_histogram(study: DataFrame, lo: int = -20, hi: int = 20) -> DataFrame:
    """Matched subjects per day from index date to first stay and arm."""
    near = study.filter(F.col("days_index_to_stay").between(lo, hi))
    return near.groupBy("days_index_to_stay", "arm").agg(F.count(F.lit(1)).alias("n"))


def curve_groupings(older_age: int, with_status: bool) -> list:
    """Curve families: (name, facet, condition). Facets of the band families carry the printed prefix."""
    band = lambda c: F.concat(F.lit("Age group: "), F.col(c))
    faceted = lambda c: F.concat_ws(", ", band(c), F.col("sex"))
    everyone = F.lit("all")
    out = [
        ("all", everyone, None),
        ("55+", everyone, F.col("age") >= older_age),
        ("65+", everyone, F.col("age") >= 65),
        ("55-64", everyone, F.col("age").between(55, 64)),
        ("narrow band x sex", faceted("age_group_narrow"), None),
        ("wide band x sex", faceted("age_group"), None),
        ("narrow band", band("age_group_narrow"), None),
        ("wide band", band("age_group"), None),
    ]
    if with_status:
        out += [
            ("55+ by status", F.col("first_state"), F.col("age") >= older_age),
            ("55+ mild", everyone, (F.col("age") >= older_age) & (F.col("first_state") == "mild")),
        ]
    return out


def curve_table(df: DataFrame, time: str, event: str, older_age: int, with_status: bool) -> DataFrame:
    """Event table of all curve families from one scan of the subjects."""
    fine = event_table(df, time, event, ["age", "age_group", "age_group_narrow", "sex", "first_state", "arm"])
    return regroup(fine, curve_groupings(older_age, with_status), "arm")


def survival_tables(study: DataFrame, hosp: DataFrame, cfg: StudyConfig) -> dict[str, DataFrame]:
    """Curves, numbers at risk and log-rank tests for both outcomes."""
    by, death, stay = ["curve", "facet"], "days_index_to_death", "days_index_to_stay"
    deaths = censor_at(study, death, "ind_death", cfg.max_days_to_death, cfg.min_days_to_death)
    stays = censor_at(hosp, stay, "ind_hospitalized", cfg.max_days_to_stay, cfg.min_days_to_stay)
    span_d = cfg.max_days_to_death - cfg.min_days_to_death
    span_s = cfg.max_days_to_stay - cfg.min_days_to_stay
    out = {}
    for name, frame, time, event, status, step, span in (
        ("death", deaths, death, "ind_death", True, 10, span_d),
        ("hosp", stays, stay, "ind_hospitalized", False, 5, span_s),
    ):
        table = curve_table(frame, time, event, cfg.older_age, status)
        out[f"km_{name}"] = km_from_table(table, [*by, "arm"])
        out[f"at_risk_{name}"] = at_risk(table, [*by, "arm"], step, span)
        out[f"logrank_{name}"] = with_logrank_p(logrank_from_table(table, by, "arm"))
    return out


def load(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Read the delimited files under ``master``, ``hospitalizations``, ``monitoring`` and ``quarantine``."""
    names = {
        "master": S.MASTER_COLUMNS,
        "hospitalizations": S.STAY_COLUMNS,
        "monitoring": S.UPDATE_COLUMNS,
        "quarantine": S.QUARANTINE_COLUMNS,
    }
    return {k: S.renamed(read_delimited(spark, p), names[k]) for k, p in paths.items()}


def build(sources: dict[str, DataFrame], cfg: StudyConfig, repeated_prior: str = "error") -> Study:
    """Clean, tag, derive one row per subject, filter the cohort and pair it.

    Frames that several tables read are kept in the shared folder, bucketed by subject where no subject is hot: the
    tagged tables, the subject table, the cohort (the propensity fit, the ranks and the balance table read it) and the
    pairs. Attrition is counted while the subject table is written. Hot subjects are counted once per source.
    """
    tables = Tables(next(iter(sources.values())).sparkSession)
    hot = {k: hot_keys(sources[k], [ID]) for k in ("master", "hospitalizations", "monitoring")}
    by = {k: None if h.rows else ID for k, h in hot.items()}
    master = S.clean_master(dedupe_rows(sources["master"]), cfg)
    stays = S.clean_stays(dedupe_rows(sources["hospitalizations"]), cfg)
    updates = S.clean_updates(dedupe_rows(sources["monitoring"]), cfg)
    tagged_master = tables.keep(tag_master(master, stays, hot["master"]), "master", by["master"])
    tagged_stays = tables.keep(tag_stays(stays, tagged_master, cfg, hot["hospitalizations"]), "stays", by["hospitalizations"])
    left = Observation()
    subjects = subject_table(
        tagged_master, tagged_stays, updates, cfg, repeated_prior, hot["hospitalizations"], hot["monitoring"], tables
    )
    base = tables.keep(subjects, "base", ID, left, tuple(attrition_counts(cfg)))
    pre = tables.keep(cohort(base, cfg).withColumn("index_day", F.unix_date("index_date")), "cohort", ID)
    score = fit_logit(pre, "arm", ["age", "index_day"])
    pre = propensity(pre, "arm", ["age", "index_day"], fit=score)
    study = tables.keep(match_nearest(pre, "arm", "distance", list(cfg.exact_keys), ID), "pairs")
    quarantine = S.clean_quarantine(dedupe_rows(sources["quarantine"]))
    return Study(cfg, sources, tagged_master, tagged_stays, base, pre, study, quarantine, score, left.get, hot, tables)


def run(
    spark: SparkSession, paths: dict[str, str], out: str, cfg: StudyConfig | None = None, repeated_prior: str = "error", keep: bool = False
) -> Study:
    """Read the files, run the study and write every report table as CSV and every model as parquet under ``out``.

    The tables between the steps are removed at the end, also of a run that fails later; with ``keep`` they stay until
    ``close``, so that the frames of the study can be read.
    """
    cfg = cfg or StudyConfig()
    study = build(load(spark, paths), cfg, repeated_prior)
    try:
        for name, table in study.tables().items():
            write_csv(table, f"{out}/{name}", single_file=True)
        for name, (coefficients, fit) in study.models().items():
            write_summary(coefficients, f"{out}/model_{name}")
            write_summary(fit, f"{out}/model_{name}_fit")
    finally:
        if not keep:
            study.close()
    return study
