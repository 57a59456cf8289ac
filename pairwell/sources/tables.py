"""The four source tables: column names in the files, names used here, and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell import config as C
from pairwell.config import StudyConfig
from pairwell.operators.clean import as_ordered, coerce, null_if, recode, recoded

# File column -> name used by the operators.
MASTER_COLUMNS = {
    "patient_id": "subject_id",
    "first_positive_result_test_date": "index_date",
    "gendercodename": "sex_code",
    "ind_death": "ind_death",
    "positive_pcr_within_5": "within_5",
    "positive_pcr_before_vaccine": "before_vaccine",
    "positive_pcr_no_vaccine": "no_vaccine",
    "new_birthdate": "birth_year",
    "new_reasonofdeathname": "death_reason",
    "first_vaccincationdatetime": "first_dose_date",
    "second_vaccinationdatetime": "second_dose_date",
}
STAY_COLUMNS = {
    "patient_id": "subject_id",
    "new_deathdate": "death_date",
    "new_arrivaldate": "arrival",
    "new_releasedate": "release_date",
    "duration_hospitalization": "recorded_days",
    "new_divisiontypename": "division",
}
UPDATE_COLUMNS = {
    "patient_id": "subject_id",
    "first_datemonitoring": "first_date",
    "last_datemonitoring": "last_date",
    "first_update_medical_situation": "first_state",
    "last_update_medical_situation": "last_state",
}
QUARANTINE_COLUMNS = {"new_fever": "fever", "isolationstartdaykey": "isolation_day_key"}

YES = {"Y": "1"}


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that occur in ``names``; the others are kept, since they count when rows are compared."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def clean_master(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    out = null_if(df, "index_date", str(cfg.index_sentinel))
    yes_no = [c for c in ("within_5", "before_vaccine", "no_vaccine") if c in out.columns]
    out = out.withColumns(
        {
            "sex": recoded("sex_code", cfg.sex_labels),
            "ind_death": recoded("ind_death", {}, null_to="0"),
            **{c: recoded(c, YES, null_to="0") for c in yes_no},
        }
    )
    if "death_reason" in out.columns:
        out = as_ordered(recode(out, "death_reason", cfg.death_reason_labels), "death_reason", C.DEATH_REASON_LEVELS)
    dates = [c for c in ("index_date", "first_dose_date", "second_dose_date") if c in out.columns]
    return coerce(out, {**{c: "date" for c in dates}, "birth_year": "double"})


def clean_stays(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    out = as_ordered(recode(df, "division", cfg.division_labels), "division", C.DIVISION_LEVELS)
    return coerce(
        out, {"death_date": "date", "arrival": "date", "release_date": "date", "recorded_days": "double"}
    )


def clean_updates(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    out = df
    for col in ("first_state", "last_state"):
        out = as_ordered(recode(out, col, cfg.situation_labels), col, C.SITUATION_LEVELS)
    return coerce(out, {"first_date": "date", "last_date": "date"})


def clean_quarantine(df: DataFrame) -> DataFrame:
    return coerce(df.withColumn("isolation_start", F.col("isolation_day_key")), {"isolation_start": "day_key"})
