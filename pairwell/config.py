"""Study parameters, label maps and error tags.

Everything a run depends on sits in one frozen object that is passed to the operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Level order of the clinical status, mildest first.
SITUATION_LEVELS = ("recovered", "mild", "moderate", "severe", "critical", "dead")

# Levels a status column can take once subjects without an update are filled in.
STATUS_LEVELS = ("hospitalization_unknown", "not_hospitalized", "unknown") + SITUATION_LEVELS

# Source labels (Hebrew) and what they become; None is "missing".
DEATH_REASON_LABELS = {
    "לא ידוע": None,
    "נפטר שלילי לקורונה": "negative",
    "נפטר מסיבה אחרת": "other",
    "נפטר כחשוד": "suspect",
    "נפטר מקורונה": "positive",
}
SITUATION_LABELS = {
    "לא ידוע": None,
    "החלים": "recovered",
    "קל": "mild",
    "בינוני": "moderate",
    "קשה": "severe",
    "קריטי": "critical",
    "נפטר": "dead",
}
DIVISION_LABELS = {"רגילה": "standard", "ייעודית": "dedicated"}
SEX_LABELS = {"1": "male", "2": "female", "999": None}

DEATH_REASON_LEVELS = ("negative", "other", "suspect", "positive")
DIVISION_LEVELS = ("standard", "dedicated")

# Texts of the data-quality tags, as they appear in the parameter table.
TAG_DUPLICATE = "duplicated_id_pcr+"
TAG_NO_ID = "no_patient_id"
TAG_NO_INDEX = "no_first_positive_result_test_date"
TAG_NO_SEX = "no_gendercodename"
TAG_NO_BIRTH = "no_new_birthdate"
TAG_NO_DEATH_DATE = "no_new_deathdate"
TAG_DIFF_DEATH = "diff_deathdate"
TAG_RELEASE_ORDER = "releasedate_arrivaldate"
TAG_DEATH_ARRIVAL = "deathdate_arrivaldate"
TAG_DEATH_INDEX = "deathdate_first_positive_result_test_date"


@dataclass(frozen=True)
class StudyConfig:
    """Limits of one study run. Day limits are whole days; dates are inclusive."""

    study_start: date = date(2020, 12, 20)
    study_end: date = date(2021, 10, 7)
    wave_cutoff: date = date(2021, 5, 1)
    index_sentinel: date = date(2000, 1, 1)
    age_year: int = 2021
    min_age: int = 12
    older_age: int = 55
    min_cell: int = 5
    min_days_to_stay: int = -2
    max_days_to_stay: int = 21
    max_days_prior_stay: int = 270
    min_days_to_death: int = 0
    max_days_to_death: int = 60
    age_breaks: tuple = (12, 55, 65)
    age_labels: tuple = ("12-54", "55-64", "65+")
    age_breaks_narrow: tuple = (12, 35, 45, 55, 65, 75, 85)
    age_labels_narrow: tuple = ("12-34", "35-44", "45-54", "55-64", "65-74", "75-84", "85+")
    match_on_status: bool = True
    clean_first: bool = False
    death_reason_labels: dict = field(default_factory=lambda: dict(DEATH_REASON_LABELS))
    situation_labels: dict = field(default_factory=lambda: dict(SITUATION_LABELS))
    division_labels: dict = field(default_factory=lambda: dict(DIVISION_LABELS))
    sex_labels: dict = field(default_factory=lambda: dict(SEX_LABELS))

    @property
    def exact_keys(self) -> tuple:
        keys = ("age_group_narrow", "sex")
        return keys + ("first_state",) if self.match_on_status else keys
