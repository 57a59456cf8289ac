"""Queries over the subject chain: quality tags, index rows, stays, states, study columns, attrition."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.functions.scalars import year_month
from pairwell.operators import derive as D
from pairwell.operators import quality as Q
from pairwell.operators.cohort import attrition
from pairwell.plans.study import days_histogram, month_histogram
from suite import chain as K
from suite import views as V
from suite.registry import query
from suite.views import CFG

_MASTER_COLS = "subject_id, index_date, sex_code, birth_year, ind_death, death_reason"


def _cols(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


@query("flag_rows", f"SELECT {_MASTER_COLS}, err FROM tagged_master", K.TAGS)
def flag_rows(spark, sf):
    return K.tagged(spark, sf)[0].select(*_cols(_MASTER_COLS), "err")


@query(
    "flag_duplicate_key",
    f"""SELECT {_MASTER_COLS}, CASE WHEN MAX(c) OVER (PARTITION BY subject_id) > 1 THEN ' dup' ELSE '' END AS err
        FROM (SELECT *, COUNT(*) OVER (PARTITION BY subject_id, index_date) AS c FROM master) m""",
)
def flag_duplicate_key(spark, sf):
    hot = V.hot_master(spark, sf)
    rows = Q.with_empty_tags(V.master(spark, sf).select(*_cols(_MASTER_COLS)))
    return Q.flag_duplicate_key(rows, "subject_id", "index_date", "dup", hot)


@query(
    "flag_missing_required",
    f"""SELECT {_MASTER_COLS}, (CASE WHEN subject_id IS NULL THEN ' no_id' ELSE '' END)
          || (CASE WHEN index_date IS NULL THEN ' no_index' ELSE '' END)
          || (CASE WHEN sex_code IS NULL THEN ' no_sex' ELSE '' END)
          || (CASE WHEN birth_year IS NULL THEN ' no_birth' ELSE '' END) AS err FROM master""",
)
def flag_missing_required(spark, sf):
    rows = Q.with_empty_tags(V.master(spark, sf).select(*_cols(_MASTER_COLS)))
    return Q.flag_missing_required(
        rows, {"subject_id": "no_id", "index_date": "no_index", "sex_code": "no_sex", "birth_year": "no_birth"}
    )


@query(
    "flag_missing_partner",
    f"""SELECT {_MASTER_COLS}, CASE WHEN ind_death = '1' AND NOT EXISTS (SELECT 1 FROM stays s
          WHERE s.death_date IS NOT NULL AND s.subject_id IS NOT DISTINCT FROM m.subject_id) THEN ' no_date' ELSE '' END AS err
        FROM master m""",
)
def flag_missing_partner(spark, sf):
    hot = V.hot_master(spark, sf)
    rows = Q.with_empty_tags(V.master(spark, sf).select(*_cols(_MASTER_COLS)))
    dated = V.stays(spark, sf).filter("death_date IS NOT NULL")
    return Q.flag_missing_partner(rows, F.col("ind_death") == "1", dated, "subject_id", "no_date", hot)


@query(
    "flag_conflicting_value",
    """SELECT subject_id, arrival, death_date, CASE WHEN MIN(death_date) OVER (PARTITION BY subject_id)
         < MAX(death_date) OVER (PARTITION BY subject_id) THEN ' diff' ELSE '' END AS err FROM stays""",
)
def flag_conflicting_value(spark, sf):
    hot = V.hot_stays(spark, sf)
    rows = Q.with_empty_tags(V.stays(spark, sf).select("subject_id", "arrival", "death_date"))
    return Q.flag_conflicting_value(rows, "subject_id", "death_date", "diff", hot)


@query(
    "flag_date_order",
    """SELECT subject_id, arrival, release_date, death_date, (CASE WHEN release_date < arrival THEN ' release' ELSE '' END)
         || (CASE WHEN death_date - arrival < 0 THEN ' death' ELSE '' END) AS err FROM stays""",
)
def flag_date_order(spark, sf):
    rows = V.stays(spark, sf).select("subject_id", "arrival", "release_date", "death_date")
    rows = Q.flag_date_order(Q.with_empty_tags(rows), "arrival", "release_date", 0, "release")
    return Q.flag_date_order(rows, "arrival", "death_date", 0, "death")


_STAY_COLS = "subject_id, arrival, release_date, division, death_date"


@query("flag_cross_table_order", f"SELECT {_STAY_COLS}, err FROM tagged_stays", K.TAGS)
def flag_cross_table_order(spark, sf):
    return K.tagged(spark, sf)[1].select(*_cols(_STAY_COLS), "err")


@query(
    "filter_by_tag",
    f"""SELECT {_STAY_COLS}, err FROM tagged_stays WHERE NOT regexp_matches(err,
        '.* diff_deathdate.*|.* deathdate_first_positive_result_test_date.*')""",
    K.TAGS,
)
def filter_by_tag(spark, sf):
    stays = K.tagged(spark, sf)[1]
    return Q.without_tags(stays, ["diff_deathdate", "deathdate_first_positive_result_test_date"]).select(
        *_cols(_STAY_COLS), "err"
    )


@query(
    "expect_unique",
    "SELECT subject_id, COUNT(*) AS n FROM prior WHERE subject_id IS NOT NULL GROUP BY subject_id HAVING COUNT(*) > 1",
    K.STAY_CTES,
)
def expect_unique(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return Q.repeated_keys(D.prior_history(stays, base, CFG, hot), "subject_id")


@query(
    "error_combined_counts",
    """SELECT err, CAST(COUNT(*) AS BIGINT) AS value FROM tagged_master WHERE err <> '' GROUP BY err
       UNION ALL SELECT NULL, CAST(COUNT(*) AS BIGINT) FROM tagged_master WHERE err <> ''""",
    K.TAGS,
)
def error_combined_counts(spark, sf):
    return Q.error_combined(Q.error_counts(K.tagged(spark, sf)[0]))


@query(
    "error_tag_counts",
    """SELECT tag AS err, CAST(COUNT(*) AS BIGINT) AS value
       FROM (SELECT unnest(string_split(err, ' ')) AS tag FROM tagged_stays) t WHERE tag <> '' GROUP BY tag""",
    K.TAGS,
)
def error_tag_counts(spark, sf):
    return Q.error_separate(Q.error_counts(K.tagged(spark, sf)[1]))


@query("index_rows", "SELECT * FROM base0", K.STAY_CTES)
def index_rows(spark, sf):
    return K.base0(spark, sf)[0].drop("death_reason_ord")


@query("outcome_dates", "SELECT * FROM deaths", K.STAY_CTES)
def outcome_dates(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return D.outcome_dates(stays, base)


@query("qualifying_stays", "SELECT * FROM qualifying", K.STAY_CTES)
def qualifying_stays(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return D.qualifying_stays(stays, base, CFG, hot)


@query("prior_history", "SELECT * FROM prior1", K.STAY_CTES)
def prior_history(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return D.latest_prior(D.prior_history(stays, base, CFG, hot))


@query("stay_indicator", "SELECT * FROM indicator", K.STAY_CTES)
def stay_indicator(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return D.stay_indicator(D.qualifying_stays(stays, base, CFG, hot))


@query("stay_duration", "SELECT * FROM duration", K.STAY_CTES)
def stay_duration(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return D.stay_duration(D.qualifying_stays(stays, base, CFG, hot))


@query("first_arrival", "SELECT * FROM first_arrivals", K.STAY_CTES)
def first_arrival(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return D.first_arrival(D.qualifying_stays(stays, base, CFG, hot))


def _state(pick):
    def run(spark, sf):
        return K.base(spark, sf).select("subject_id", f"{pick}_state")

    query(f"state_{pick}", f"SELECT subject_id, {pick}_state FROM base", K.ALL_CTES)(run)


for _pick in ("min", "max", "first"):
    _state(_pick)


@query("study_columns", "SELECT * FROM base", K.ALL_CTES)
def study_columns(spark, sf):
    return K.base(spark, sf).drop("death_reason_ord")


_STEPS = [
    ("all", "TRUE"),
    ("complete", "arm IS NOT NULL AND age_group IS NOT NULL AND sex IS NOT NULL AND index_date IS NOT NULL"),
    ("death_dated", "NOT (ind_death = '1' AND death_date IS NULL)"),
    ("in_period", "index_date BETWEEN DATE '1995-04-01' AND DATE '2000-12-31'"),
    ("min_age", "age >= 12"),
    ("not_during_prior", "during_prior = '0'"),
    ("status_known", "first_state <> 'hospitalization_unknown'"),
]


def _attrition_sql() -> str:
    parts = []
    for i, (name, _) in enumerate(_STEPS):
        cond = " AND ".join(f"({c})" for _, c in _STEPS[: i + 1])
        parts.append(
            f"SELECT {i} AS step, '{name}' AS description, COUNT(*) AS n, COUNT(*) FILTER (WHERE arm = '1') AS case_n, "
            f"COUNT(*) FILTER (WHERE arm = '0') AS control_n FROM base WHERE {cond}"
        )
    return " UNION ALL ".join(parts)


@query("cohort_attrition", _attrition_sql(), K.ALL_CTES)
def cohort_attrition(spark, sf):
    return attrition(K.base(spark, sf), CFG)


@query(
    "histogram_month",
    "SELECT index_month, arm, COUNT(*) AS n FROM base WHERE arm IS NOT NULL GROUP BY ALL",
    K.ALL_CTES,
)
def histogram_month(spark, sf):
    base = D.with_arm(K.base0(spark, sf)[0])
    return month_histogram(base.withColumn("index_month", year_month(F.col("index_date"))))


@query(
    "histogram_days",
    """SELECT CAST(s.arrival - b.index_date AS INTEGER) AS days_index_to_stay, b.arm, COUNT(*) AS n
       FROM tagged_stays s JOIN base b ON b.subject_id = s.subject_id
       WHERE s.err = '' AND s.division = 'dedicated' AND s.arrival - b.index_date BETWEEN -20 AND 20 GROUP BY ALL""",
    K.ALL_CTES,
)
def histogram_days(spark, sf):
    base, stays, hot = K.base0(spark, sf)
    return days_histogram(stays, D.with_arm(base), hot=hot)
