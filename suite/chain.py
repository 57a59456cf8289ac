"""The subject chain on the views: tagged tables and one row per subject, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwell.operators.clean import as_ordered, recode
from pairwell.operators.derive import index_rows, subject_table, tag_master, tag_stays
from pairwell.session import Tables
from pairwell.skew import HotKeys
from suite import views as V
from suite.views import CFG


def clean_updates(spark: SparkSession, sf: str) -> DataFrame:
    out = V.updates(spark, sf).distinct()
    for col in ("first_state", "last_state"):
        out = as_ordered(recode(out, col, CFG.situation_labels), col, V.STATES[1:])
    return out


def clean_stays(spark: SparkSession, sf: str) -> DataFrame:
    return V.stays(spark, sf).distinct()


def tagged(spark: SparkSession, sf: str, keep: bool = False) -> tuple[DataFrame, DataFrame, HotKeys]:
    """Tagged master, tagged stays, and the hot subjects of the stays.

    ``keep`` writes the tagged master to a table bucketed by subject, for callers that read it more than once.
    """
    stays = clean_stays(spark, sf)
    hot_master, hot = V.hot_master(spark, sf), V.hot_stays(spark, sf)
    master = tag_master(V.master(spark, sf), stays, hot_master)
    if keep:
        master = Tables(spark).keep(master, "master", None if hot_master.rows else "subject_id")
    return master, tag_stays(stays, master, CFG, hot), hot


def base0(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, HotKeys]:
    master, stays, hot = tagged(spark, sf, keep=True)
    return index_rows(master), stays, hot


def base(spark: SparkSession, sf: str) -> DataFrame:
    master, stays, hot = tagged(spark, sf, keep=True)
    return subject_table(master, stays, clean_updates(spark, sf), CFG, "latest", hot, hot)


TAGGED_MASTER = """tagged_master AS (
  SELECT subject_id, index_date, sex_code, sex, birth_year, within_5, no_vaccine, ind_death, first_dose_date, death_reason,
         (CASE WHEN dup THEN ' duplicated_id_pcr+' ELSE '' END)
         || (CASE WHEN subject_id IS NULL THEN ' no_patient_id' ELSE '' END)
         || (CASE WHEN index_date IS NULL THEN ' no_first_positive_result_test_date' ELSE '' END)
         || (CASE WHEN sex_code IS NULL THEN ' no_gendercodename' ELSE '' END)
         || (CASE WHEN birth_year IS NULL THEN ' no_new_birthdate' ELSE '' END)
         || (CASE WHEN ind_death = '1' AND NOT EXISTS (
               SELECT 1 FROM stays s WHERE s.death_date IS NOT NULL AND s.subject_id IS NOT DISTINCT FROM m.subject_id)
             THEN ' no_new_deathdate' ELSE '' END) AS err
  FROM (SELECT *, MAX(c) OVER (PARTITION BY subject_id) > 1 AS dup
        FROM (SELECT *, COUNT(*) OVER (PARTITION BY subject_id, index_date) AS c FROM master) a) m)"""

TAGGED_STAYS = """tagged_stays AS (
  SELECT s.subject_id, arrival, release_date, recorded_days, division, death_date,
         (CASE WHEN lo < hi THEN ' diff_deathdate' ELSE '' END)
         || (CASE WHEN release_date < arrival THEN ' releasedate_arrivaldate' ELSE '' END)
         || (CASE WHEN death_date < arrival THEN ' deathdate_arrivaldate' ELSE '' END)
         || (CASE WHEN death_date < m.index_date THEN ' deathdate_first_positive_result_test_date' ELSE '' END) AS err
  FROM (SELECT *, MIN(death_date) OVER (PARTITION BY subject_id) AS lo, MAX(death_date) OVER (PARTITION BY subject_id) AS hi
        FROM (SELECT DISTINCT * FROM stays) d) s
  LEFT JOIN (SELECT subject_id, index_date FROM tagged_master WHERE err = '') m ON m.subject_id = s.subject_id)"""

BASE0 = """base0 AS (
  SELECT subject_id, index_date, sex_code, sex, birth_year, within_5, no_vaccine, ind_death, first_dose_date, death_reason
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY index_date NULLS LAST, err) AS rn FROM tagged_master) t
  WHERE rn = 1 AND err = '')"""

DEATHS = """deaths AS (
  SELECT DISTINCT s.subject_id, s.death_date FROM tagged_stays s
  JOIN base0 b ON b.subject_id = s.subject_id AND b.ind_death = '1'
  WHERE s.death_date IS NOT NULL AND s.err NOT LIKE '% diff_deathdate%'
    AND s.err NOT LIKE '% deathdate_first_positive_result_test_date%')"""

QUALIFYING = """qualifying AS (
  SELECT s.subject_id, s.arrival, s.release_date, s.err, b.index_date
  FROM (SELECT DISTINCT subject_id, arrival, release_date, err FROM tagged_stays
        WHERE division = 'dedicated' AND arrival IS NOT NULL) s
  JOIN base0 b ON b.subject_id = s.subject_id
  WHERE s.arrival - b.index_date BETWEEN -60 AND 365 AND (s.release_date IS NULL OR b.index_date <= s.release_date))"""

PRIOR = """prior AS (
  SELECT s.subject_id, CAST(b.index_date - s.arrival AS INTEGER) AS prior_days,
         CAST(CASE WHEN s.release_date >= b.index_date THEN b.index_date - s.arrival
                   WHEN s.release_date < b.index_date THEN s.recorded_days END AS DOUBLE) AS prior_duration,
         CASE WHEN s.release_date >= b.index_date THEN '1' WHEN s.release_date < b.index_date THEN '0' END AS during_prior
  FROM tagged_stays s JOIN base0 b ON b.subject_id = s.subject_id
  WHERE s.division = 'standard' AND b.index_date - s.arrival > 1 AND b.index_date - s.arrival < 720)"""

PRIOR1 = """prior1 AS (
  SELECT subject_id, prior_days, prior_duration, during_prior
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY prior_days NULLS LAST, prior_duration NULLS LAST,
                                     during_prior NULLS LAST) AS rn FROM prior) p WHERE rn = 1)"""

INDICATOR = """indicator AS (
  SELECT subject_id, CAST(MIN(CASE WHEN err <> '' THEN -1 ELSE 1 END) AS VARCHAR) AS ind_hospitalized
  FROM qualifying GROUP BY subject_id)"""

DURATION = """duration AS (
  SELECT subject_id, CAST(SUM(release_date - arrival) AS BIGINT) AS duration_hospitalization
  FROM (SELECT subject_id, island, MIN(arrival) AS arrival, MAX(release_date) AS release_date
        FROM (SELECT *, SUM(CASE WHEN arrival > seen THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id
                       ORDER BY arrival, release_date ROWS UNBOUNDED PRECEDING) AS island
              FROM (SELECT *, MAX(release_date) OVER (PARTITION BY subject_id ORDER BY arrival, release_date
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
                    FROM qualifying WHERE err = '' AND release_date IS NOT NULL) a) b
        GROUP BY subject_id, island) c
  GROUP BY subject_id)"""

ARRIVAL = """first_arrivals AS (
  SELECT subject_id, MIN(arrival) AS first_arrival FROM qualifying WHERE err = '' GROUP BY subject_id)"""

LONG = """long_updates AS (
  SELECT subject_id, 1 AS which, first_state AS state, first_date AS upd_day FROM (SELECT DISTINCT * FROM updates) u
  UNION ALL
  SELECT subject_id, 2, last_state, last_date FROM (SELECT DISTINCT * FROM updates) u)"""

INSIDE = """inside AS (
  SELECT l.*, list_position(['recovered', 'mild', 'moderate', 'severe', 'critical', 'dead'], l.state) AS ord
  FROM long_updates l
  JOIN first_arrivals a ON a.subject_id = l.subject_id
  JOIN duration d ON d.subject_id = l.subject_id
  WHERE l.state <> 'none' AND l.upd_day IS NOT NULL
    AND l.upd_day - a.first_arrival BETWEEN 0 AND d.duration_hospitalization)"""


def _pick(order: str, col: str) -> str:
    return (
        f"SELECT subject_id, state AS {col} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY {order})"
        " AS rn FROM inside) i WHERE rn = 1"
    )


STATES_SQL = f"""states AS (
  SELECT a.subject_id, min_state, max_state, first_state
  FROM ({_pick('ord', 'min_state')}) a
  JOIN ({_pick('ord DESC', 'max_state')}) b ON b.subject_id = a.subject_id
  JOIN ({_pick('upd_day, which, ord', 'first_state')}) c ON c.subject_id = a.subject_id)"""


def _fill(col: str) -> str:
    return (
        f"CASE WHEN s.{col} IS NOT NULL THEN s.{col} WHEN b.ind_hospitalized = '1' THEN 'unknown' "
        f"WHEN b.ind_hospitalized = '0' THEN 'not_hospitalized' ELSE 'hospitalization_unknown' END AS {col}"
    )


BASE1 = """base1 AS (
  SELECT b.*, d.death_date, p.prior_days, p.prior_duration, COALESCE(p.during_prior, '0') AS during_prior,
         COALESCE(i.ind_hospitalized, '0') AS ind_hospitalized, u.duration_hospitalization, f.first_arrival
  FROM base0 b LEFT JOIN deaths d ON d.subject_id = b.subject_id
  LEFT JOIN prior1 p ON p.subject_id = b.subject_id
  LEFT JOIN indicator i ON i.subject_id = b.subject_id
  LEFT JOIN duration u ON u.subject_id = b.subject_id
  LEFT JOIN first_arrivals f ON f.subject_id = b.subject_id)"""

BASE = f"""base AS (
  SELECT b.*, {_fill('min_state')}, {_fill('max_state')}, {_fill('first_state')},
         2021 - birth_year AS age,
         CAST(index_date - first_dose_date AS INTEGER) AS days_dose_to_index,
         CAST(death_date - index_date AS INTEGER) AS days_index_to_death,
         CAST(first_arrival - index_date AS INTEGER) AS days_index_to_stay,
         concat(CAST(year(index_date) AS VARCHAR), lpad(CAST(weekofyear(index_date) AS VARCHAR), 2, '0')) AS index_week,
         strftime(index_date, '%Y%m') AS index_month,
         CASE WHEN within_5 = '1' THEN '1' WHEN no_vaccine = '1' THEN '0' END AS arm,
         CASE WHEN 2021 - birth_year < 12 THEN NULL WHEN 2021 - birth_year < 55 THEN '12-54'
              WHEN 2021 - birth_year < 65 THEN '55-64' WHEN birth_year IS NOT NULL THEN '65+' END AS age_group,
         CASE WHEN 2021 - birth_year < 12 THEN NULL WHEN 2021 - birth_year < 35 THEN '12-34'
              WHEN 2021 - birth_year < 45 THEN '35-44' WHEN 2021 - birth_year < 55 THEN '45-54'
              WHEN 2021 - birth_year < 65 THEN '55-64' WHEN 2021 - birth_year < 75 THEN '65-74'
              WHEN 2021 - birth_year < 85 THEN '75-84' WHEN birth_year IS NOT NULL THEN '85+' END AS age_group_narrow
  FROM base1 b LEFT JOIN states s ON s.subject_id = b.subject_id)"""

PRE = """pre AS (
  SELECT * FROM base
  WHERE arm IS NOT NULL AND age_group IS NOT NULL AND sex IS NOT NULL AND index_date IS NOT NULL
    AND NOT (ind_death = '1' AND death_date IS NULL)
    AND index_date BETWEEN DATE '1995-04-01' AND DATE '2000-12-31' AND age >= 12
    AND during_prior = '0' AND first_state <> 'hospitalization_unknown')"""

TAGS = (TAGGED_MASTER, TAGGED_STAYS)
STAY_CTES = (*TAGS, BASE0, DEATHS, QUALIFYING, PRIOR, PRIOR1, INDICATOR, DURATION, ARRIVAL)
ALL_CTES = (*STAY_CTES, LONG, INSIDE, STATES_SQL, BASE1, BASE, PRE)
