"""Study-shaped views over the driver's tables, as DataFrames and (for the oracle) as SQL text.

``subject_rows`` plays the master table (several index candidates per subject, a sentinel date, copies), ``stays`` the
hospital stays and ``updates`` the monitoring table. ``study`` stands for a matched study: neighbouring customers form
the pairs. All read whole tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.config import StudyConfig
from pairwell.operators.clean import as_ordered, null_if, recode, recoded
from pairwell.skew import HotKeys, hot_keys

CFG = StudyConfig(
    study_start=date(1995, 4, 1),
    study_end=date(2000, 12, 31),
    wave_cutoff=date(1996, 1, 1),
    index_sentinel=date(1994, 12, 26),
    min_days_to_stay=-60,
    max_days_to_stay=365,
    max_days_prior_stay=720,
    max_days_to_death=1500,
    sex_labels={"1": "male", "2": "female", "999": None},
    death_reason_labels={
        "1-URGENT": "positive",
        "2-HIGH": "suspect",
        "3-MEDIUM": "other",
        "4-NOT SPECIFIED": None,
        "5-LOW": "negative",
    },
    situation_labels={"none": None},
    division_labels={},
)
STATES = ("none", "recovered", "mild", "moderate", "severe", "critical", "dead")
# limits used on the ``study`` view
DEATH_LIMIT, STAY_LIMIT, STAY_ORIGIN = 60, 21, -2


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the footer once per path, later reads name it."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _state(number):
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), number.cast("int") + 1)


def hot_stays(spark: SparkSession, sf_dir: str) -> HotKeys:
    """Hot subjects of ``stays`` and ``updates``."""
    return hot_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id")), ["subject_id"])


_SUBJECT = "CASE WHEN c_custkey % 211 = 0 THEN NULL ELSE c_custkey END"
_SEX = """CASE WHEN c_nationkey = 13 THEN NULL WHEN c_nationkey % 7 = 6 THEN '999'
              WHEN c_nationkey % 2 = 0 THEN '1' ELSE '2' END"""
_NO_VACCINE = "CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD') THEN 'Y' END"
_DEATH = "CASE WHEN c_custkey % 5 = 0 THEN '1' WHEN c_custkey % 3 = 0 THEN NULL ELSE '0' END"
_REASONS = """['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"""


def hot_master(spark: SparkSession, sf_dir: str) -> HotKeys:
    """Hot subjects of ``subject_rows``: only the missing id can be one."""
    return hot_keys(table(spark, sf_dir, "customer").select(F.expr(_SUBJECT).alias("subject_id")), ["subject_id"])


def subject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer with orders: the first order week; for some the same week with another reason (a repeated pair),
    the last order week (a second candidate), or an exact copy."""
    week = F.date_trunc("week", "o_orderdate").cast("date")
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(week).alias("first_week"), F.max(week).alias("last_week")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    reason = lambda shift: F.element_at(
        F.array(*[F.lit(r) for r in CFG.death_reason_labels]), ((F.col("c_custkey") + shift) % 5 + 1).cast("int")
    )
    row = lambda day, shift, cond: F.when(cond, F.struct(F.col(day).alias("day"), reason(shift).alias("reason")))
    key = F.col("c_custkey")
    rows = F.array_compact(
        F.array(
            row("first_week", 0, F.lit(True)),
            row("first_week", 1, key % 8 == 3),
            row("last_week", 0, key % 4 == 1),
            row("first_week", 0, key % 7 == 2),
        )
    )
    return (
        spans.join(customers, "c_custkey")
        .withColumn("r", F.explode(rows))
        .select(
            F.expr(_SUBJECT).alias("subject_id"),
            F.col("r.day").alias("index_date"),
            F.expr(_SEX).alias("sex_code"),
            F.expr("CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(1930 + c_custkey % 85 AS INT) END").alias("birth_year"),
            F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN 'Y' END").alias("within_5"),
            F.expr(_NO_VACCINE).alias("no_vaccine"),
            F.expr(_DEATH).alias("ind_death"),
            F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN date_sub(r.day, CAST(c_custkey % 6 AS INT)) END")
            .alias("first_dose_date"),
            F.col("r.reason").alias("death_reason"),
        )
    )


SUBJECT_ROWS = f"""subject_rows AS (
  SELECT {_SUBJECT} AS subject_id, day AS index_date,
         {_SEX} AS sex_code,
         CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(1930 + c_custkey % 85 AS INTEGER) END AS birth_year,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Y' END AS within_5,
         {_NO_VACCINE} AS no_vaccine, {_DEATH} AS ind_death,
         CASE WHEN c_mktsegment = 'BUILDING' THEN day - CAST(c_custkey % 6 AS INTEGER) END AS first_dose_date,
         {_REASONS}[(c_custkey + shift) % 5 + 1] AS death_reason
  FROM (
    WITH spans AS (SELECT o_custkey, MIN(CAST(date_trunc('week', o_orderdate) AS DATE)) AS first_week,
                          MAX(CAST(date_trunc('week', o_orderdate) AS DATE)) AS last_week FROM orders GROUP BY o_custkey)
    SELECT o_custkey, first_week AS day, 0 AS shift FROM spans
    UNION ALL SELECT o_custkey, first_week, 1 FROM spans WHERE o_custkey % 8 = 3
    UNION ALL SELECT o_custkey, last_week, 0 FROM spans WHERE o_custkey % 4 = 1
    UNION ALL SELECT o_custkey, first_week, 0 FROM spans WHERE o_custkey % 7 = 2) r
  JOIN customer ON c_custkey = o_custkey)"""


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.expr("CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), "
               "CAST(60 - o_orderkey * 37 % 401 AS INT)) END").alias("arrival"),
        F.expr("CAST(o_orderkey % 45 - 1 AS INT)").alias("recorded_days"),
        F.expr("o_orderkey % 17 = 0").alias("_open"),
        F.expr("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'dedicated' ELSE 'standard' END")
        .alias("division"),
        F.expr("CASE WHEN o_custkey % 5 = 0 AND o_custkey % 11 <> 0 THEN date_add(DATE'1998-01-01', CAST("
               "o_custkey * 7 % 900 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS INT)) END").alias("death_date"),
    )
    release = F.when(~F.col("_open"), F.date_add("arrival", F.col("recorded_days")))
    return rows.select("subject_id", "arrival", release.alias("release_date"), "recorded_days", "division", "death_date")


STAYS = """stays AS (
  SELECT subject_id, arrival, CASE WHEN NOT is_open THEN arrival + recorded_days END AS release_date,
         recorded_days, division, death_date
  FROM (SELECT o_custkey AS subject_id,
               CASE WHEN o_orderkey % 61 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(60 - o_orderkey * 37 % 401 AS INTEGER) END AS arrival,
               CAST(o_orderkey % 45 - 1 AS INTEGER) AS recorded_days, o_orderkey % 17 = 0 AS is_open,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'dedicated' ELSE 'standard' END AS division,
               CASE WHEN o_custkey % 5 = 0 AND o_custkey % 11 <> 0 THEN DATE '1998-01-01' + CAST(
                 o_custkey * 7 % 900 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS death_date
        FROM orders) s)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = F.expr("date_add(CAST(o_orderdate AS DATE), CAST(60 - o_orderkey * 37 % 401 AS INT))")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.date_add(arrival, 1).alias("first_date"),
        _state(F.expr("o_orderkey % 7")).alias("first_state"),
        F.date_add(arrival, 9).alias("last_date"),
        _state(F.expr("(o_orderkey % 49 - o_orderkey % 7) DIV 7")).alias("last_state"),
    )


def _sql_state(number: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES))
    return f"CASE {number} {whens} END"


UPDATES = f"""updates AS (
  SELECT o_custkey AS subject_id,
         CAST(o_orderdate AS DATE) + CAST(60 - o_orderkey * 37 % 401 AS INTEGER) + 1 AS first_date,
         {_sql_state('o_orderkey % 7')} AS first_state,
         CAST(o_orderdate AS DATE) + CAST(60 - o_orderkey * 37 % 401 AS INTEGER) + 9 AS last_date,
         {_sql_state('(o_orderkey % 49 - o_orderkey % 7) // 7')} AS last_state
  FROM orders)"""


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer that has orders; customers 2k and 2k+1 are a pair, k its name."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("index_date"), F.count(F.lit(1)).alias("n_orders")
    )
    rows = table(spark, sf_dir, "customer").join(first, "c_custkey").withColumn("k", F.expr("c_custkey DIV 2"))
    rows = rows.select(
        F.col("c_custkey").alias("subject_id"),
        F.concat(F.lit("p"), F.col("k").cast("string")).alias("subclass"),
        F.expr("CAST(c_custkey % 2 AS STRING)").alias("arm"),
        F.expr("CAST(12 + k * 7 % 85 AS INT)").alias("age"),
        F.expr("CASE WHEN k % 3 = 0 THEN 'male' ELSE 'female' END").alias("sex"),
        F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'mild' WHEN 'MACHINERY' THEN 'moderate' WHEN 'AUTOMOBILE' "
               "THEN 'severe' WHEN 'FURNITURE' THEN 'critical' ELSE 'not_hospitalized' END").alias("first_state"),
        "index_date",
        F.expr("CASE WHEN c_acctbal < 800 + 700 * (c_custkey % 2) THEN '1' ELSE '0' END").alias("ind_death"),
        F.expr("CASE WHEN c_acctbal < 800 + 700 * (c_custkey % 2) THEN CAST(c_custkey * 13 % 90 AS INT) END")
        .alias("days_index_to_death"),
        F.expr("CASE WHEN c_nationkey % 10 = 0 THEN '-1' WHEN c_nationkey % 10 < 4 THEN '1' ELSE '0' END")
        .alias("ind_hospitalized"),
        F.expr("CASE WHEN c_nationkey % 10 BETWEEN 1 AND 3 THEN CAST(c_custkey % 26 - 2 AS INT) END")
        .alias("days_index_to_stay"),
        F.expr("CASE WHEN c_nationkey % 10 BETWEEN 1 AND 3 AND c_custkey % 9 <> 0 "
               "THEN c_custkey * 11 % (17 + 4 * (k % 3)) + n_orders % 3 END").alias("duration_hospitalization"),
        F.expr("CASE WHEN c_custkey % 2 = 1 THEN CAST(c_nationkey % 6 AS INT) END").alias("days_dose_to_index"),
    )
    return rows.withColumns(
        {
            "age_group": F.expr("CASE WHEN age < 55 THEN '12-54' WHEN age < 65 THEN '55-64' ELSE '65+' END"),
            "age_group_narrow": F.expr(
                "CASE WHEN age < 35 THEN '12-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' "
                "WHEN age < 65 THEN '55-64' WHEN age < 75 THEN '65-74' WHEN age < 85 THEN '75-84' ELSE '85+' END"
            ),
        }
    )


STUDY = """study AS (
  SELECT *, CASE WHEN age < 55 THEN '12-54' WHEN age < 65 THEN '55-64' ELSE '65+' END AS age_group,
         CASE WHEN age < 35 THEN '12-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54'
              WHEN age < 65 THEN '55-64' WHEN age < 75 THEN '65-74' WHEN age < 85 THEN '75-84' ELSE '85+' END AS age_group_narrow
  FROM (SELECT c_custkey AS subject_id, concat('p', CAST(k AS VARCHAR)) AS subclass,
               CAST(c_custkey % 2 AS VARCHAR) AS arm, CAST(12 + k * 7 % 85 AS INTEGER) AS age,
               CASE WHEN k % 3 = 0 THEN 'male' ELSE 'female' END AS sex,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'mild' WHEN 'MACHINERY' THEN 'moderate' WHEN 'AUTOMOBILE'
                 THEN 'severe' WHEN 'FURNITURE' THEN 'critical' ELSE 'not_hospitalized' END AS first_state,
               index_date,
               CASE WHEN c_acctbal < 800 + 700 * (c_custkey % 2) THEN '1' ELSE '0' END AS ind_death,
               CASE WHEN c_acctbal < 800 + 700 * (c_custkey % 2) THEN CAST(c_custkey * 13 % 90 AS INTEGER) END AS days_index_to_death,
               CASE WHEN c_nationkey % 10 = 0 THEN '-1' WHEN c_nationkey % 10 < 4 THEN '1' ELSE '0' END AS ind_hospitalized,
               CASE WHEN c_nationkey % 10 BETWEEN 1 AND 3 THEN CAST(c_custkey % 26 - 2 AS INTEGER) END AS days_index_to_stay,
               CASE WHEN c_nationkey % 10 BETWEEN 1 AND 3 AND c_custkey % 9 <> 0
                    THEN c_custkey * 11 % (17 + 4 * (k % 3)) + n_orders % 3 END AS duration_hospitalization,
               CASE WHEN c_custkey % 2 = 1 THEN CAST(c_nationkey % 6 AS INTEGER) END AS days_dose_to_index
        FROM (SELECT customer.*, c_custkey // 2 AS k, f.index_date, f.n_orders
              FROM customer JOIN (SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS index_date, COUNT(*) AS n_orders
                                  FROM orders GROUP BY o_custkey) f ON f.o_custkey = c_custkey) c) s)"""


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_rows`` cleaned: distinct, sentinel to NULL, codes recoded."""
    out = null_if(subject_rows(spark, sf_dir).distinct(), "index_date", CFG.index_sentinel)
    out = out.withColumns(
        {
            "sex": recoded("sex_code", CFG.sex_labels),
            "ind_death": recoded("ind_death", {}, null_to="0"),
            **{c: recoded(c, {"Y": "1"}, null_to="0") for c in ("within_5", "no_vaccine")},
        }
    )
    return as_ordered(recode(out, "death_reason", CFG.death_reason_labels), "death_reason",
                      ("negative", "other", "suspect", "positive"))


MASTER = """master AS (
  SELECT subject_id, NULLIF(index_date, DATE '1994-12-26') AS index_date, sex_code,
         CASE sex_code WHEN '1' THEN 'male' WHEN '2' THEN 'female' END AS sex, birth_year,
         CASE WHEN within_5 = 'Y' THEN '1' ELSE '0' END AS within_5,
         CASE WHEN no_vaccine = 'Y' THEN '1' ELSE '0' END AS no_vaccine,
         COALESCE(ind_death, '0') AS ind_death, first_dose_date,
         CASE death_reason WHEN '1-URGENT' THEN 'positive' WHEN '2-HIGH' THEN 'suspect'
              WHEN '3-MEDIUM' THEN 'other' WHEN '5-LOW' THEN 'negative' END AS death_reason
  FROM (SELECT DISTINCT * FROM subject_rows) d)"""

SOURCES = [SUBJECT_ROWS, STAYS, UPDATES, STUDY, MASTER]


def with_views(*extra: str) -> str:
    """``WITH`` clause holding every view and ``extra`` members after them."""
    return "WITH RECURSIVE " + ",\n".join([*SOURCES, *extra]) + "\n"
