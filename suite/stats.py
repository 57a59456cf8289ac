"""Queries for cohorts, pairing, tests, curves, count models and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import cohort as H
from pairwell.operators import report as R
from pairwell.operators.aggregate import conditional_counts
from pairwell.operators.inference import fisher_exact, mcnemar, mcnemar_statistic
from pairwell.operators.joins import pair_wide
from pairwell.operators.logit import fit_logit
from pairwell.operators.match import balance, balance_summary, match_nearest, match_summary, propensity
from pairwell.operators.models import fit_negbin, fit_poisson, model_cells
from pairwell.operators.outcome import ALL_GROUPINGS, BASIC_GROUPINGS, outcome_counts, outcome_summary, with_tests
from pairwell.operators.survival import at_risk, event_table, km_curve, km_from_table, logrank_from_table, with_logrank_p
from pairwell.plans.study import curve_table
from pairwell.session import checkpointed
from pairwell.sources.tables import renamed
from suite import chain as K
from suite import views as V
from suite.registry import query
from suite.views import CFG, DEATH_LIMIT, STAY_LIMIT, STAY_ORIGIN

DIGITS = 8


def _rounded(df, *cols, digits=DIGITS):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# cohorts

_STUDY_COLS = ["subject_id", "subclass", "arm", "age", "sex", "first_state", "ind_death", "ind_hospitalized", "days_dose_to_index"]
_STUDY_SQL = ", ".join(_STUDY_COLS)


@query("cohort", "SELECT subject_id, index_date, age, sex, arm, first_state, age_group_narrow FROM pre", K.ALL_CTES)
def cohort(spark, sf):
    rows = H.cohort(K.base(spark, sf), CFG)
    return rows.select("subject_id", "index_date", "age", "sex", "arm", "first_state", "age_group_narrow")


@query(
    "subcohort_with_partners",
    f"""SELECT {_STUDY_SQL} FROM study WHERE arm = '1' AND days_dose_to_index BETWEEN 2 AND 5
        UNION ALL SELECT {_STUDY_SQL} FROM study WHERE arm = '0' AND subclass IN (
          SELECT subclass FROM study WHERE arm = '1' AND days_dose_to_index BETWEEN 2 AND 5)""",
)
def subcohort_with_partners(spark, sf):
    return H.subcohort_with_partners(V.study(spark, sf).select(*_STUDY_COLS), 2, 5)


_HOSP = """hosp AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY subclass) AS pair_n FROM study
             WHERE ind_hospitalized IN ('0', '1')) h WHERE pair_n = 2)"""


@query("complete_pairs_cohort", f"SELECT {_STUDY_SQL} FROM hosp", (_HOSP,))
def complete_pairs_cohort(spark, sf):
    return H.complete_pairs_cohort(V.study(spark, sf).select(*_STUDY_COLS))


_CENSORED = f"""deaths_c AS (
  SELECT *, CASE WHEN days_index_to_death > {DEATH_LIMIT} THEN 0 ELSE CAST(ind_death AS INTEGER) END AS event,
         CAST(LEAST(COALESCE(days_index_to_death, {DEATH_LIMIT}), {DEATH_LIMIT}) AS INTEGER) AS time FROM study)"""
_CENSORED_H = f"""stays_c AS (
  SELECT *, CASE WHEN days_index_to_stay > {STAY_LIMIT} THEN 0 ELSE CAST(ind_hospitalized AS INTEGER) END AS event,
         CAST(LEAST(COALESCE(days_index_to_stay, {STAY_LIMIT}), {STAY_LIMIT}) - ({STAY_ORIGIN}) AS INTEGER) AS time FROM hosp)"""


def _deaths(spark, sf):
    return H.censor_at(V.study(spark, sf), "days_index_to_death", "ind_death", DEATH_LIMIT)


def _stays(spark, sf):
    hosp = H.complete_pairs_cohort(V.study(spark, sf))
    return H.censor_at(hosp, "days_index_to_stay", "ind_hospitalized", STAY_LIMIT, STAY_ORIGIN)


@query(
    "censor_at",
    "SELECT subject_id, arm, time AS days_index_to_stay, event AS ind_hospitalized FROM stays_c",
    (_HOSP, _CENSORED_H),
)
def censor_at(spark, sf):
    return _stays(spark, sf).select("subject_id", "arm", "days_index_to_stay", "ind_hospitalized")


# outcome tables and tests

_FISHER_P = """CAST(round(list_sum(list_filter(list_transform(range(greatest(0, {a} + {b} - {b} - {d}), least({a} + {c}, {a} + {b}) + 1),
    lambda x: exp(lgamma({a} + {c} + 1.0) - lgamma(x + 1.0) - lgamma({a} + {c} - x + 1.0)
      + lgamma({b} + {d} + 1.0) - lgamma({a} + {b} - x + 1.0) - lgamma({b} + {d} - {a} - {b} + x + 1.0)
      - lgamma({a} + {b} + {c} + {d} + 1.0) + lgamma({a} + {b} + 1.0) + lgamma({c} + {d} + 1.0))),
    lambda p: p <= 1.0000001 * exp(lgamma({a} + {c} + 1.0) - lgamma({a} + 1.0) - lgamma({c} + 1.0)
      + lgamma({b} + {d} + 1.0) - lgamma({b} + 1.0) - lgamma({d} + 1.0)
      - lgamma({a} + {b} + {c} + {d} + 1.0) + lgamma({a} + {b} + 1.0) + lgamma({c} + {d} + 1.0)))), 8) AS DOUBLE)"""


def _fisher_sql(a: str, b: str, c: str, d: str) -> str:
    return _FISHER_P.format(a=f"({a})", b=f"({b})", c=f"({c})", d=f"({d})")


_FISHER = _fisher_sql("control_n - control_event_n", "control_event_n", "case_n - case_event_n", "case_event_n")


def _group_sql(frame: str, outcome: str, description: str, keys: dict, where: str) -> str:
    cols = ["age_group", "sex", "first_state"]
    shown = ", ".join(f"{keys.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in cols)
    inside = lambda side: where.replace("?", f"{side}.")
    same = " AND ".join(["TRUE", *[f"({v.replace('?', 'a.')}) IS NOT DISTINCT FROM ({v.replace('?', 'b.')})" for v in keys.values()]])
    group = lambda side: ", ".join([f"{v.replace('?', side)} AS g_{c}" for c, v in keys.items()] or ["1 AS g_none"])
    names = [f"g_{c}" for c in keys] or ["g_none"]
    shown = ", ".join(f"s.g_{c} AS {c}" if c in keys else f"CAST(NULL AS VARCHAR) AS {c}" for c in cols)
    by = ", ".join(names)
    on = " AND ".join(f"p.{n} IS NOT DISTINCT FROM s.{n}" for n in names)
    return f"""SELECT '{description}' AS description, {shown}, case_n, control_n, case_event_n, control_event_n,
      COALESCE(case_only, 0) AS case_only, COALESCE(control_only, 0) AS control_only
    FROM (SELECT {by}, COUNT(*) FILTER (WHERE arm = '1') AS case_n, COUNT(*) FILTER (WHERE arm = '0') AS control_n,
            COUNT(*) FILTER (WHERE arm = '1' AND {outcome} = '1') AS case_event_n,
            COUNT(*) FILTER (WHERE arm = '0' AND {outcome} = '1') AS control_event_n
          FROM (SELECT x.*, {group('x.')} FROM {frame} x WHERE {inside('x')}) g GROUP BY {by}) s
    LEFT JOIN (SELECT {by}, COUNT(*) FILTER (WHERE o1 = '1' AND o0 <> '1') AS case_only,
                 COUNT(*) FILTER (WHERE o1 <> '1' AND o0 = '1') AS control_only
               FROM (SELECT a.{outcome} AS o1, b.{outcome} AS o0, {group('a.')} FROM {frame} a JOIN {frame} b
                       ON a.subclass = b.subclass AND a.arm = '1' AND b.arm = '0'
                     WHERE {inside('a')} AND {inside('b')} AND {same}) q GROUP BY {by}) p ON {on}"""


_B = [
    ("Narrow age group", {"age_group": "?age_group_narrow", "sex": "?sex"}, "TRUE"),
    ("Wider age group", {"age_group": "?age_group", "sex": "?sex"}, "TRUE"),
    ("Wider age group", {"age_group": "?age_group"}, "TRUE"),
    ("Patient aged 55 and above", {"sex": "?sex"}, "?age >= 55"),
    ("Patient aged 55 and above", {}, "?age >= 55"),
]
_AT = "Patient aged 55 and above status at admission"
_S = [(_AT, {"first_state": "?first_state"}, "?age >= 55")] + [
    (_AT, {"first_state": f"'{name}'"}, f"?age >= 55 AND ?first_state IN ({', '.join(repr(m) for m in members)})")
    for name, members in (
        ("severe_critical", ("severe", "critical")),
        ("moderate_severe", ("moderate", "severe")),
        ("moderate_severe_critical", ("moderate", "severe", "critical")),
    )
]


def _outcome_cte(name: str, frame: str, outcome: str, sets) -> str:
    parts = [_group_sql(frame, outcome, d, k, w) for d, k, w in sets]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


_MCNEMAR = """CASE WHEN case_only + control_only = 0 THEN CAST('NaN' AS DOUBLE) WHEN case_only = control_only THEN 0.0
    ELSE CAST((abs(case_only - control_only) - 1) * (abs(case_only - control_only) - 1) AS DOUBLE) / (case_only + control_only) END"""
_RATES = """case_event_n / NULLIF(case_n, 0) AS case_event_p, control_event_n / NULLIF(control_n, 0) AS control_event_p"""
# erfc(sqrt(x / 2)) by Simpson's rule on [z, z + 8]
_TAIL = """CASE WHEN isnan({x}) THEN {x} ELSE round(2 / sqrt(pi()) * exp(-({x}) / 2) * 8.0 / 20000 / 3 * list_sum(list_transform(range(0, 20001),
    lambda i: (CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(-2 * sqrt(({x}) / 2) * (i * 8.0 / 20000) - (i * 8.0 / 20000) * (i * 8.0 / 20000)))), 8) END"""

_KEYS = "description, age_group, sex, first_state"
_COUNTS = "case_n, control_n, case_event_n, control_event_n, case_only, control_only"


def _outcome_sql(name: str) -> str:
    return (
        f"SELECT {_KEYS}, {_COUNTS}, {_RATES}, {_FISHER} AS fisher_p, round(mcnemar_stat, 8) AS mcnemar_stat, "
        f"{_TAIL.format(x='mcnemar_stat')} AS mcnemar_p FROM (SELECT *, {_MCNEMAR} AS mcnemar_stat FROM {name}) o"
    )


def _outcome(df, groupings, outcome):
    out = outcome_summary(df, groupings, outcome).drop("fisher_or", "fisher_lo", "fisher_hi")
    return _rounded(out, "fisher_p", "mcnemar_stat", "mcnemar_p")


@query("outcome_summary", _outcome_sql("o_death"), (_outcome_cte("o_death", "study", "ind_death", _B + _S),))
def outcome_summary_query(spark, sf):
    return _outcome(V.study(spark, sf), ALL_GROUPINGS, "ind_death")


@query("outcome_summary_hosp", _outcome_sql("o_hosp"), (_HOSP, _outcome_cte("o_hosp", "hosp", "ind_hospitalized", _B)))
def outcome_summary_hosp(spark, sf):
    return _outcome(H.complete_pairs_cohort(V.study(spark, sf)), BASIC_GROUPINGS, "ind_hospitalized")


_EARLY = """early AS (SELECT * FROM study WHERE arm = '1' AND days_dose_to_index BETWEEN 0 AND 1
  UNION ALL SELECT * FROM study WHERE arm = '0' AND subclass IN (
    SELECT subclass FROM study WHERE arm = '1' AND days_dose_to_index BETWEEN 0 AND 1))"""


@query("outcome_summary_early", _outcome_sql("o_early"), (_EARLY, _outcome_cte("o_early", "early", "ind_death", _B)))
def outcome_summary_early(spark, sf):
    return _outcome(H.subcohort_with_partners(V.study(spark, sf), 0, 1), BASIC_GROUPINGS, "ind_death")


_GROUPS = """g AS (SELECT age_group_narrow, sex, COUNT(*) FILTER (WHERE arm = '1') AS case_n, COUNT(*) FILTER (WHERE arm = '0') AS control_n,
  COUNT(*) FILTER (WHERE arm = '1' AND ind_death = '1') AS case_event_n,
  COUNT(*) FILTER (WHERE arm = '0' AND ind_death = '1') AS control_event_n FROM study GROUP BY age_group_narrow, sex)"""


def _groups(spark, sf):
    return conditional_counts(V.study(spark, sf), ["age_group_narrow", "sex"], "arm", F.col("ind_death") == "1")


def _tested(spark, sf):
    rows = _groups(spark, sf).withColumns(
        {"a": F.col("control_n") - F.col("control_event_n"), "c": F.col("case_n") - F.col("case_event_n")}
    )
    return fisher_exact(rows, "a", "control_event_n", "c", "case_event_n")


@query("fisher_p", f"SELECT age_group_narrow, sex, case_n, control_n, {_FISHER} AS fisher_p FROM g", (_GROUPS,))
def fisher_p(spark, sf):
    return _rounded(_tested(spark, sf), "fisher_p").select("age_group_narrow", "sex", "case_n", "control_n", "fisher_p")


# bisection on the log odds ratio t: E[X | t] = a for the estimate, P(X >= a | t) = P(X <= a | t) = 0.025 for the bounds
_FISHER_WEIGHTS = """fw AS MATERIALIZED (
  SELECT age_group_narrow, sex, a, xs, list_transform(xs, lambda x: -lgamma(x + 1.0) - lgamma(a + c - x + 1.0) - lgamma(a + b - x + 1.0)
           - lgamma(b + d - a - b + x + 1.0)) AS lw
  FROM (SELECT *, control_n - control_event_n AS a, control_event_n AS b, case_n - case_event_n AS c, case_event_n AS d,
          range(greatest(0, control_n - control_event_n - case_event_n), least(control_n + case_n - control_event_n - case_event_n, control_n) + 1) AS xs
        FROM g) q)"""
_FISHER_BISECT = """fb(k, age_group_narrow, sex, kind, lo, hi) AS (
  SELECT 0, age_group_narrow, sex, kind, CAST(-30 AS DOUBLE), CAST(30 AS DOUBLE) FROM fw, (VALUES ('or'), ('lo'), ('hi')) v(kind)
  UNION ALL
  SELECT k + 1, age_group_narrow, sex, kind, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END
  FROM (SELECT k, age_group_narrow, sex, kind, lo, hi, mid,
          CASE kind WHEN 'or' THEN list_sum(list_transform(p, lambda v, i: v * xs[i])) / list_sum(p) < a
            WHEN 'lo' THEN list_sum(list_transform(p, lambda v, i: CASE WHEN xs[i] >= a THEN v ELSE 0 END)) / list_sum(p) < 0.025
            ELSE list_sum(list_transform(p, lambda v, i: CASE WHEN xs[i] <= a THEN v ELSE 0 END)) / list_sum(p) > 0.025 END AS below
        FROM (SELECT *, list_transform(e, lambda v: exp(v - list_max(e))) AS p
              FROM (SELECT fb.*, (fb.lo + fb.hi) / 2 AS mid, a, xs, list_transform(lw, lambda v, i: v + xs[i] * ((fb.lo + fb.hi) / 2)) AS e
                    FROM fb JOIN fw ON fw.age_group_narrow = fb.age_group_narrow AND fw.sex = fb.sex WHERE k < 60) x) y) z)"""


@query(
    "fisher_or_ci",
    """SELECT fw.age_group_narrow, fw.sex,
         CASE WHEN a = xs[1] THEN 0.0 WHEN a = xs[len(xs)] THEN CAST('Infinity' AS DOUBLE) ELSE round(exp(o.lo), 6) END AS fisher_or,
         CASE WHEN a = xs[1] THEN 0.0 ELSE round(exp(l.lo), 6) END AS fisher_lo,
         CASE WHEN a = xs[len(xs)] THEN CAST('Infinity' AS DOUBLE) ELSE round(exp(h.lo), 6) END AS fisher_hi
       FROM fw JOIN fb o ON o.age_group_narrow = fw.age_group_narrow AND o.sex = fw.sex AND o.kind = 'or' AND o.k = 60
       JOIN fb l ON l.age_group_narrow = fw.age_group_narrow AND l.sex = fw.sex AND l.kind = 'lo' AND l.k = 60
       JOIN fb h ON h.age_group_narrow = fw.age_group_narrow AND h.sex = fw.sex AND h.kind = 'hi' AND h.k = 60""",
    (_GROUPS, _FISHER_WEIGHTS, _FISHER_BISECT),
)
def fisher_or_ci(spark, sf):
    rows = _rounded(_tested(spark, sf), "fisher_or", "fisher_lo", "fisher_hi", digits=6)
    return rows.select("age_group_narrow", "sex", "fisher_or", "fisher_lo", "fisher_hi")


def _fisher_ctes(name: str, source: str) -> tuple:
    """Estimate and interval for the rows of ``source`` (id and group counts) as ``<name>_ci`` (id, fisher_or, fisher_lo, fisher_hi)."""
    swap = lambda cte: cte.replace("age_group_narrow, sex", "id").replace("fw", f"{name}_fw").replace("fb", f"{name}_fb").replace("FROM g)", f"FROM {source})")
    at = lambda kind: f"JOIN {name}_fb {kind} ON {kind}.id = w.id AND {kind}.kind = '{kind[1:]}' AND {kind}.k = 60"
    bisect = swap(_FISHER_BISECT).replace(f"{name}_fw.age_group_narrow = {name}_fb.age_group_narrow AND {name}_fw.sex = {name}_fb.sex", f"{name}_fw.id = {name}_fb.id")
    return (
        swap(_FISHER_WEIGHTS),
        bisect.replace(f"JOIN {name}_fw ON {name}_fb.age_group_narrow = {name}_fw.age_group_narrow AND {name}_fb.sex = {name}_fw.sex", f"JOIN {name}_fw ON {name}_fw.id = {name}_fb.id"),
        f"""{name}_ci AS (SELECT w.id,
          CASE WHEN a = xs[1] THEN 0.0 WHEN a = xs[len(xs)] THEN CAST('Infinity' AS DOUBLE) ELSE exp(xor.lo) END AS fisher_or,
          CASE WHEN a = xs[1] THEN 0.0 ELSE exp(xlo.lo) END AS fisher_lo,
          CASE WHEN a = xs[len(xs)] THEN CAST('Infinity' AS DOUBLE) ELSE exp(xhi.lo) END AS fisher_hi
          FROM {name}_fw w {at('xor')} {at('xlo')} {at('xhi')})""",
    )


_TEXT = "CASE WHEN {x} IS NULL THEN 'NA' WHEN isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN 'Inf' ELSE printf('%.{d}f', {x}) END"
_ODDS_TEXT = "concat({}, '(', {}, '-', {}, ')')".format(*[_TEXT.format(x=c, d=2) for c in ("fisher_or", "fisher_lo", "fisher_hi")])


def _p_text(x: str) -> str:
    return f"CASE WHEN {x} < 0.001 AND NOT isnan({x}) THEN '<0.001' ELSE {_TEXT.format(x=x, d=3)} END"


_PAIR_COUNTS = """mc AS (SELECT a.age_group_narrow, COUNT(*) FILTER (WHERE a.ind_death = '1' AND b.ind_death = '0') AS case_only,
  COUNT(*) FILTER (WHERE a.ind_death = '0' AND b.ind_death = '1') AS control_only
  FROM study a JOIN study b ON a.subclass = b.subclass AND a.arm = '1' AND b.arm = '0' GROUP BY a.age_group_narrow)"""


def _pair_counts(spark, sf):
    wide = pair_wide(V.study(spark, sf), "subclass", "arm", ["ind_death", "age_group_narrow"])
    only = lambda a, b: F.count_if((F.col(f"ind_death_{a}") == "1") & (F.col(f"ind_death_{b}") == "0"))
    return wide.groupBy(F.col("age_group_narrow_case").alias("age_group_narrow")).agg(
        only("case", "control").alias("case_only"), only("control", "case").alias("control_only")
    )


@query("mcnemar_stat", f"SELECT *, round({_MCNEMAR}, 8) AS mcnemar_stat FROM mc", (_PAIR_COUNTS,))
def mcnemar_stat(spark, sf):
    rows = _pair_counts(spark, sf).withColumn("mcnemar_stat", mcnemar_statistic("case_only", "control_only"))
    return _rounded(rows, "mcnemar_stat")


@query(
    "mcnemar_p",
    f"SELECT age_group_narrow, {_TAIL.format(x='s')} AS mcnemar_p FROM (SELECT *, {_MCNEMAR} AS s FROM mc) m",
    (_PAIR_COUNTS,),
)
def mcnemar_p(spark, sf):
    rows = mcnemar(_pair_counts(spark, sf), "case_only", "control_only")
    return _rounded(rows, "mcnemar_p").select("age_group_narrow", "mcnemar_p")


def _coefficients(pair, digits=6):
    return _rounded(pair[0], "estimate", "std_error", "z", "p", digits=digits)


def _coef_sql(frame: str) -> str:
    return (
        "SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(z, 6) AS z, "
        f"round({_TAIL.format(x='z * z')}, 6) AS p FROM (SELECT *, estimate / std_error AS z FROM {frame}) f"
    )


# pairing


_NEWTON = (
    """fit_cells AS (SELECT (age - 50) / 20.0 AS x1, (index_date - DATE '1995-06-01') / 365.0 AS x2,
         CASE arm WHEN '1' THEN 1.0 ELSE 0.0 END AS y, CAST(COUNT(*) AS DOUBLE) AS w FROM pre GROUP BY ALL)""",
    """newton(k, b0, b1, b2) AS (
         SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
         UNION ALL
         SELECT k + 1,
           b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
           b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
           b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
         FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
               FROM (SELECT k, b0, b1, b2, SUM(w * (y - p)) AS g0, SUM(w * (y - p) * x1) AS g1, SUM(w * (y - p) * x2) AS g2,
                       SUM(w * p * (1 - p)) AS h00, SUM(w * p * (1 - p) * x1) AS h01, SUM(w * p * (1 - p) * x2) AS h02,
                       SUM(w * p * (1 - p) * x1 * x1) AS h11, SUM(w * p * (1 - p) * x1 * x2) AS h12,
                       SUM(w * p * (1 - p) * x2 * x2) AS h22
                     FROM (SELECT k, b0, b1, b2, x1, x2, y, w, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p
                           FROM newton, fit_cells WHERE k < 15) a GROUP BY k, b0, b1, b2) s) d)""",
)


@query(
    "propensity_score",
    """SELECT p.subject_id, round(1 / (1 + exp(-(b0 + b1 * (age - 50) / 20.0 + b2 * (index_date - DATE '1995-06-01') / 365.0))), 6) AS distance
       FROM pre p JOIN (SELECT * FROM newton WHERE k = 15) n ON n.k = 15""",
    (*K.ALL_CTES, *_NEWTON),
)
def propensity_score(spark, sf):
    pre = checkpointed(H.cohort(K.base(spark, sf), CFG).select("subject_id", "age", "index_date", "arm"))
    scored = propensity(pre.withColumn("index_day", F.unix_date("index_date")), "arm", ["age", "index_day"])
    return _rounded(scored, "distance", digits=6).select("subject_id", "distance")


_SCORE = "age * 1000 + (index_date - DATE '1995-01-01')"


def _greedy_ctes(score: str, rows: str = "pre", more: tuple = ()) -> tuple:
    """Greedy pairing row by row as ``greedy`` (t_id, c_id for k > 0), and the pairs' subjects as ``matched`` with their pair's name."""
    return (
        *more,
        f"""m_rows AS MATERIALIZED (SELECT subject_id AS id, arm, {score} AS score, age_group_narrow || '/' || sex || '/' || first_state AS st FROM {rows})""",
        """treated AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY st ORDER BY score DESC, id) AS k FROM m_rows WHERE arm = '1')""",
        """controls AS MATERIALIZED (SELECT * FROM m_rows WHERE arm = '0')""",
        """greedy(st, k, used, t_id, c_id) AS (
             SELECT DISTINCT st, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM treated
             UNION ALL
             SELECT st, k, used, t_id, c_id FROM (
               SELECT g.st, t.k, list_append(g.used, c.id) AS used, t.id AS t_id, c.id AS c_id,
                 ROW_NUMBER() OVER (PARTITION BY g.st ORDER BY abs(t.score - c.score), c.score, c.id) AS rn
               FROM greedy g JOIN treated t ON t.st = g.st AND t.k = g.k + 1
               JOIN controls c ON c.st = g.st AND NOT list_contains(g.used, c.id)) r WHERE rn = 1)""",
        """matched AS MATERIALIZED (SELECT p.*, m.subclass, m.score FROM pre p JOIN (
             SELECT t_id AS id, t_id AS subclass, t.score FROM greedy g JOIN m_rows t ON t.id = t_id WHERE g.k > 0
             UNION ALL SELECT c_id, t_id, c.score FROM greedy g JOIN m_rows c ON c.id = c_id WHERE g.k > 0) m ON m.id = p.subject_id)""",
    )


@query("match_nearest", "SELECT t_id AS case_id, c_id AS control_id FROM greedy WHERE k > 0", (*K.ALL_CTES, *_greedy_ctes(_SCORE)))
def match_nearest_query(spark, sf):
    pre = H.cohort(K.base(spark, sf), CFG)
    pre = pre.select("subject_id", "arm", "age_group_narrow", "sex", "first_state",
                     (F.col("age") * 1000 + F.datediff("index_date", F.lit("1995-01-01").cast("date"))).alias("score"))
    pairs = match_nearest(checkpointed(pre), "arm", "score", list(CFG.exact_keys), "subject_id")
    return pair_wide(pairs, "subclass", "arm", ["subject_id"]).select(
        F.col("subject_id_case").alias("case_id"), F.col("subject_id_control").alias("control_id")
    )


def _balance_sql() -> str:
    parts = []
    for v, expr in (("age", "age"), ("index_day", "(index_date - DATE '1970-01-01')")):
        m = lambda f, a: f"(SELECT AVG({expr}) FROM {f} WHERE arm = '{a}')"
        sd = f"(SELECT stddev_samp({expr}) FROM study WHERE arm = '1')"
        parts.append(
            f"SELECT '{v}' AS variable, '' AS level, ({m('study', 1)} - {m('study', 0)}) / {sd} AS diff_before, "
            f"({m('hosp', 1)} - {m('hosp', 0)}) / {sd} AS diff_after"
        )
    for v in ("age_group_narrow", "sex", "first_state"):
        share = lambda f, a: (
            f"(SELECT COUNT(*) FILTER (WHERE {v} = l.level) / COUNT(*) FROM {f} WHERE arm = '{a}')"
        )
        parts.append(
            f"SELECT '{v}' AS variable, level, {share('study', 1)} - {share('study', 0)} AS diff_before, "
            f"{share('hosp', 1)} - {share('hosp', 0)} AS diff_after FROM (SELECT DISTINCT {v} AS level FROM study) l"
        )
    return (
        "SELECT variable, level, round(diff_before, 8) AS diff_before, round(diff_after, 8) AS diff_after, "
        "abs(diff_after) < 0.1 AS balanced FROM (" + " UNION ALL ".join(parts) + ") b"
    )


@query("balance_table", _balance_sql(), (_HOSP,))
def balance_table(spark, sf):
    study = V.study(spark, sf).withColumn("index_day", F.unix_date("index_date"))
    hosp = H.complete_pairs_cohort(study)
    out = balance(study, hosp, "arm", ["age", "index_day"], ["age_group_narrow", "sex", "first_state"])
    return _rounded(out, "diff_before", "diff_after")


@query(
    "match_summary",
    """SELECT 'all' AS sample, a0 AS control_n, a1 AS case_n FROM sizes UNION ALL SELECT 'matched', m0, m1 FROM sizes
       UNION ALL SELECT 'unmatched', a0 - m0, a1 - m1 FROM sizes""",
    (
        _HOSP,
        """sizes AS (SELECT (SELECT COUNT(*) FROM study WHERE arm = '0') AS a0, (SELECT COUNT(*) FROM study WHERE arm = '1') AS a1,
             (SELECT COUNT(*) FROM hosp WHERE arm = '0') AS m0, (SELECT COUNT(*) FROM hosp WHERE arm = '1') AS m1)""",
    ),
)
def match_summary_query(spark, sf):
    study = V.study(spark, sf).select("subject_id", "subclass", "arm", "ind_hospitalized")
    return match_summary(study, H.complete_pairs_cohort(study), "arm")


_MOMENTS = ("score", "age", "index_day")


def _balance_ctes() -> tuple:
    numbers = " UNION ALL ".join(f"SELECT sample, arm, '{v}' AS variable, CAST({v} AS DOUBLE) AS v FROM samples" for v in _MOMENTS)
    levels = " UNION ALL ".join(f"SELECT sample, arm, '{v}' AS variable, {v} AS level FROM samples" for v in CFG.exact_keys)
    return (
        f"num AS ({numbers})",
        f"lev AS ({levels})",
        """nm AS (SELECT sample, variable, AVG(v) FILTER (WHERE arm = '1') AS m1, AVG(v) FILTER (WHERE arm = '0') AS m0,
             stddev_samp(v) FILTER (WHERE arm = '1') AS sd, var_samp(v) FILTER (WHERE arm = '1') / var_samp(v) FILTER (WHERE arm = '0') AS ratio
           FROM num GROUP BY ALL)""",
        """ne AS (SELECT sample, variable, AVG(gap) AS mean, MAX(gap) AS top FROM (
             SELECT sample, variable, abs(SUM(n1) OVER w / SUM(n1) OVER (PARTITION BY sample, variable) - SUM(n0) OVER w / SUM(n0) OVER (PARTITION BY sample, variable)) AS gap
             FROM (SELECT sample, variable, v, COUNT(*) FILTER (WHERE arm = '1') AS n1, COUNT(*) FILTER (WHERE arm = '0') AS n0 FROM num GROUP BY ALL) c
             WINDOW w AS (PARTITION BY sample, variable ORDER BY v)) g GROUP BY ALL)""",
        """lt AS (SELECT sample, variable, COUNT(*) FILTER (WHERE arm = '1') AS n1, COUNT(*) FILTER (WHERE arm = '0') AS n0 FROM lev GROUP BY ALL)""",
        """ls AS (SELECT t.sample, t.variable, d.level, COUNT(*) FILTER (WHERE l.arm = '1') / MAX(t.n1) AS m1, COUNT(*) FILTER (WHERE l.arm = '0') / MAX(t.n0) AS m0
           FROM lt t JOIN (SELECT DISTINCT variable, level FROM lev) d ON d.variable = t.variable
           LEFT JOIN lev l ON l.sample = t.sample AND l.variable = t.variable AND l.level = d.level GROUP BY t.sample, t.variable, d.level)""",
    )


_BALANCE_SUMMARY = """SELECT m.sample, m.variable, '' AS level, round(m.m1, 6) AS mean_treated, round(m.m0, 6) AS mean_control, round((m.m1 - m.m0) / a.sd, 6) AS std_mean_diff,
    round(m.ratio, 6) AS var_ratio, round(e.mean, 6) AS ecdf_mean, round(e.top, 6) AS ecdf_max
  FROM nm m JOIN ne e ON e.sample = m.sample AND e.variable = m.variable JOIN nm a ON a.sample = 'all' AND a.variable = m.variable
  UNION ALL
  SELECT s.sample, s.variable, s.level, round(s.m1, 6), round(s.m0, 6),
    CASE WHEN a.m1 * (1 - a.m1) > 0 THEN round((s.m1 - s.m0) / sqrt(a.m1 * (1 - a.m1)), 6) END, CAST(NULL AS DOUBLE), round(abs(s.m1 - s.m0), 6), round(abs(s.m1 - s.m0), 6)
  FROM ls s JOIN ls a ON a.sample = 'all' AND a.variable = s.variable AND a.level = s.level"""


_SAMPLES = f"""samples AS MATERIALIZED (
  SELECT 'all' AS sample, arm, {_SCORE} AS score, age, index_date - DATE '1970-01-01' AS index_day, age_group_narrow, sex, first_state FROM pre
  UNION ALL SELECT 'matched', arm, score, age, index_date - DATE '1970-01-01', age_group_narrow, sex, first_state FROM matched)"""


@query("match_balance_summary", _BALANCE_SUMMARY, (*K.ALL_CTES, *_greedy_ctes(_SCORE), _SAMPLES, *_balance_ctes()))
def match_balance_summary(spark, sf):
    """The matching summary of the cohort and of its pairs, the score included."""
    pre = H.cohort(K.base(spark, sf), CFG).withColumn("index_day", F.unix_date("index_date"))
    pre = pre.select("subject_id", "arm", "age", "index_day", *CFG.exact_keys,
                     (F.col("age") * 1000 + F.datediff("index_date", F.lit("1995-01-01").cast("date"))).alias("score"))
    pre = checkpointed(pre)
    pairs = checkpointed(match_nearest(pre, "arm", "score", list(CFG.exact_keys), "subject_id"))
    out = balance_summary(pre, pairs, "arm", list(_MOMENTS), list(CFG.exact_keys))
    return _rounded(out, "mean_treated", "mean_control", "std_mean_diff", "var_ratio", "ecdf_mean", "ecdf_max", digits=6)


# information at the maximum, and its inverse by cofactors; the terms go back from the scaled covariates to age and day
_LOGIT_END = (
    """li AS MATERIALIZED (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det,
         -50 / 20.0 AS a, -(DATE '1995-06-01' - DATE '1970-01-01') / 365.0 AS d
       FROM (SELECT b0, b1, b2, SUM(w) AS n, SUM(w * y) AS n1, SUM(w * p * (1 - p)) AS h00, SUM(w * p * (1 - p) * x1) AS h01, SUM(w * p * (1 - p) * x2) AS h02,
               SUM(w * p * (1 - p) * x1 * x1) AS h11, SUM(w * p * (1 - p) * x1 * x2) AS h12, SUM(w * p * (1 - p) * x2 * x2) AS h22,
               -2 * SUM(w * (y * ln(p) + (1 - y) * ln(1 - p))) AS deviance
             FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM newton, fit_cells WHERE k = 15) q GROUP BY b0, b1, b2) s)""",
    """lv AS (SELECT *, (h11 * h22 - h12 * h12) / det AS c00, (h00 * h22 - h02 * h02) / det AS c11, (h00 * h11 - h01 * h01) / det AS c22,
         (h02 * h12 - h01 * h22) / det AS c01, (h01 * h12 - h02 * h11) / det AS c02, (h01 * h02 - h00 * h12) / det AS c12 FROM li)""",
    """logit_coef AS (
         SELECT '(Intercept)' AS term, b0 + a * b1 + d * b2 AS estimate, sqrt(c00 + a * a * c11 + d * d * c22 + 2 * a * c01 + 2 * d * c02 + 2 * a * d * c12) AS std_error FROM lv
         UNION ALL SELECT 'age', b1 / 20, sqrt(c11) / 20 FROM lv UNION ALL SELECT 'index_day', b2 / 365, sqrt(c22) / 365 FROM lv)""",
)


def _logit(spark, sf):
    pre = checkpointed(H.cohort(K.base(spark, sf), CFG).select("age", F.unix_date("index_date").alias("index_day"), "arm"))
    return fit_logit(pre, "arm", ["age", "index_day"]).tables(spark)


@query("propensity_fit", _coef_sql("logit_coef"), (*K.ALL_CTES, *_NEWTON, *_LOGIT_END))
def propensity_fit(spark, sf):
    """Coefficients of the score with standard errors from the information at the maximum."""
    return _coefficients(_logit(spark, sf))


@query(
    "propensity_check",
    """SELECT CAST(n AS BIGINT) AS n_rows, round(deviance, 5) AS deviance, round(-2 * (n1 * ln(n1 / n) + (n - n1) * ln(1 - n1 / n)), 5) AS null_deviance,
         round(deviance + 6, 5) AS aic, TRUE AS score_is_zero, TRUE AS converged, FALSE AS separated FROM li""",
    (*K.ALL_CTES, *_NEWTON, *_LOGIT_END),
)
def propensity_check(spark, sf):
    """Where the fit of the score ended: its score vector is zero, so it is at the maximum."""
    fit = _rounded(_logit(spark, sf)[1], "deviance", "null_deviance", "aic", digits=5)
    return fit.withColumn("score_is_zero", F.col("max_score") < 1e-6).drop("max_score", "iterations")


_DISTANCE = "round(1 / (1 + exp(-(b0 + b1 * (age - 50) / 20.0 + b2 * (index_date - DATE '1995-06-01') / 365.0))), 9)"


@query(
    "matched_outcome",
    _outcome_sql("o_matched"),
    (
        *K.ALL_CTES, *_NEWTON, "pre_fit AS (SELECT p.*, b0, b1, b2 FROM pre p JOIN newton n ON n.k = 15)",
        *_greedy_ctes(_DISTANCE, "pre_fit"), _outcome_cte("o_matched", "matched", "ind_death", _B + _S),
    ),
)
def matched_outcome(spark, sf):
    """Subject chain, propensity score, pairing and outcome table in one go. Scores are compared to nine digits."""
    pre = checkpointed(H.cohort(K.base(spark, sf), CFG))
    scored = propensity(pre.withColumn("index_day", F.unix_date("index_date")), "arm", ["age", "index_day"])
    study = match_nearest(_rounded(scored, "distance", digits=9), "arm", "distance", list(CFG.exact_keys), "subject_id")
    return _outcome(checkpointed(study), ALL_GROUPINGS, "ind_death")


# curves


def _km_sql(frame: str, by: str) -> str:
    part = f"PARTITION BY {by}"
    return f"""SELECT {by}, time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, CAST(m - d AS BIGINT) AS n_censor,
      round(surv, 8) AS surv, round(std_err, 8) AS std_err, round(surv * exp(-1.959963984540054 * std_err), 8) AS lower,
      round(CASE WHEN std_err IS NOT NULL THEN least(1.0, surv * exp(1.959963984540054 * std_err)) ELSE 1.0 END, 8) AS upper
    FROM (SELECT *, CASE WHEN done THEN 0.0 ELSE exp(SUM(CASE WHEN d < n THEN ln((n - d) / n) ELSE 0 END) OVER ({part} ORDER BY time)) END AS surv,
            CASE WHEN NOT done THEN sqrt(SUM(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0 END) OVER ({part} ORDER BY time)) END AS std_err
          FROM (SELECT *, MAX(CAST(d = n AS INTEGER)) OVER ({part} ORDER BY time) = 1 AS done
                FROM (SELECT {by}, time, m, d, SUM(m) OVER ({part} ORDER BY time DESC) AS n
                      FROM (SELECT {by}, time, COUNT(*) AS m, CAST(SUM(event) AS BIGINT) AS d FROM {frame} GROUP BY {by}, time) t) r) q) k"""


_KM = ("surv", "std_err", "lower", "upper")


@query("km_curve", _km_sql("deaths_c", "arm"), (_CENSORED,))
def km_curve_query(spark, sf):
    return _rounded(km_curve(_deaths(spark, sf), "days_index_to_death", "ind_death", ["arm"]), *_KM)


def _families(frame: str, name: str, status: bool) -> str:
    sets = [
        ("all", "'all'", "TRUE"),
        ("55+", "'all'", "age >= 55"),
        ("65+", "'all'", "age >= 65"),
        ("55-64", "'all'", "age BETWEEN 55 AND 64"),
        ("narrow band x sex", "'Age group: ' || age_group_narrow || ', ' || sex", "TRUE"),
        ("wide band x sex", "'Age group: ' || age_group || ', ' || sex", "TRUE"),
        ("narrow band", "'Age group: ' || age_group_narrow", "TRUE"),
        ("wide band", "'Age group: ' || age_group", "TRUE"),
    ]
    if status:
        sets += [("55+ by status", "first_state", "age >= 55"), ("55+ mild", "'all'", "age >= 55 AND first_state = 'mild'")]
    parts = [f"SELECT '{c}' AS curve, {f} AS facet, arm, time, event FROM {frame} WHERE {w}" for c, f, w in sets]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


_FAM_D, _FAM_H = _families("deaths_c", "fam_d", True), _families("stays_c", "fam_h", False)


def _death_table(spark, sf):
    return curve_table(_deaths(spark, sf), "days_index_to_death", "ind_death", 55, True)


def _stay_table(spark, sf):
    return curve_table(_stays(spark, sf), "days_index_to_stay", "ind_hospitalized", 55, False)


_BY = ["curve", "facet"]


@query("km_curve_by_group", _km_sql("fam_d", "curve, facet, arm"), (_CENSORED, _FAM_D))
def km_curve_by_group(spark, sf):
    return _rounded(km_from_table(_death_table(spark, sf), [*_BY, "arm"]), *_KM)


@query("km_curve_hosp", _km_sql("fam_h", "curve, facet, arm"), (_HOSP, _CENSORED_H, _FAM_H))
def km_curve_hosp(spark, sf):
    return _rounded(km_from_table(_stay_table(spark, sf), [*_BY, "arm"]), *_KM)


def _risk_sql(frame: str, by: str, step: int, upto: int) -> str:
    return f"""SELECT {by}, CAST(at_day AS INTEGER) AS at, COUNT(*) FILTER (WHERE time >= at_day) AS n_risk
      FROM {frame}, (SELECT unnest(range(0, {upto + 1}, {step})) AS at_day) g GROUP BY {by}, at_day"""


@query("at_risk_table", _risk_sql("fam_d", "curve, facet, arm", 10, DEATH_LIMIT), (_CENSORED, _FAM_D))
def at_risk_table(spark, sf):
    return at_risk(_death_table(spark, sf), [*_BY, "arm"], 10, DEATH_LIMIT)


@query(
    "at_risk_hosp",
    _risk_sql("stays_c", "arm", 5, STAY_LIMIT - STAY_ORIGIN),
    (_HOSP, _CENSORED_H),
)
def at_risk_hosp(spark, sf):
    table = event_table(_stays(spark, sf), "days_index_to_stay", "ind_hospitalized", ["arm"])
    return at_risk(table, ["arm"], 5, STAY_LIMIT - STAY_ORIGIN)


def _logrank_cte(frame: str) -> str:
    return f"""lr AS (
  SELECT curve, facet, CAST(SUM(d1) AS BIGINT) AS observed, SUM((d1 + d0) * n1 / n) AS expected,
         SUM(CASE WHEN n > 1 THEN (d1 + d0) * (n1 / n) * (1 - n1 / n) * (n - d1 - d0) / (n - 1) ELSE 0 END) AS variance
  FROM (SELECT *, SUM(m1) OVER (PARTITION BY curve, facet ORDER BY time DESC) AS n1,
               SUM(m1 + m0) OVER (PARTITION BY curve, facet ORDER BY time DESC) AS n
        FROM (SELECT curve, facet, time, COUNT(*) FILTER (WHERE arm = '1') AS m1, COUNT(*) FILTER (WHERE arm = '0') AS m0,
                COUNT(*) FILTER (WHERE arm = '1' AND event = 1) AS d1, COUNT(*) FILTER (WHERE arm = '0' AND event = 1) AS d0
              FROM {frame} GROUP BY curve, facet, time) a) b
  WHERE d1 + d0 > 0 GROUP BY curve, facet)"""


_CHISQ = "(observed - expected) * (observed - expected) / NULLIF(variance, 0)"


@query(
    "logrank_stat",
    f"SELECT curve, facet, observed, round(expected, 8) AS expected, round(variance, 8) AS variance, round({_CHISQ}, 8) AS chisq FROM lr",
    (_CENSORED, _FAM_D, _logrank_cte("fam_d")),
)
def logrank_stat(spark, sf):
    return _rounded(logrank_from_table(_death_table(spark, sf), _BY, "arm"), "expected", "variance", "chisq")


@query(
    "logrank_p",
    f"SELECT curve, facet, {_TAIL.format(x='x')} AS p FROM (SELECT *, {_CHISQ} AS x FROM lr) l",
    (_HOSP, _CENSORED_H, _FAM_H, _logrank_cte("fam_h")),
)
def logrank_p(spark, sf):
    out = with_logrank_p(logrank_from_table(_stay_table(spark, sf), _BY, "arm"))
    return _rounded(out, "p").select(*_BY, "p")


# count models

_Y, _FACTORS = "duration_hospitalization", ["arm", "age_group", "sex"]
_WIDE = [*_FACTORS, "ind_death", "first_state"]


def _cells(spark, sf):
    return model_cells(V.study(spark, sf), _Y, _FACTORS)


_CELLS = """cells AS (SELECT arm, age_group, sex, CAST(duration_hospitalization AS DOUBLE) AS y, COUNT(*) AS n FROM study
  WHERE duration_hospitalization IS NOT NULL AND ind_death <> '1' GROUP BY ALL)"""


@query("model_cells", "SELECT * FROM cells", (_CELLS,))
def model_cells_query(spark, sf):
    return _cells(spark, sf)


def _glm_ctes(name: str, cells: str, factors: list[str], negbin: bool) -> tuple:
    """A main-effects model as SQL. The effects of one factor after the other are moved by Newton steps, theta along with them; the
    covariances are the inverse of the information matrix, by elimination."""
    m, every = len(factors), ", ".join(factors)
    damp = "(1 + exp(r) / th)" if negbin else "1"
    by = "CASE k % {m} " + " ".join(f"WHEN {i} THEN {{f{i}}}" for i in range(m)) + " END"
    part = by.format(m=m, **{f"f{i}": f for i, f in enumerate(factors)})
    moved = f"SUM((y - n * exp(r)) / {damp}) OVER w / SUM(n * exp(r) / {damp}) OVER w"
    theta = (
        """greatest(th / 4, least(th * 4, th + CASE WHEN info > 0 THEN score / info ELSE sign(score) * th / 2 END))"""
        if negbin
        else "th"
    )
    effects = ", ".join(f"e{i} + CASE WHEN k % {m} = {i} THEN d ELSE 0 END AS e{i}" for i in range(m))
    start, names = ", ".join(f"CAST(0 AS DOUBLE) AS e{i}" for i in range(m)), ", ".join(f"e{i}" for i in range(m))
    has = " UNION ALL ".join(
        [f"SELECT id, 1 AS t FROM {name}_end"]
        + [f"SELECT id, l.t FROM {name}_end e JOIN {name}_terms l ON l.i = {i} AND l.v = e.{f}" for i, f in enumerate(factors)]
    )
    effect = " UNION ALL ".join(f"SELECT {i} AS i, {f} AS v, MIN(e{i}) AS e, MIN(r0) AS r0 FROM {name}_end GROUP BY {f}" for i, f in enumerate(factors))
    levels = " UNION ALL ".join(f"SELECT DISTINCT {i} AS i, '{f}' AS f, {f} AS v FROM {cells}" for i, f in enumerate(factors))
    return (
        f"""{name}_p AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY {every}) AS id, * FROM (
          SELECT {every}, CAST(SUM(n) AS DOUBLE) AS n, SUM(n * y) AS y FROM {cells} GROUP BY {every}) q)""",
        f"""{name}_h AS MATERIALIZED (SELECT list(c ORDER BY j) AS cs FROM (SELECT j, CAST(SUM(n) AS DOUBLE) AS c
          FROM (SELECT n, unnest(range(0, CAST(y AS BIGINT))) AS j FROM {cells} WHERE y > 0) u GROUP BY j) v)""",
        f"""{name}_it AS (
          SELECT 0 AS k, id, {every}, n, y, ln(SUM(y) OVER () / SUM(n) OVER ()) AS r0, ln(SUM(y) OVER () / SUM(n) OVER ()) AS r, CAST(1 AS DOUBLE) AS th, {start}
          FROM {name}_p
          UNION ALL
          SELECT k + 1, id, {every}, n, y, r0, r + d, {theta}, {effects}
          FROM (SELECT i.*, {moved} AS d,
                  SUM(n * (ln(th) + 1 - ln(th + exp(r))) - (y + n * th) / (th + exp(r))) OVER ()
                    + list_sum(list_transform(cs, lambda c, j: c / (th + j - 1))) AS score,
                  SUM(2 * n / (th + exp(r)) - n / th - (y + n * th) / ((th + exp(r)) * (th + exp(r)))) OVER ()
                    + list_sum(list_transform(cs, lambda c, j: c / ((th + j - 1) * (th + j - 1)))) AS info
                FROM {name}_it i, {name}_h WHERE k < {100 * m} WINDOW w AS (PARTITION BY {part})) x)""",
        f"{name}_end AS MATERIALIZED (SELECT id, {every}, n, y, r0, r, exp(r) AS mu, th, n * exp(r) / {damp} AS w, {names} FROM {name}_it WHERE k = {100 * m})",
        f"""{name}_levels AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY v) AS place FROM ({levels}) l)""",
        f"""{name}_terms AS MATERIALIZED (SELECT *, 1 + ROW_NUMBER() OVER (ORDER BY i, v) AS t FROM {name}_levels WHERE place > 1)""",
        f"""{name}_est AS (SELECT e.*, f, place FROM ({effect}) e JOIN {name}_levels l ON l.i = e.i AND l.v = e.v)""",
        f"""{name}_has AS ({has})""",
        f"""{name}_rows AS (SELECT a.t AS i, list(COALESCE(g, 0) ORDER BY b.t) || list(CASE WHEN a.t = b.t THEN 1.0 ELSE 0.0 END ORDER BY b.t) AS row, COUNT(*) AS p
          FROM (SELECT DISTINCT t FROM {name}_has) a CROSS JOIN (SELECT DISTINCT t FROM {name}_has) b
          LEFT JOIN (SELECT x.t AS t, z.t AS u, SUM(w) AS g FROM {name}_has x JOIN {name}_has z ON z.id = x.id JOIN {name}_end e ON e.id = x.id GROUP BY x.t, z.t) s
            ON s.t = a.t AND s.u = b.t GROUP BY a.t)""",
        f"""{name}_gj AS (
          SELECT 0 AS k, i, row, p FROM {name}_rows
          UNION ALL
          SELECT k + 1, i, CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[CAST(k + 1 AS BIGINT)])
                             ELSE list_transform(row, lambda v, c: v - row[CAST(k + 1 AS BIGINT)] * lead_row[c] / lead_row[CAST(k + 1 AS BIGINT)]) END, p
          FROM (SELECT *, max(CASE WHEN i = k + 1 THEN row END) OVER () AS lead_row FROM {name}_gj WHERE k < p) x)""",
        f"""{name}_coef AS (
          SELECT term, estimate, sqrt(row[CAST(p + i AS BIGINT)]) AS std_error FROM (
            SELECT 1 AS t, '(Intercept)' AS term, MIN(r0) + SUM(e) AS estimate FROM {name}_est WHERE place = 1
            UNION ALL
            SELECT o.t, o.f || '=' || o.v, x.e - b.e FROM {name}_terms o JOIN {name}_est x ON x.i = o.i AND x.v = o.v JOIN {name}_est b ON b.i = o.i AND b.place = 1) c
          JOIN {name}_gj g ON g.k = g.p AND g.i = c.t)""",
    )


_PA = _glm_ctes("pa", "cells", _FACTORS, False)


@query("poisson_additive", _coef_sql("pa_coef"), (_CELLS, *_PA))
def poisson_additive(spark, sf):
    return _coefficients(fit_poisson(_cells(spark, sf), _FACTORS))


@query(
    "poisson_fit",
    """SELECT CAST(SUM(c.n) AS BIGINT) AS n_rows, CAST(SUM(c.n) AS BIGINT) - MAX(p) AS df_residual,
         round(2 * SUM(c.n * (CASE WHEN c.y > 0 THEN c.y * (ln(c.y) - r) ELSE 0 END - (c.y - mu))), 5) AS deviance,
         round(2 * SUM(c.n * (CASE WHEN c.y > 0 THEN c.y * (ln(c.y) - r0) ELSE 0 END - (c.y - exp(r0)))), 5) AS null_deviance,
         CAST(SUM(c.n) AS BIGINT) - 1 AS df_null, round(2 * MAX(p) - 2 * SUM(c.n * (c.y * r - mu - lgamma(c.y + 1))), 5) AS aic
       FROM cells c JOIN pa_end q ON q.arm = c.arm AND q.age_group = c.age_group AND q.sex = c.sex
       CROSS JOIN (SELECT COUNT(*) AS p FROM pa_coef) z""",
    (_CELLS, *_PA),
)
def poisson_fit(spark, sf):
    fit = fit_poisson(_cells(spark, sf), _FACTORS)[1].where("converged")
    return _rounded(fit, "deviance", "null_deviance", "aic", digits=5).drop("iterations", "converged")


def _saturated_sql(variance: str) -> str:
    """With all interactions the fitted means are the cell means, so the estimates are signed sums of their logs, whatever the dispersion."""
    levels = {"arm": ("0", "1"), "age_group": ("12-54", "55-64", "65+"), "sex": ("female", "male")}
    parts = []
    for a in levels["arm"]:
        for b in levels["age_group"]:
            for s in levels["sex"]:
                chosen = [(f, v) for f, v in (("arm", a), ("age_group", b), ("sex", s)) if v != levels[f][0]]
                name = ":".join(f"{f}={v}" for f, v in chosen) or "(Intercept)"
                est, var = [], []
                for mask in range(2 ** len(chosen)):
                    point = {f: levels[f][0] for f in levels}
                    for i, (f, v) in enumerate(chosen):
                        if mask >> i & 1:
                            point[f] = v
                    sign = "+" if (len(chosen) - bin(mask).count("1")) % 2 == 0 else "-"
                    where = " AND ".join(f"{f} = '{v}'" for f, v in point.items())
                    est.append(f"{sign} (SELECT ln(SUM(n * y) / SUM(n)) FROM cells WHERE {where})")
                    var.append(f"+ (SELECT {variance} FROM cells WHERE {where})")
                parts.append(f"SELECT '{name}' AS term, {' '.join(est)} AS estimate, sqrt({' '.join(var)}) AS std_error")
    return _coef_sql("(" + " UNION ALL ".join(parts) + ")")


@query("poisson_interaction", _saturated_sql("1 / SUM(n * y)"), (_CELLS,))
def poisson_interaction(spark, sf):
    return _coefficients(fit_poisson(_cells(spark, sf), _FACTORS, interactions=True))


_CELLS_WIDE = """cells_w AS (SELECT arm, age_group, sex, ind_death, first_state, CAST(duration_hospitalization AS DOUBLE) AS y, COUNT(*) AS n FROM study
  WHERE duration_hospitalization IS NOT NULL GROUP BY ALL)"""
_NA, _NW = _glm_ctes("na", "cells", _FACTORS, True), _glm_ctes("nw", "cells_w", _WIDE, True)
# with all interactions only theta is searched: the means are the cell means
_NI = (
    """ni_p AS MATERIALIZED (SELECT arm, age_group, sex, CAST(SUM(n) AS DOUBLE) AS n, SUM(n * y) AS y, SUM(n * y) / SUM(n) AS mu FROM cells GROUP BY arm, age_group, sex)""",
    """ni_it AS (
         SELECT 0 AS k, CAST(1 AS DOUBLE) AS th
         UNION ALL
         SELECT k + 1, greatest(th / 4, least(th * 4, th + CASE WHEN info > 0 THEN score / info ELSE sign(score) * th / 2 END))
         FROM (SELECT k, th, SUM(n * (ln(th) + 1 - ln(th + mu)) - (y + n * th) / (th + mu)) + MAX(list_sum(list_transform(cs, lambda c, j: c / (th + j - 1)))) AS score,
                 SUM(2 * n / (th + mu) - n / th - (y + n * th) / ((th + mu) * (th + mu)))
                   + MAX(list_sum(list_transform(cs, lambda c, j: c / ((th + j - 1) * (th + j - 1))))) AS info
               FROM ni_it, ni_p, na_h WHERE k < 100 GROUP BY k, th) x)""",
    """ni_end AS MATERIALIZED (SELECT p.*, ln(mu) AS r, ln(SUM(y) OVER () / SUM(n) OVER ()) AS r0, th FROM ni_p p, ni_it WHERE k = 100)""",
)


@query("negbin_additive", _coef_sql("na_coef"), (_CELLS, *_NA))
def negbin_additive(spark, sf):
    return _coefficients(fit_negbin(_cells(spark, sf), _FACTORS))


@query(
    "negbin_interaction",
    _saturated_sql("1 / SUM(n * y) + 1 / (SUM(n) * (SELECT MAX(th) FROM ni_end))"),
    (_CELLS, _NA[1], *_NI),
)
def negbin_interaction(spark, sf):
    return _coefficients(fit_negbin(_cells(spark, sf), _FACTORS, interactions=True))


@query("negbin_adjusted", _coef_sql("nw_coef"), (_CELLS_WIDE, *_NW))
def negbin_adjusted(spark, sf):
    cells = model_cells(V.study(spark, sf), _Y, _WIDE, exclude_dead=False)
    return _coefficients(fit_negbin(cells, _WIDE))


def _negbin_fit_sql(model: str, cells: str, ends: str, factors: list[str], terms: str) -> str:
    """The fit from the counts themselves, by the gamma function and its series."""
    on = " AND ".join(f"e.{f} = c.{f}" for f in factors)
    deviance = "2 * SUM(c.n * (CASE WHEN c.y > 0 THEN c.y * (ln(c.y) - {r}) ELSE 0 END - (c.y + th) * (ln(c.y + th) - ln(exp({r}) + th))))"
    return f"""SELECT '{model}' AS model, n_rows, n_rows - p AS df_residual, round(th, 5) AS theta,
        round(1 / sqrt(series + info), 5) AS theta_se, round(2 * loglik, 4) AS twologlik, round(dev, 4) AS deviance, round(null_dev, 4) AS null_deviance,
        n_rows - 1 AS df_null, round(2 * (p + 1) - 2 * loglik, 4) AS aic
      FROM (SELECT CAST(SUM(c.n) AS BIGINT) AS n_rows, MAX(th) AS th, {deviance.format(r="r")} AS dev, {deviance.format(r="r0")} AS null_dev,
              SUM(c.n * (lgamma(th + c.y) - lgamma(th) - lgamma(c.y + 1) + th * ln(th) + c.y * r - (th + c.y) * ln(th + mu))) AS loglik,
              SUM(c.n * (2 / (th + mu) - 1 / th - (c.y + th) / ((th + mu) * (th + mu)))) AS info,
              SUM(c.n * COALESCE(list_sum(list_transform(range(0, CAST(c.y AS BIGINT)), lambda j: 1 / ((th + j) * (th + j)))), 0)) AS series
            FROM {cells} c JOIN {ends} e ON {on}) f CROSS JOIN (SELECT {terms} AS p) t"""


@query(
    "negbin_fit",
    " UNION ALL ".join(
        [
            _negbin_fit_sql("additive", "cells", "na_end", _FACTORS, "(SELECT COUNT(*) FROM na_coef)"),
            _negbin_fit_sql("interaction", "cells", "ni_end", _FACTORS, "(SELECT COUNT(*) FROM ni_end)"),
            _negbin_fit_sql("adjusted", "cells_w", "nw_end", _WIDE, "(SELECT COUNT(*) FROM nw_coef)"),
        ]
    ),
    (_CELLS, _CELLS_WIDE, *_NA, *_NI, *_NW),
)
def negbin_fit(spark, sf):
    """The fit rows of the three negative binomial models that converged."""
    wide = model_cells(V.study(spark, sf), _Y, _WIDE, exclude_dead=False)
    fits = [fit_negbin(_cells(spark, sf), _FACTORS), fit_negbin(_cells(spark, sf), _FACTORS, interactions=True), fit_negbin(wide, _WIDE)]
    rows = [f.where("converged").withColumn("model", F.lit(m)) for m, (_, f) in zip(("additive", "interaction", "adjusted"), fits)]
    out = _rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), "theta", "theta_se", digits=5)
    return _rounded(out, "twologlik", "deviance", "null_deviance", "aic", digits=4).drop("iterations", "converged")


# report tables


def _suppress_sql(n: str, total: str) -> str:
    small = lambda c: f"CASE WHEN {c} > 0 AND {c} < 5 THEN '<5' ELSE CAST({c} AS VARCHAR) END"
    return (
        f"CASE WHEN {n} > 0 AND {n} < 5 AND {total} >= 5 THEN concat('<5/', {total}, '(<', printf('%.2f', 100 * 5 / {total}), '%)') "
        f"ELSE concat({small(n)}, '/', {small(total)}, '(', CASE WHEN {total} = 0 THEN 'NaN' ELSE printf('%.2f', 100 * ({n} / {total})) END, '%)') END"
    )


@query(
    "suppress_small",
    f"""SELECT age_group_narrow, sex, {_suppress_sql('case_event_n', 'case_n')} AS "case",
        {_suppress_sql('control_event_n', 'control_n')} AS control FROM g""",
    (_GROUPS,),
)
def suppress_small(spark, sf):
    rows = R.suppress_small(_groups(spark, sf), "case_event_n", "case_n", "case")
    return R.suppress_small(rows, "control_event_n", "control_n", "control").select("age_group_narrow", "sex", "case", "control")


# subjects by band, sex and state: small groups, some without an event or without an event-free subject in an arm
_FINE = """fine AS (SELECT ROW_NUMBER() OVER (ORDER BY age_group_narrow, sex, first_state) AS id, * FROM (
  SELECT age_group_narrow, sex, first_state, COUNT(*) FILTER (WHERE arm = '1') AS case_n, COUNT(*) FILTER (WHERE arm = '0') AS control_n,
    COUNT(*) FILTER (WHERE arm = '1' AND ind_death = '1') AS case_event_n, COUNT(*) FILTER (WHERE arm = '0' AND ind_death = '1') AS control_event_n
  FROM study GROUP BY age_group_narrow, sex, first_state) q)"""
_FINE_KEYS = ["age_group_narrow", "sex", "first_state"]


def _fine(spark, sf):
    return conditional_counts(V.study(spark, sf), _FINE_KEYS, "arm", F.col("ind_death") == "1")


@query(
    "format_odds",
    f"SELECT age_group_narrow, sex, first_state, {_ODDS_TEXT} AS odds_ratio FROM fine JOIN f_ci ON f_ci.id = fine.id",
    (_FINE, *_fisher_ctes("f", "fine")),
)
def format_odds(spark, sf):
    """Odds ratios of Fisher's test on small groups: 0 and Inf occur."""
    rows = _fine(spark, sf).withColumns({"a": F.col("control_n") - F.col("control_event_n"), "c": F.col("case_n") - F.col("case_event_n")})
    return R.format_odds(fisher_exact(rows, "a", "control_event_n", "c", "case_event_n")).select(*_FINE_KEYS, "odds_ratio")


_FINE_PAIRS = """fine_pairs AS (SELECT a.age_group_narrow, a.sex, a.first_state, COUNT(*) FILTER (WHERE a.ind_death = '1' AND b.ind_death = '0') AS case_only,
  COUNT(*) FILTER (WHERE a.ind_death = '0' AND b.ind_death = '1') AS control_only
  FROM study a JOIN study b ON a.subclass = b.subclass AND a.arm = '1' AND b.arm = '0' GROUP BY ALL)"""


@query(
    "format_p",
    f"""SELECT 'hospitalized' AS test, age_group, sex, first_state, {_p_text('fisher_p')} AS p_text FROM (SELECT *, {_FISHER} AS fisher_p FROM o_hosp) h
        UNION ALL SELECT 'death in pairs', age_group_narrow, sex, first_state, {_p_text('mcnemar_p')}
        FROM (SELECT *, {_TAIL.format(x='s')} AS mcnemar_p FROM (SELECT *, {_MCNEMAR} AS s FROM fine_pairs) m) t""",
    (_HOSP, _outcome_cte("o_hosp", "hosp", "ind_hospitalized", _B), _FINE_PAIRS),
)
def format_p(spark, sf):
    """P values of both tests: below 0.001 among the groups of the outcome table, NaN where no pair differs."""
    hosp = outcome_summary(H.complete_pairs_cohort(V.study(spark, sf)), BASIC_GROUPINGS, "ind_hospitalized")
    wide = pair_wide(V.study(spark, sf), "subclass", "arm", ["ind_death", *_FINE_KEYS])
    only = lambda a, b: F.count_if((F.col(f"ind_death_{a}") == "1") & (F.col(f"ind_death_{b}") == "0"))
    pairs = wide.groupBy(F.col("age_group_narrow_case").alias("age_group"), F.col("sex_case").alias("sex"), F.col("first_state_case").alias("first_state"))
    pairs = mcnemar(pairs.agg(only("case", "control").alias("case_only"), only("control", "case").alias("control_only")), "case_only", "control_only")
    rows = [
        R.format_p(df, p, "p_text").select(F.lit(test).alias("test"), "age_group", "sex", "first_state", "p_text")
        for test, df, p in (("hospitalized", hosp, "fisher_p"), ("death in pairs", pairs, "mcnemar_p"))
    ]
    return rows[0].unionByName(rows[1])


def _params_sql() -> str:
    lit = [
        ("Study start", CFG.study_start),
        ("Study end", CFG.study_end),
        ("Study maximum positive pcr to hospitalization", CFG.max_days_to_stay),
        ("Study minimum positive pcr to hospitalization", CFG.min_days_to_stay),
        ("Study maximum positive pcr to death", CFG.max_days_to_death),
        ("Study minimum days to death", CFG.min_days_to_death),
        ("Study minimum age", CFG.min_age),
    ]
    parts = [f"SELECT '{d}' AS description, '{v}' AS value" for d, v in lit]
    count = lambda d, e: parts.append(f"SELECT '{d}', CAST({e} AS VARCHAR)")
    rows = lambda v: f"(SELECT COUNT(*) FROM {v})"
    uniq = lambda v: f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {v}) u)"
    count("Rows in master source", rows("subject_rows"))
    count("Rows in master without duplicate complete rows", uniq("subject_rows"))
    count("Rows in master with complete non-confilicted cases", "(SELECT COUNT(*) FROM tagged_master WHERE err = '''')".replace("''''", "''"))
    count("Duplicated conplete rows rmoved from master", f"{rows('subject_rows')} - {uniq('subject_rows')}")
    count("Duplicated conplete rows rmoved from hospitalizations", f"{rows('stays')} - {uniq('stays')}")
    count("Duplicated conplete rows rmoved from monitoring", f"{rows('updates')} - {uniq('updates')}")
    count("Duplicated conplete rows rmoved from quarantine", f"{rows('isolation')} - {uniq('isolation')}")
    count(
        "Duplicated patient id with additional first_positive_result_test_date in master",
        "(SELECT COUNT(*) FROM (SELECT DISTINCT subject_id, index_date FROM tagged_master) u)"
        " - (SELECT COUNT(*) FROM (SELECT DISTINCT subject_id FROM tagged_master) u)",
    )
    for frame, name in (("tagged_master", "master"), ("tagged_stays", "hospitalizations")):
        parts.append(f"SELECT 'Error in {name} combined: ' || err, CAST(COUNT(*) AS VARCHAR) FROM {frame} WHERE err <> '' GROUP BY err")
        parts.append(f"SELECT 'Error in {name} combined total', CAST(COUNT(*) AS VARCHAR) FROM {frame} WHERE err <> ''")
        parts.append(
            f"SELECT 'Error in {name} separate: ' || tag, CAST(COUNT(*) AS VARCHAR) FROM (SELECT unnest(string_split(err, ' ')) AS tag "
            f"FROM {frame}) t WHERE tag <> '' GROUP BY tag"
        )
    return " UNION ALL ".join(parts)


_ISOLATION = "isolation AS (SELECT event_type AS fever, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS isolation_day_key FROM events)"


@query("params_table", _params_sql(), (*K.TAGS, _ISOLATION))
def params_table(spark, sf):
    master, stays, _ = K.tagged(spark, sf, keep=True)
    events = V.table(spark, sf, "events").select(
        F.col("event_type").alias("new_fever"), F.date_format("ts", "yyyyMMdd").cast("int").alias("isolationstartdaykey")
    )
    sources = {
        "master": V.subject_rows(spark, sf),
        "hospitalizations": V.stays(spark, sf),
        "monitoring": V.updates(spark, sf),
        "quarantine": renamed(events, {"new_fever": "fever", "isolationstartdaykey": "isolation_day_key"}),
    }
    return R.params_table(CFG, sources, master, stays)


def _demographic_sql() -> str:
    pct = lambda n, d: f"concat({n}, '(', printf('%.2f', {n} / {d} * 100), '%)')"
    arm = lambda a: f"COUNT(*) FILTER (WHERE arm = '{a}')"
    parts = []
    for lo, hi in (("1995-04-01", "1995-12-31"), ("1996-01-01", "2000-12-31"), ("1995-04-01", "2000-12-31")):
        parts.append(
            f"SELECT 'Complete non-confilicted cases aged 12+ during {lo} - {hi}' AS description, CAST(COUNT(*) AS VARCHAR) AS general, "
            f"{pct(arm(1), 'COUNT(*)')} AS \"case\", {pct(arm(0), 'COUNT(*)')} AS control FROM base "
            f"WHERE index_date BETWEEN DATE '{lo}' AND DATE '{hi}' AND age >= 12"
        )
    parts.append(
        f"SELECT 'In the study group brfore match', CAST(COUNT(*) AS VARCHAR), {pct(arm(1), 'COUNT(*)')}, {pct(arm(0), 'COUNT(*)')} FROM pre"
    )
    pre = lambda a: f"(SELECT COUNT(*) FROM pre WHERE arm = '{a}')"
    parts.append(
        "SELECT 'In the study group after match (% of the same group before match)', CAST(COUNT(*) AS VARCHAR), "
        f"{pct(arm(1), pre(1))}, {pct(arm(0), pre(0))} FROM study"
    )
    q = lambda w: (
        f"(SELECT concat(CASE WHEN m = floor(m) THEN printf('%.0f', m) ELSE printf('%.1f', m) END, '(', printf('%.2f', a), '-', printf('%.2f', b), ')') "
        f"FROM (SELECT median(CAST(age AS DOUBLE)) AS m, quantile_cont(CAST(age AS DOUBLE), 0.25) AS a, quantile_cont(CAST(age AS DOUBLE), 0.75) AS b "
        f"FROM study WHERE {w}) s)"
    )
    parts.append(
        "SELECT 'Study median age(lower quartile - upper quartile)', " + ", ".join(q(w) for w in ("TRUE", "arm = '1'", "arm = '0'"))
    )
    for key, prefix in (("age_group", "Study age group "), ("age_group_narrow", "Study age group "), ("sex", "Study sex ")):
        parts.append(
            f"SELECT concat('{prefix}', {key}), {pct('g', 'tg')}, {pct('c', 'tc')}, {pct('k', 'tk')} FROM (SELECT *, SUM(g) OVER () AS tg, "
            f"SUM(c) OVER () AS tc, SUM(k) OVER () AS tk FROM (SELECT {key}, COUNT(*) AS g, {arm(1)} AS c, {arm(0)} AS k FROM study GROUP BY {key}) a) b"
        )
    return " UNION ALL ".join(parts)


@query("demographic_table", _demographic_sql(), K.ALL_CTES)
def demographic_table(spark, sf):
    base = checkpointed(K.base(spark, sf).select(
        "index_date", "age", "arm", "age_group", "sex", "ind_death", "death_date", "during_prior", "first_state"
    ))
    return R.demographic_table(base, H.cohort(base, CFG), V.study(spark, sf), CFG)


def _export_sql(table: str, frame: str) -> str:
    n = lambda c: f"CAST({c} AS BIGINT)"
    return f"""SELECT '{table}' AS outcome, description, age_group, sex, first_state, {_suppress_sql(n("case_event_n"), n("case_n"))} AS "case",
        {_suppress_sql(n("control_event_n"), n("control_n"))} AS control, {_ODDS_TEXT} AS odds_ratio, {_p_text("fisher_p")} AS p_value,
        {_p_text("mcnemar_p")} AS mcnemar_p_value
      FROM (SELECT *, {_TAIL.format(x="mcnemar_stat")} AS mcnemar_p FROM (SELECT *, {_FISHER} AS fisher_p, {_MCNEMAR} AS mcnemar_stat FROM {frame}) a) o
      JOIN {frame}_ci c ON c.id = o.id"""


def _numbered(frame: str) -> str:
    return f"{frame} AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY {_KEYS}, case_n, control_n) AS id, * FROM {frame[:-1]})"


@query(
    "outcome_export",
    f"{_export_sql('death', 'o_deathx')} UNION ALL {_export_sql('hosp', 'o_hospx')}",
    (
        _HOSP, _outcome_cte("o_death", "study", "ind_death", _B + _S), _outcome_cte("o_hosp", "hosp", "ind_hospitalized", _B),
        _numbered("o_deathx"), _numbered("o_hospx"), *_fisher_ctes("o_deathx", "o_deathx"), *_fisher_ctes("o_hospx", "o_hospx"),
    ),
)
def outcome_export(spark, sf):
    """The outcome tables of both outcomes as text, small cells hidden."""
    study = V.study(spark, sf)
    counts = {"death": outcome_counts(study, ALL_GROUPINGS, "ind_death"), "hosp": outcome_counts(H.complete_pairs_cohort(study), BASIC_GROUPINGS, "ind_hospitalized")}
    tables = [R.export_outcome(with_tests(c), CFG.min_cell).select(F.lit(name).alias("outcome"), "*") for name, c in counts.items()]
    return tables[0].unionByName(tables[1])
