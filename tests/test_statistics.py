import math
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.functions.tails import chi2_tail, fisher_one
from pairwell.operators.aggregate import quantiles_by
from pairwell.operators.cohort import censor_at
from pairwell.operators.inference import mcnemar
from pairwell.operators.models import fit_negbin, fit_poisson, model_cells
from pairwell.operators.survival import at_risk, event_table, km_curve, logrank

TREATED = "6+,6,6,6,7,9+,10,10+,11+,13,16,17+,19+,20+,22,23,25+,32+,32+,34+,35+".split(",")
CONTROL = [1, 1, 2, 2, 3, 4, 4, 5, 5, 8, 8, 8, 8, 11, 11, 12, 12, 15, 17, 22, 23]


@pytest.fixture(scope="module")
def remission(spark):
    rows = [("1", int(x.rstrip("+")), 0 if x.endswith("+") else 1, "g") for x in TREATED]
    rows += [("0", t, 1, "g") for t in CONTROL]
    return spark.createDataFrame(rows, "arm string, t int, e int, g string").cache()


def brute_p(a, b, c, d):
    m, n, k = a + c, b + d, a + b
    prob = {x: comb(m, x) * comb(n, k - x) for x in range(max(0, k - n), min(k, m) + 1)}
    return sum(v for v in prob.values() if v <= prob[a] * (1 + 1e-7)) / sum(prob.values())


@pytest.mark.parametrize("table", [(3, 1, 1, 3), (2, 10, 15, 3), (0, 5, 5, 0), (7, 7, 7, 7), (40, 3, 25, 60)])
def test_fisher_p_against_enumeration(table):
    assert fisher_one(*table)[0] == pytest.approx(brute_p(*table), rel=1e-10)


def test_fisher_published_values():
    p, odds, lo, hi = fisher_one(3, 1, 1, 3)
    assert p == pytest.approx(0.4857143, abs=1e-7) and odds == pytest.approx(6.40832, rel=1e-5)
    assert lo == pytest.approx(0.211736, rel=1e-4) and hi == pytest.approx(626.24, rel=1e-3)
    p, odds, lo, hi = fisher_one(5, 0, 3, 4)
    assert odds == math.inf and hi == math.inf and lo == pytest.approx(0.572697, rel=1e-5)
    assert fisher_one(0, 0, 3, 4) == (1.0, 0.0, 0.0, math.inf)
    assert fisher_one(2, 10, 15, 3)[0] == pytest.approx(0.000536724, rel=1e-5)


def test_fisher_on_very_large_counts_matches_the_normal_limit():
    a, b, c, d = 50_000_000, 30_000_000, 50_010_000, 30_000_000
    p, odds, lo, hi = fisher_one(a, b, c, d)
    sample = a * d / (b * c)
    se = math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    assert odds == pytest.approx(sample, rel=1e-6)
    assert lo == pytest.approx(sample * math.exp(-1.96 * se), rel=1e-5)
    z = math.log(sample) / se
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-2)


def test_mcnemar(spark):
    df = spark.createDataFrame([(86, 150), (0, 0), (4, 4)], "b long, c long")
    rows = mcnemar(df, "b", "c").collect()
    assert rows[0]["mcnemar_stat"] == pytest.approx(16.81780, abs=1e-5)
    assert rows[0]["mcnemar_p"] == pytest.approx(4.11456e-05, rel=1e-5)
    assert math.isnan(rows[1]["mcnemar_stat"]) and math.isnan(rows[1]["mcnemar_p"])
    assert rows[2]["mcnemar_stat"] == 0 and rows[2]["mcnemar_p"] == 1


def test_tail_of_null_is_null(spark):
    df = spark.createDataFrame([(None,), (3.841458820694124,)], "x double")
    got = [r[0] for r in df.select(chi2_tail("x")).collect()]
    assert got[0] is None and got[1] == pytest.approx(0.05, abs=1e-12)


def test_kaplan_meier_published(remission):
    rows = {(r["arm"], r["time"]): r for r in km_curve(remission, "t", "e", ["arm"]).collect()}
    for t, s in ((6, 0.857143), (7, 0.806723), (10, 0.752941), (23, 0.448179)):
        assert rows[("1", t)]["surv"] == pytest.approx(s, abs=1e-6)
    assert rows[("1", 6)]["std_err"] == pytest.approx(0.0890871, abs=1e-7)
    assert rows[("1", 6)]["n_risk"] == 21 and rows[("1", 6)]["n_event"] == 3 and rows[("1", 6)]["n_censor"] == 1
    last = rows[("0", 23)]
    assert last["surv"] == 0 and last["std_err"] is None
    # without censoring the curve is one minus the share with an event so far
    for t in set(CONTROL):
        assert rows[("0", t)]["surv"] == pytest.approx(sum(x > t for x in CONTROL) / 21)


def test_logrank_published(remission):
    r = logrank(remission, "t", "e", "arm", ["g"]).first()
    assert r["observed"] == 9 and r["expected"] == pytest.approx(19.2505, abs=1e-4)
    assert r["variance"] == pytest.approx(6.25696, abs=1e-5) and r["chisq"] == pytest.approx(16.7929, abs=1e-4)
    assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["chisq"] / 2)), rel=1e-12)


def test_numbers_at_risk(remission):
    table = event_table(remission, "t", "e", ["arm"])
    got = {(r["arm"], r["at"]): r["n_risk"] for r in at_risk(table, ["arm"], 10, 40).collect()}
    assert got[("1", 0)] == 21 and got[("1", 10)] == 15 and got[("0", 10)] == 8 and got[("0", 40)] == 0


def test_censoring(spark):
    df = spark.createDataFrame([(5, "1"), (60, "1"), (61, "1"), (None, "0"), (None, "1")], "t int, e string")
    assert [tuple(r) for r in censor_at(df, "t", "e", 60).collect()] == [(5, 1), (60, 1), (60, 0), (60, 0), (60, 1)]
    assert [r["t"] for r in censor_at(df, "t", "e", 21, -2).collect()] == [7, 23, 23, 23, 23]


def test_quantiles(spark):
    df = spark.createDataFrame([("1", x) for x in (1, 2, 3, 10)] + [("0", 4)], "arm string, x int")
    got = {r["grp"]: (r["n"], r["q25"], r["q50"], r["q75"]) for r in quantiles_by(df, "x", "arm").collect()}
    assert got["1"] == (4, 1.75, 2.5, 4.75) and got["0"] == (1, 4, 4, 4) and got["all"][0] == 5


def test_sketches_of_parts_merge_within_the_stated_error(spark):
    from pairwell.operators.aggregate import merged_sketches, rank_error, sketched_quantiles, value_sketches

    df = spark.range(200_000, numPartitions=6).select(
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"), (F.col("id") % 2).alias("arm"), (F.col("id") % 17).alias("day")
    )
    parts = value_sketches(df.union(spark.sql("SELECT CAST(NULL AS DOUBLE), 0L, 0L")), "v", ["arm", "day"], k=200)
    assert parts.count() == 34 and parts.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    values = {a: sorted(r["v"] for r in df.where(F.col("arm") == a).select("v").collect()) for a in (0, 1)}
    got = sketched_quantiles(merged_sketches(parts, ["arm"]), ["arm"], probs).collect()
    assert len(got) == 2 * len(probs) and rank_error(200) < 0.0167
    for r in got:
        rank = sum(v <= r["value"] for v in values[r["arm"]]) / r["n"]
        assert r["n"] == 100_000 and abs(rank - r["prob"]) <= rank_error(200) + 1e-5


def test_complete_groups_count_no_keys_first(spark, monkeypatch):
    from pairwell import skew
    from pairwell.operators.groups import complete_groups

    monkeypatch.setattr(skew, "hot_keys", lambda *a: 1 / 0)
    df = spark.createDataFrame([(k, i) for k in range(6) for i in range(k)] + [(None, 1), (None, 2), (None, 3)], "g int, i int")
    assert sorted((r["g"], r["i"]) for r in complete_groups(df, "g", 3).collect()) == [(3, 0), (3, 1), (3, 2)]


def table(pair):
    return {r["term"]: r for r in pair[0].collect()}, pair[1].first()


def test_poisson_published(spark):
    y = [18, 17, 15, 20, 10, 20, 25, 13, 12]
    rows = [(str(i % 3 + 1), str(i // 3 + 1), float(v), 1) for i, v in enumerate(y)]
    cells = spark.createDataFrame(rows, "outcome string, treatment string, y double, n long")
    coef, fit = table(fit_poisson(cells, ["outcome", "treatment"]))
    assert coef["(Intercept)"]["estimate"] == pytest.approx(3.044522, abs=1e-6)
    assert coef["outcome=2"]["estimate"] == pytest.approx(-0.454255, abs=1e-6)
    assert coef["outcome=3"]["estimate"] == pytest.approx(-0.292987, abs=1e-6)
    assert coef["outcome=2"]["std_error"] == pytest.approx(0.2022, abs=1e-4)
    assert fit["deviance"] == pytest.approx(5.129141, abs=1e-5) and fit["null_deviance"] == pytest.approx(10.581446, abs=1e-5)
    assert fit["aic"] == pytest.approx(56.761318, abs=1e-5) and fit["n_rows"] == 9 and fit["df_residual"] == 4


def counts(spark, theta, seed=3, n=3000):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, s = int(rng.integers(2)), int(rng.integers(3))
        mu = math.exp(1.0 + 0.4 * a - 0.3 * s)
        lam = mu if theta is None else rng.gamma(theta, mu / theta)
        rows.append((str(a), str(s), float(rng.poisson(lam)), "0"))
    df = spark.createDataFrame(rows, "arm string, band string, y double, ind_death string")
    return model_cells(df, "y", ["arm", "band"]).cache()


def test_negative_binomial_score_is_zero_at_the_fit(spark):
    cells = counts(spark, 2.0)
    coef, fit = table(fit_negbin(cells, ["arm", "band"]))
    pdf = cells.toPandas()
    eta = coef["(Intercept)"]["estimate"] + sum(
        coef[t]["estimate"] * (pdf[f] == v) for t, f, v in (("arm=1", "arm", "1"), ("band=1", "band", "1"), ("band=2", "band", "2"))
    )
    y, n, mu, th = pdf["y"].to_numpy(), pdf["n"].to_numpy(), np.exp(eta).to_numpy(), fit["theta"]

    def loglik(m, t):
        return sum(
            w * (math.lgamma(t + v) - math.lgamma(t) - math.lgamma(v + 1) + t * math.log(t) + v * math.log(u) - (t + v) * math.log(t + u))
            for v, w, u in zip(y, n, m)
        )

    assert fit["twologlik"] == pytest.approx(2 * loglik(mu, th), rel=1e-10)
    h = 1e-4
    for shifted in (mu * math.exp(h), mu * math.exp(-h), np.where(pdf["arm"] == "1", mu * math.exp(h), mu)):
        assert loglik(shifted, th) < loglik(mu, th)
    for t in (th * (1 + h), th * (1 - h)):
        assert loglik(mu, t) < loglik(mu, th)
    assert fit["theta"] == pytest.approx(2.0, rel=0.15) and fit["theta_se"] > 0


def test_negative_binomial_tends_to_poisson(spark):
    cells = counts(spark, None)
    nb, fit = table(fit_negbin(cells, ["arm", "band"]))
    po, _ = table(fit_poisson(cells, ["arm", "band"]))
    assert fit["theta"] > 20
    for term in po:
        assert nb[term]["estimate"] == pytest.approx(po[term]["estimate"], abs=5e-3)


def test_empty_combinations_have_no_estimate(spark):
    rows = [("0", "a", 1.0, 2), ("0", "b", 2.0, 3), ("1", "a", 3.0, 4)]
    cells = spark.createDataFrame(rows, "arm string, band string, y double, n long")
    coef, fit = table(fit_poisson(cells, ["arm", "band"], interactions=True))
    assert set(coef) == {"(Intercept)", "arm=1", "band=b", "arm=1:band=b"} and fit["df_residual"] == 6
    assert [coef["arm=1:band=b"][c] for c in ("estimate", "std_error", "z", "p")] == [None] * 4
    assert coef["arm=1"]["estimate"] == pytest.approx(math.log(3), abs=1e-6)


def test_negative_binomial_of_a_level_without_any_day(spark):
    cells = spark.createDataFrame([("a", 0.0, 5), ("a", 3.0, 4), ("b", 0.0, 6), ("b", 0.0, 2)], "arm string, y double, n long")
    rows, fits = fit_negbin(cells, ["arm"])
    estimates, fit = {r["term"]: r["estimate"] for r in rows.collect()}, fits.first()
    assert estimates["(Intercept)"] == pytest.approx(np.log(12 / 9), abs=1e-6) and estimates["arm=b"] < -20
    assert fit["n_rows"] == 17 and fit["df_null"] == 16 and fit["null_deviance"] >= fit["deviance"]


def test_a_cached_frame_stays_cached(spark):
    cells = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 4), ("b", 2.0, 6), ("b", 5.0, 2)], "arm string, y double, n long").persist()
    _, fit = table(fit_poisson(cells, ["arm"]))
    assert cells.is_cached and fit["converged"] and fit["df_null"] == 16
    cells.unpersist()


@pytest.mark.parametrize("series", [10_000, 3])
def test_counts_above_j_equal_the_gamma_function(spark, monkeypatch, series):
    from pairwell.operators import models

    monkeypatch.setattr(models, "SERIES", series)
    rows = [(0.0, 5.0), (1.0, 3.0), (4.0, 2.0), (900.0, 1.0)]
    above = models._above(spark.createDataFrame(rows, "y double, n double"))
    if series == 3:
        assert {(r["j"], r["y"], r["c"]) for r in above.collect()} == {(0, None, 6.0), (1, None, 3.0), (2, None, 3.0), (None, 4.0, 2.0), (None, 900.0, 1.0)}
    for theta in (0.7, 30.0):
        got = models._sums(None, above.selectExpr(models._given(models._scalars({0: models._log_sum(), 1: models._power_sum(1), 2: models._power_sum(2)}), theta) + " AS s"))
        exact = [sum(n * math.log(theta + j) for y, n in rows for j in range(int(y)))] + [sum(n / (theta + j) ** k for y, n in rows for j in range(int(y))) for k in (1, 2)]
        assert [got[-1, k] for k in range(3)] == pytest.approx(exact, rel=1e-9 if series > 3 else 2e-4)


def test_terms_that_repeat_others_are_found(spark):
    rows = [(str(i % 2), "xy"[i % 2], "abc"[i % 3], float(i % 5), 1 + i % 4) for i in range(60)]
    cells = spark.createDataFrame(rows, "arm string, twin string, band string, y double, n long")
    for fit in (fit_poisson, fit_negbin):
        coef, one = table(fit(cells, ["arm", "twin", "band"]))
        plain, other = table(fit(cells, ["arm", "band"]))
        assert coef["twin=y"]["estimate"] is None and one["df_residual"] == other["df_residual"]
        for term in plain:
            assert coef[term]["estimate"] == pytest.approx(plain[term]["estimate"], abs=1e-8)
            assert coef[term]["std_error"] == pytest.approx(plain[term]["std_error"], abs=1e-8)


def test_too_many_terms_are_refused(spark, monkeypatch):
    from pairwell.operators import models

    monkeypatch.setattr(models, "MAX_TERMS", 8)
    cells = spark.createDataFrame([(str(i), str(i % 3), 1.0, 1) for i in range(9)], "arm string, band string, y double, n long")
    with pytest.raises(ValueError, match="coarser"):
        fit_poisson(cells, ["arm"])
    with pytest.raises(ValueError, match="coarser"):
        fit_poisson(cells.where("arm < 4"), ["arm", "band"], interactions=True)
