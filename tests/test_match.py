import random
from collections import defaultdict

import pytest

from pairwell.operators.joins import pair_wide
from pairwell.operators.match import balance, match_nearest, propensity


def greedy(rows):
    """Brute force: treated from the highest score (then the smallest id), nearest unused control of the stratum."""
    strata = defaultdict(lambda: ([], []))
    for i, arm, stratum, score in rows:
        strata[stratum][0 if arm == "1" else 1].append((score, i))
    pairs = set()
    for treated, controls in strata.values():
        free = list(controls)
        for score, i in sorted(treated, key=lambda t: (-t[0], t[1])):
            if not free:
                break
            best = min(free, key=lambda c: (abs(c[0] - score), c[0], c[1]))
            free.remove(best)
            pairs.add((i, best[1]))
    return pairs


def matched(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id int, arm string, stratum string, score double")
    out = match_nearest(df, "arm", "score", ["stratum"], "id", **kw)
    wide = pair_wide(out, "subclass", "arm", ["id"])
    assert wide.count() * 2 == out.count()
    return {(r["id_case"], r["id_control"]) for r in wide.collect()}


def test_order_of_treated_matters(spark):
    rows = [(1, "1", "s", 0.8), (2, "1", "s", 0.6), (3, "0", "s", 0.62), (4, "0", "s", 0.3)]
    assert matched(spark, rows) == {(1, 3), (2, 4)}


@pytest.mark.parametrize("seed,values", [(1, 4), (2, 12), (3, 200)])
def test_equals_brute_force(spark, seed, values):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice("1000"), rng.choice("ab" if seed < 3 else "a"), float(rng.randrange(values))) for i in range(160)
    ]
    rng.shuffle(rows)
    assert matched(spark, rows) == greedy(rows)


def test_more_treated_than_controls(spark):
    rows = [(i, "1", "s", float(i % 5)) for i in range(30)] + [(100 + i, "0", "s", float(i % 3)) for i in range(12)]
    assert matched(spark, rows) == greedy(rows)


@pytest.fixture
def split_ranges(spark):
    """Ranges stay as small as they are made, so that ranks and running totals go over several partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_hot_cells_are_ranked_over_partitions_and_buckets(spark, monkeypatch, split_ranges):
    from pairwell.operators import match

    monkeypatch.setattr(match, "RANK_BUCKET", 7)
    rows = [(i, "1" if i % 3 == 0 else "0", "s", float(i % 2)) for i in range(120)]
    parts = []
    ranked = match.rank_within
    monkeypatch.setattr(match, "rank_within", lambda df, *a: parts.append(df.repartitionByRange("stratum", "arm", "_score", "id").rdd.getNumPartitions()) or ranked(df, *a))
    assert matched(spark, rows) == greedy(rows) and parts[0] > 1


@pytest.mark.parametrize("seed,arms,values,strata", [(1, "10", 60, "a"), (2, "1000", 90, "ab"), (3, "1110", 70, "a"), (4, "100", 4000, "abc"), (5, "10", 25, "a")])
def test_pieces_of_five_cells_equal_brute_force(spark, split_ranges, seed, arms, values, strata):
    rng = random.Random(seed)
    rows = [(i, rng.choice(arms), rng.choice(strata), float(rng.randrange(values))) for i in range(80)]
    assert matched(spark, rows, piece_cells=5) == greedy(rows)


def test_cells_drawn_together_equal_brute_force(spark, split_ranges):
    # all treated above all controls, then the reverse: no cut divides the stratum
    for sign in (1, -1):
        rows = [(i, "1", "s", sign * (100.0 + i % 9)) for i in range(14)] + [(100 + i, "0", "s", sign * float(i % 13)) for i in range(15)]
        assert matched(spark, rows, piece_cells=4) == greedy(rows)


def test_no_piece_is_larger_than_stated_and_no_pair_leaves_it(spark, split_ranges):
    from pyspark.sql import functions as F

    from pairwell.operators import pairing

    rng = random.Random(7)
    rows = [("s", float(i), *rng.choice([(1, 0), (0, 1), (0, 3), (0, 2), (2, 1)])) for i in range(400)]
    cells = spark.createDataFrame(rows, "stratum string, score double, n1 long, n0 long")
    split = pairing.cut(cells, ["stratum"], 20)
    pieces = split.groupBy("_piece").agg(F.count(F.lit(1)).alias("n"), F.max("_cells").alias("part")).collect()
    assert split.count() == 400 and len(pieces) > 5 and all(r["n"] < 20 + r["part"] for r in pieces)
    part = {r["score"]: r["_part_of"] for r in split.collect()}
    blocks = pairing.pair_blocks(cells, ["stratum"]).collect()
    assert blocks and all(part[b["t_score"]] == part[b["c_score"]] for b in blocks)


def test_rows_without_stratum_or_score_are_left_out(spark):
    rows = [(1, "1", "s", 0.5), (2, "0", None, 0.5), (3, "0", "s", None), (4, None, "s", 0.5), (5, "0", "s", 0.9)]
    assert matched(spark, rows) == {(1, 5)}


def test_propensity_recovers_the_likelihood_maximum(spark):
    # one binary covariate: the fitted probability is the share treated
    rows = [("1" if i < 30 else "0", 0, 5) for i in range(100)] + [("1" if i < 10 else "0", 1, 5) for i in range(50)]
    df = spark.createDataFrame(rows, "arm string, x int, c int")
    scores = {r["x"]: r["distance"] for r in propensity(df, "arm", ["x"]).select("x", "distance").distinct().collect()}
    assert scores[0] == pytest.approx(0.3, abs=1e-9) and scores[1] == pytest.approx(0.2, abs=1e-9)


def test_balance_of_equal_arms_is_zero_and_hand_case(spark):
    rows = [("1", 1.0, "m"), ("1", 3.0, "f"), ("0", 1.0, "m"), ("0", 3.0, "f")]
    df = spark.createDataFrame(rows, "arm string, x double, sex string")
    for r in balance(df, df, "arm", ["x"], ["sex"]).collect():
        assert r["diff_before"] == pytest.approx(0) and r["diff_after"] == pytest.approx(0) and r["balanced"]
    other = spark.createDataFrame(rows[:2] + [("0", 5.0, "f"), ("0", 9.0, "f")], "arm string, x double, sex string")
    got = {(r["variable"], r["level"]): r["diff_before"] for r in balance(other, df, "arm", ["x"], ["sex"]).collect()}
    assert got[("x", "")] == pytest.approx((2 - 7) / 2**0.5)
    assert got[("sex", "m")] == pytest.approx(0.5) and got[("sex", "f")] == pytest.approx(-0.5)


def test_score_fit_equals_newton_and_tells_separation(spark):
    from pairwell.operators.logit import fit_logit

    rng = random.Random(3)
    rows = [("1" if rng.random() < 1 / (1 + 2.718 ** (-0.5 + x / 10 - z)) else "0", x, z) for x in range(20) for z in (0, 1, 2) for _ in range(4)]
    df = spark.createDataFrame(rows, "arm string, x int, z int")
    fit = fit_logit(df, "arm", ["x", "z"])
    coef, one = ([r.asDict() for r in t.collect()] for t in fit.tables(spark))
    assert one[0]["converged"] and not one[0]["separated"] and one[0]["max_score"] < 1e-8 and one[0]["n_rows"] == len(rows)
    import numpy as np

    x = np.array([(1, a, b) for _, a, b in rows], float)
    y = np.array([float(r[0]) for r in rows])
    p = 1 / (1 + np.exp(-x @ [r["estimate"] for r in coef]))
    assert np.abs(x.T @ (y - p)).max() < 1e-6
    cov = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    assert [r["std_error"] for r in coef] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-6)
    assert one[0]["deviance"] == pytest.approx(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    # complete, then with one shared value
    for shared in ([], [("1", 5), ("0", 5)]):
        apart = spark.createDataFrame([("1", 6 + i) for i in range(5)] + [("0", 4 - i) for i in range(5)] + shared, "arm string, x int")
        fit = fit_logit(apart, "arm", ["x"])
        assert fit.separated and not fit.converged
        with pytest.warns(UserWarning, match="separate"):
            scores = propensity(apart, "arm", ["x"], fit=fit).collect()
        assert min(r["distance"] for r in scores if r["x"] > 5) > max(r["distance"] for r in scores if r["x"] < 5)


def test_score_fit_with_a_repeated_or_constant_covariate_and_without_rows(spark):
    from pairwell.operators.logit import fit_logit

    df = spark.createDataFrame([(str(int(i % 3 == 0 or i > 25)), i, 2 * i + 1, 4) for i in range(40)], "arm string, x int, twice int, same int")
    one, all_ = fit_logit(df, "arm", ["x"]), fit_logit(df, "arm", ["x", "twice", "same"])
    assert [r["estimate"] for r in all_.tables(spark)[0].collect()] == pytest.approx([*one.beta, None, None])
    assert all_.deviance == pytest.approx(one.deviance) and all_.converged
    assert fit_logit(df.where("false"), "arm", ["x"]).rows == 0


def test_balance_summary_by_hand(spark, split_ranges):
    from pairwell.operators.match import balance_summary

    rng = random.Random(2)
    rows = [(rng.choice("10"), float(rng.randrange(12)) if rng.random() > 0.05 else None, rng.choice(["m", "f", None])) for _ in range(300)]
    some = [r for r in rows if r[2] != "f"][:120]
    frames = [spark.createDataFrame(r, "arm string, x double, sex string") for r in (rows, some)]
    got = {(r["sample"], r["variable"], r["level"]): r for r in balance_summary(*frames, "arm", ["x"], ["sex"]).collect()}
    assert len(got) == 2 * (1 + 3)
    import statistics as st

    arm = lambda data, a: [x for b, x, _ in data if b == a and x is not None]
    sd = st.stdev(arm(rows, "1"))
    for sample, data in (("all", rows), ("matched", some)):
        one, two = arm(data, "1"), arm(data, "0")
        r = got[sample, "x", ""]
        assert r["mean_treated"] == pytest.approx(st.mean(one)) and r["std_mean_diff"] == pytest.approx((st.mean(one) - st.mean(two)) / sd)
        assert r["var_ratio"] == pytest.approx(st.variance(one) / st.variance(two))
        gaps = [abs(sum(v <= x for v in one) / len(one) - sum(v <= x for v in two) / len(two)) for x in sorted({*one, *two})]
        assert r["ecdf_mean"] == pytest.approx(st.mean(gaps)) and r["ecdf_max"] == pytest.approx(max(gaps))
        for level in ("m", "f", "missing"):
            share = [st.mean([(s or "missing") == level for b, _, s in data if b == a]) for a in "10"]
            p = st.mean([(s or "missing") == level for b, _, s in rows if b == "1"])
            r = got[sample, "sex", level]
            assert (r["mean_treated"], r["mean_control"]) == pytest.approx(tuple(share)) and r["ecdf_max"] == pytest.approx(abs(share[0] - share[1]))
            assert r["std_mean_diff"] == pytest.approx((share[0] - share[1]) / (p * (1 - p)) ** 0.5) and r["var_ratio"] is None
