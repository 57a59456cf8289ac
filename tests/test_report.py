import re

from pyspark.sql import functions as F

from pairwell.functions.text import fixed
from pairwell.operators import report as R
from pairwell.operators.outcome import ALL_GROUPINGS, BASIC_GROUPINGS, outcome_summary


def test_fixed_text_rounds_as_c_does(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (float("inf"),), (float("nan"),), (None,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 2)).collect()] == ["0.12", "1.00", "Inf", "NaN", "NA", "-0.50"]


def test_small_cells(spark):
    rows = [(0, 10), (1, 5), (4, 10), (5, 10), (0, 4), (3, 4), (0, 0), (4, 500)]
    df = spark.createDataFrame(rows, "n long, t long")
    got = [r["s"] for r in R.suppress_small(df, "n", "t", "s").collect()]
    assert got == [
        "0/10(0.00%)", "<5/5(<100.00%)", "<5/10(<50.00%)", "5/10(50.00%)", "0/<5(0.00%)", "<5/<5(75.00%)", "0/0(NaN%)",
        "<5/500(<1.00%)",
    ]
    strict = [r["s"] for r in R.suppress_small(df, "n", "t", "s", strict=True).collect()]
    assert strict[5] == "<5/<5(-)"


def test_no_count_from_one_to_four_is_shown(spark):
    df = spark.createDataFrame([(n, t) for t in range(12) for n in range(t + 1)], "n long, t long")
    for r in R.suppress_small(df, "n", "t", "s").collect():
        shown = re.match(r"^(<?\d+)/(<?\d+)\(", r["s"])
        for part in shown.groups():
            assert part.startswith("<") or int(part) == 0 or int(part) >= 5, r


def test_formats(spark):
    df = spark.createDataFrame([(1.234, 0.5, float("inf"), 0.0004), (0.0, 0.0, float("inf"), float("nan"))], "o double, l double, h double, p double")
    out = R.format_p(R.format_odds(df, "o", "l", "h"), "p", "t").collect()
    assert [r["odds_ratio"] for r in out] == ["1.23(0.50-Inf)", "0.00(0.00-Inf)"]
    assert [r["t"] for r in out] == ["<0.001", "NaN"]


def study(spark):
    rows = []
    for k in range(40):
        for arm in "10":
            dead = "1" if (k + (arm == "1")) % 4 == 0 else "0"
            state = "severe" if k % 2 else ("critical" if arm == "1" else "moderate")
            rows.append((f"p{k}", arm, 50 + k % 20, "male" if k % 3 else "female", state, dead))
    df = spark.createDataFrame(rows, "subclass string, arm string, age int, sex string, first_state string, ind_death string")
    band = F.when(F.col("age") < 55, "12-54").when(F.col("age") < 65, "55-64").otherwise("65+")
    return df.withColumns({"age_group": band, "age_group_narrow": band})


def test_outcome_summary_by_brute_force(spark):
    df = study(spark)
    data = [r.asDict() for r in df.collect()]
    out = {(r["description"], r["age_group"], r["sex"], r["first_state"]): r for r in outcome_summary(df, ALL_GROUPINGS, "ind_death").collect()}

    def check(key, member):
        r = out[key]
        rows = [d for d in data if member(d)]
        assert r["case_n"] == sum(d["arm"] == "1" for d in rows)
        assert r["control_event_n"] == sum(d["arm"] == "0" and d["ind_death"] == "1" for d in rows)
        pairs = {}
        for d in rows:
            pairs.setdefault(d["subclass"], {})[d["arm"]] = d["ind_death"]
        whole = [p for p in pairs.values() if len(p) == 2]
        assert r["case_only"] == sum(p["1"] == "1" and p["0"] == "0" for p in whole)
        assert r["control_only"] == sum(p["1"] == "0" and p["0"] == "1" for p in whole)

    at = "Patient aged 55 and above status at admission"
    check(("Wider age group", "55-64", "male", None), lambda d: d["age_group"] == "55-64" and d["sex"] == "male")
    check(("Wider age group", "65+", None, None), lambda d: d["age_group"] == "65+")
    check(("Patient aged 55 and above", None, None, None), lambda d: d["age"] >= 55)
    check((at, None, None, "severe"), lambda d: d["age"] >= 55 and d["first_state"] == "severe")
    # the members of these pairs are in different status groups until the groups are merged
    check((at, None, None, "critical"), lambda d: d["age"] >= 55 and d["first_state"] == "critical")
    check((at, None, None, "moderate_severe_critical"), lambda d: d["age"] >= 55)
    assert out[(at, None, None, "critical")]["control_n"] == 0
    assert out[(at, None, None, "critical")]["control_event_p"] is None


def test_export_has_text_only(spark):
    out = R.export_outcome(outcome_summary(study(spark), BASIC_GROUPINGS, "ind_death"))
    assert [t for _, t in out.dtypes] == ["string"] * 9
    assert out.filter("odds_ratio IS NULL OR p_value IS NULL OR mcnemar_p_value IS NULL").count() == 0
