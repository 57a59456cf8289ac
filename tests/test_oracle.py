"""Every registered query on the smallest data set: result against DuckDB, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from suite import catalog

SF = "/root/testdata/sf0.001"

# queries that end in a test tail, an exact test, formatted report text or the pairing walk
PYTHON = {
    "demographic_table", "fisher_or_ci", "fisher_p", "format_odds", "format_p", "logrank_p", "match_nearest",
    "matched_outcome", "mcnemar_p", "outcome_export", "outcome_summary", "outcome_summary_early",
    "outcome_summary_hosp", "suppress_small",
}


# their SQL needs every combination of levels to occur
LARGER = {"negbin_fit", "negbin_interaction", "poisson_interaction"}
SF_LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def con_larger():
    return connect(SF_LARGER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, con_larger, name):
    def inspect(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        if name not in PYTHON:
            assert "EvalPython" not in plan and "InPandas" not in plan

    where = (con_larger, SF_LARGER) if name in LARGER else (con, SF)
    ok, message = compare(spark, where[0], name, where[1], inspect)
    assert ok is not False, message
    assert not message.startswith("0 rows"), message


def test_entry(spark):
    assert entry.entry(spark).columns == ["subject_id", "duration_hospitalization"]


def test_first_row_is_limited_before_the_shuffle(spark):
    plan = entry.queries()["first_row_per_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filter_and_columns_reach_the_scan(spark):
    plan = entry.queries()["filter_between"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_stay_features_join_the_stays_once(spark):
    from pairwell.operators.derive import stay_features
    from suite import chain as K
    from suite.views import CFG

    base, stays, hot = K.base0(spark, SF)
    flat = stays.sparkSession.createDataFrame(stays.limit(0).rdd, stays.schema)
    index = stays.sparkSession.createDataFrame(base.limit(0).rdd, base.schema)
    plan = stay_features(flat, index, CFG, hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Window ") == 1


@pytest.mark.parametrize(
    "name",
    ["flag_duplicate_key", "flag_cross_table_order", "join_during_stay", "complete_groups", "study_columns", "match_nearest"],
)
def test_query_with_every_key_salted_and_ranks_split(spark, con, name, monkeypatch):
    """The paths for hot keys give the same rows: thresholds so low that all subjects count as hot."""
    from pairwell import skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 1)
    monkeypatch.setattr(skew, "PARTS", 10**9)
    ok, message = compare(spark, con, name, SF)
    assert ok, message
