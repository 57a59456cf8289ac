from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwell.operators.groups import merge_intervals, newly_covered, total_days

D0 = date(2021, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, D0 + timedelta(days=a), D0 + timedelta(days=b)) for i, a, b in rows], "id int, a date, b date"
    )


def test_touching_nested_and_same_day(spark):
    df = frame(spark, [(1, 1, 5), (1, 5, 7), (1, 9, 9), (1, 8, 10), (2, 3, 3)])
    merged = {(r["id"], (r["a"] - D0).days, (r["b"] - D0).days) for r in merge_intervals(df, "id", "a", "b").collect()}
    assert merged == {(1, 1, 7), (1, 8, 10), (2, 3, 3)}
    assert {tuple(r) for r in total_days(merge_intervals(df, "id", "a", "b"), "id", "a", "b", "n").collect()} == {(1, 8), (2, 0)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 25), st.integers(0, 6)), min_size=1, max_size=40))
def test_days_equal_the_union_of_day_steps(spark, spans):
    rows = [(i, a, a + n) for i, a, n in spans]
    steps = {}
    for i, a, b in rows:
        steps.setdefault(i, set()).update(range(a, b))
    expected = {(i, len(s)) for i, s in steps.items()}
    df = frame(spark, rows)
    assert {tuple(r) for r in total_days(merge_intervals(df, "id", "a", "b"), "id", "a", "b", "n").collect()} == expected
    days = df.groupBy("id", "a").agg(F.max("b").alias("b"))
    quick = days.withColumn("n", newly_covered("id", "a", "b")).groupBy("id").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in quick.collect()} == expected
