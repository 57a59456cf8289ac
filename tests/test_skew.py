import pytest
from pyspark.sql import functions as F

from pairwell import skew
from pairwell.skew import attach, hot_keys, rank_within


@pytest.fixture(scope="module")
def events(spark):
    # key 1 holds a third of the rows, NULL a tenth
    rows = [(1, i) for i in range(400)] + [(None, i) for i in range(120)] + [(2 + i % 97, i) for i in range(680)]
    return spark.createDataFrame(rows, "k int, v int")


@pytest.fixture(scope="module")
def side(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "k int, s string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_keys_are_the_heaviest(events):
    assert {r[0] for r in hot_keys(events, ["k"], 100).rows} == {1, None}
    assert hot_keys(events, ["k"], 1000).rows == ()


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_salted_join_equals_plain_join(events, side, how, null_safe):
    hot = hot_keys(events, ["k"], 50)
    assert max(r[1] for r in hot.rows) > 1
    right = side.select(F.col("k").alias("k2"), "s")
    on = events["k"].eqNullSafe(right["k2"]) if null_safe else events["k"] == right["k2"]
    expected = events.join(right, on, how).select("k", "v", "s")
    assert rows(attach(events, side, ["k"], how, null_safe, hot=hot)) == rows(expected)
    assert rows(attach(events, side, ["k"], how, null_safe)) == rows(expected)


def test_salt_spreads_the_hot_key(events, side):
    salted = attach(events, side, ["k"], "left", hot=hot_keys(events, ["k"], 50))
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "xxhash64" in plan


def test_range_condition(events, side):
    got = attach(events, side, ["k"], "inner", condition=lambda l, r: (l("v") < 10) & (r("k") == 1))
    assert rows(got) == sorted([(1, i, "a") for i in range(10)], key=str)


def test_rank_over_several_partitions_is_the_row_number(spark):
    data = [("a" if i % 3 else "b", (i * 7919) % 1000) for i in range(1000)]
    got = rank_within(spark.createDataFrame(data, "g string, id int"), ["g"], ["id"])
    want = [(g, x, k + 1) for g in "ab" for k, x in enumerate(sorted(v for h, v in data if h == g))]
    assert rows(got) == sorted(want, key=str)
    tied = rank_within(spark.createDataFrame([("a", 1)] * 50 + [("b", None)] * 7, "g string, id int"), ["g"], ["id"])
    assert sorted((r["g"], r["rank"]) for r in tied.collect()) == [("a", k + 1) for k in range(50)] + [("b", k + 1) for k in range(7)]


def test_every_hot_key_is_split_however_many(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 1)
    monkeypatch.setattr(skew, "PARTS", 1000)
    events = spark.range(60_000).select((F.col("id") % 2000).alias("k"), F.col("id").alias("v"))
    hot = hot_keys(events, ["k"])
    limit = skew.threshold(60_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert len(hot.rows) == 2000 and {r[1] for r in hot.rows} == {-(-30 // limit)}
    salted = attach(events, events.select("k", F.lit("x").alias("s")).distinct(), ["k"], hot=hot)
    assert salted.count() == 60_000


def test_threshold_bounds_the_list():
    for total, partitions in ((10**12, 2000), (10**7, 8), (100, 4)):
        limit = skew.threshold(total, partitions)
        assert total / limit <= skew.PARTS * partitions and limit >= skew.HEAVY_ROWS
