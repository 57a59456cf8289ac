from datetime import date

import pytest

from pyspark.sql import functions as F

from pairwell.functions.scalars import bin_left_closed, month_label, year_week
from pairwell.operators import clean as C
from pairwell.operators import groups as G
from pairwell.operators import quality as Q
from pairwell.operators.joins import join_during, join_lookback, join_within_days
from pairwell.sources.delimited import malformed_counts, read_csv, read_delimited, write_csv


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_delimited_null_text_and_empty_field(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id|name|day\n1|NULL|2021-02-03\n2||2021-02-30\n3|לא ידוע|NULL\n", encoding="utf-8")
    df = C.coerce(read_delimited(spark, str(path)), {"id": "int", "day": "date"})
    assert values(df.orderBy("id"), "id", "name", "day") == [
        (1, None, date(2021, 2, 3)),
        (2, "", None),
        (3, "לא ידוע", None),
    ]


def test_csv_sink_writes_missing_as_empty(spark, tmp_path):
    out = str(tmp_path / "out")
    write_csv(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), out, single_file=True)
    files = list((tmp_path / "out").glob("*.csv"))
    assert len(files) == 1
    assert sorted(files[0].read_text().splitlines()) == ["1,", "2,x", "a,b"]


def test_csv_keeps_empty_text_and_missing_apart(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x,y"), (None, '"')], "a int, b string")
    write_csv(df, out, single_file=True)
    assert sorted(next((tmp_path / "out").glob("*.csv")).read_text().splitlines()) == [',"\\""', "1,", '2,""', '3,"x,y"', "a,b"]
    assert sorted([tuple(r) for r in read_csv(spark, out, df.schema).collect()], key=str) == sorted([(1, None), (2, ""), (3, "x,y"), (None, '"')], key=str)


def test_malformed_lines_are_kept_named_and_counted(spark, tmp_path):
    (tmp_path / "one.csv").write_text('id|name|day\n1|"a|b"|x\n2|short\n3|c|d|long\n|NULL|\n', encoding="utf-8")
    (tmp_path / "two.csv").write_text("id|name|day\n4|e|f\n5\n", encoding="utf-8")
    rows = read_delimited(spark, str(tmp_path), malformed="line")
    assert sorted([tuple(r) for r in rows.collect()], key=str) == sorted(
        [("1", "a|b", "x", None), ("2", "short", "", "2|short"), ("3", "c", "d", "3|c|d|long"), ("", None, "", None), ("4", "e", "f", None), ("5", "", "", "5")], key=str
    )
    # also where a query needs neither the last field nor the line itself
    assert sorted(r["id"] for r in rows.where("line is not null").select("id").collect()) == ["2", "3", "5"]
    counts = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in malformed_counts(spark, str(tmp_path)).collect()}
    assert counts == {"one.csv": (4, 1, 1, 0), "two.csv": (2, 1, 0, 0)}
    with pytest.raises(Exception, match="MALFORMED"):
        read_delimited(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="name"):
        read_delimited(spark, str(tmp_path), malformed="name")


def test_recode_passes_unlisted_values_and_maps_null(spark):
    df = spark.createDataFrame([("Y",), (None,), ("other",), ("999",)], "x string")
    out = C.recode(df, "x", {"Y": "1", "999": None}, null_to="0")
    assert [r[0] for r in out.collect()] == ["1", "0", "other", None]


def test_ordered_category_and_observed_levels(spark):
    df = C.as_ordered(spark.createDataFrame([("b",), ("zz",), ("d",), (None,)], "x string"), "x", ("a", "b", "c", "d"))
    assert values(df, "x", "x_ord") == [("b", 2), (None, None), ("d", 4), (None, None)]
    assert sorted(values(C.observed_levels(df, "x"), "x", "x_ord"), key=str) == sorted(
        [("b", 1), ("d", 2), (None, None), (None, None)], key=str
    )


def test_dates_and_day_keys(spark):
    df = spark.createDataFrame([("2021-1-5",), ("2021/01/05",), ("2021-01-05 10:00:00",), ("05.01.2021",), ("2021",)], "d string")
    assert [r[0] for r in C.coerce(df, {"d": "date"}).collect()] == [date(2021, 1, 5)] * 3 + [None, None]
    keys = spark.createDataFrame([(20210105,), (20210230,), (None,)], "k int")
    assert [r[0] for r in C.day_key_to_date(keys, "k").collect()] == [date(2021, 1, 5), None, None]


def test_bins_and_keys(spark):
    df = spark.createDataFrame([(11,), (12,), (54,), (55,), (64,), (65,), (120,), (None,)], "a int")
    band = bin_left_closed(F.col("a"), (12, 55, 65), ("12-54", "55-64", "65+"))
    assert [r[0] for r in df.select(band).collect()] == [None, "12-54", "12-54", "55-64", "55-64", "65+", "65+", None]
    one = spark.range(1)
    assert one.select(year_week(F.lit(date(2021, 1, 3)))).first()[0] == "202153"
    assert one.select(month_label(F.lit("202104"))).first()[0] == "04-2021"


def test_duplicate_pair_tags_every_row_of_the_subject(spark, day):
    rows = [(1, day(1)), (1, day(1)), (1, day(9)), (2, day(1)), (2, day(2)), (3, None), (3, None), (None, day(1))]
    df = Q.with_empty_tags(spark.createDataFrame(rows, "id int, d date"))
    out = Q.flag_duplicate_key(df, "id", "d", "dup")
    tagged = {r["id"] for r in out.collect() if r["err"] == " dup"}
    assert tagged == {1, 3} and out.count() == 8


def test_conflicting_value_ignores_missing_ids(spark, day):
    rows = [(1, day(1)), (1, day(2)), (2, day(1)), (2, None), (None, day(1)), (None, day(5))]
    df = Q.with_empty_tags(spark.createDataFrame(rows, "id int, d date"))
    out = Q.flag_conflicting_value(df, "id", "d", "diff").collect()
    assert {r["id"] for r in out if r["err"]} == {1}


def test_missing_partner_treats_missing_ids_as_equal(spark):
    df = Q.with_empty_tags(spark.createDataFrame([(1, "1"), (2, "1"), (None, "1"), (3, "0")], "id int, dead string"))
    other = spark.createDataFrame([(1,), (None,)], "id int")
    out = Q.flag_missing_partner(df, F.col("dead") == "1", other, "id", "none").collect()
    assert {r["id"] for r in out if r["err"]} == {2}


def test_tags_accumulate_in_order_and_filter(spark, day):
    df = Q.with_empty_tags(spark.createDataFrame([(1, day(5), day(3)), (2, day(1), day(3)), (3, day(1), None)], "id int, a date, r date"))
    out = Q.flag_date_order(df, "a", "r", 0, "order")
    out = Q.flag(out, F.col("id") == 1, "first")
    assert {r["id"]: r["err"] for r in out.collect()} == {1: " order first", 2: "", 3: ""}
    assert {r["id"] for r in Q.without_tags(out, ["first"]).collect()} == {2, 3}
    counts = Q.error_counts(out)
    assert {(r["err"], r["value"]) for r in Q.error_combined(counts).collect()} == {(" order first", 1), (None, 1)}
    assert {(r["err"], r["value"]) for r in Q.error_separate(counts).collect()} == {("order", 1), ("first", 1)}


def test_expect_unique_raises(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "id int")
    assert [tuple(r) for r in Q.repeated_keys(df, "id").collect()] == [(1, 2)]
    try:
        Q.expect_unique(df, "id")
        raise AssertionError("no error")
    except ValueError as e:
        assert "occurs 2 times" in str(e)


def test_window_joins_at_their_edges(spark, day):
    index = spark.createDataFrame([(1, day(100))], "id int, ix date")
    starts = [97, 98, 121, 122]
    events = spark.createDataFrame([(1, day(s), None) for s in starts] + [(1, day(99), day(99))], "id int, s date, e date")
    got = join_within_days(events, index, "id", "s", "e", "ix", -2, 21)
    assert {r["s"] for r in got.collect()} == {day(98), day(121)}
    past = spark.createDataFrame([(1, day(100 - d)) for d in (1, 2, 269, 270)], "id int, s date")
    assert {r["s"] for r in join_lookback(past, index, "id", "s", "ix", 1, 270).collect()} == {day(98), day(100 - 269)}
    stay = spark.createDataFrame([(1, day(10), 3)], "id int, a date, n int")
    ups = spark.createDataFrame([(1, day(d)) for d in (9, 10, 13, 14)], "id int, at date")
    assert {r["at"] for r in join_during(ups, stay, "id", "at", "a", "n").collect()} == {day(10), day(13)}


def test_first_row_puts_missing_last_in_both_directions(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 7), (2, None)], "k int, v int")
    low = G.first_per_group(df, ["k"], [F.col("v").asc_nulls_last()])
    high = G.first_per_group(df, ["k"], [F.col("v").desc_nulls_last()])
    assert sorted(values(low, "k", "v")) == [(1, 5), (2, None)] and sorted(values(high, "k", "v")) == [(1, 7), (2, None)]


def test_complete_groups_and_pairs_agree(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), ("c", 2), ("c", 3), ("d", 4), ("d", 5), (None, 1), (None, 2)], "g string, v int")
    expected = [("a", 1), ("a", 1), ("d", 4), ("d", 5)]
    assert sorted(values(G.complete_groups(df, "g", 2), "g", "v")) == expected
    assert sorted(values(G.complete_pairs(df, "g"), "g", "v")) == expected
