"""Queries for sources, typing, filters, joins, grouped summaries, sorts, unions and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.scalars import bin_left_closed, days_between, month_label, year_month, year_week
from pairwell.operators import aggregate as A
from pairwell.operators import clean as C
from pairwell.operators import groups as G
from pairwell.operators import joins as J
from pairwell.operators.quality import repeated_keys
from pairwell.session import discard, new_folder, stored
from pairwell.sources.delimited import line_kind, read_csv, read_delimited, write_csv
from suite import views as V
from suite.registry import query

t = V.table


# sources and sinks


@query(
    "scan_delimited",
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
         CAST(o_orderdate AS DATE) AS o_day FROM orders""",
)
def scan_delimited(spark, sf):
    path = new_folder(spark, "orders")
    rows = t(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END").alias("o_custkey"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END").alias("o_orderstatus"),
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_day"),
    )
    write_csv(rows, path, sep="|", missing="NULL")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in rows.columns])
    back = read_delimited(spark, path, schema)
    back = C.coerce(back, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_day": "date"})
    out = stored(back, "orders")
    discard(spark, path)
    return out


@query(
    "sink_roundtrip",
    """SELECT c_custkey, c_name, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END AS c_mktsegment
       FROM customer""",
)
def sink_roundtrip(spark, sf):
    """A table written as CSV and read back: a missing text and an empty one stay apart."""
    path = new_folder(spark, "customer")
    segment = F.col("c_mktsegment")
    rows = t(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_acctbal",
        F.when(segment == "MACHINERY", F.lit("")).when(segment != "BUILDING", segment).alias("c_mktsegment"),
    )
    write_csv(rows, path)
    back = stored(read_csv(spark, path, rows.schema), "customer")
    discard(spark, path)
    return back


@query(
    "scan_malformed",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 3 THEN 'short' WHEN o_orderkey % 40 = 7 THEN 'long' END AS kind,
         CASE WHEN o_orderkey % 40 <> 3 THEN o_totalprice END AS o_totalprice FROM orders""",
)
def scan_malformed(spark, sf):
    """A text file in which some lines lack their last field and some have one more: all are kept, and named."""
    path = new_folder(spark, "lines")
    key, sep = F.col("o_orderkey"), F.lit("|")
    line = F.concat_ws("|", key.cast("string"), F.concat(F.lit('"'), "o_orderstatus", sep, F.lit('"')))
    line = F.when(key % 40 == 3, line).otherwise(F.concat(line, sep, F.col("o_totalprice").cast("string")))
    line = F.when(key % 40 == 7, F.concat(line, F.lit("|beyond"))).otherwise(line)
    t(spark, sf, "orders").select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")])
    back = read_delimited(spark, path, schema, header=False, malformed="line").withColumn("kind", line_kind(F.col("line"), 3))
    back = C.coerce(back, {"o_orderkey": "bigint", "o_totalprice": "double"})
    out = stored(back.select("o_orderkey", "kind", "o_totalprice"), "lines")
    discard(spark, path)
    return out


# cleaning and typing


@query("dedupe_rows", "SELECT DISTINCT * FROM subject_rows")
def dedupe_rows(spark, sf):
    return C.dedupe_rows(V.subject_rows(spark, sf))


@query("sentinel_to_null", "SELECT subject_id, NULLIF(index_date, DATE '1994-12-26') AS index_date FROM subject_rows")
def sentinel_to_null(spark, sf):
    rows = V.subject_rows(spark, sf).select("subject_id", "index_date")
    return C.null_if(rows, "index_date", V.CFG.index_sentinel)


@query(
    "recode_values",
    """SELECT l_orderkey, l_linenumber,
         CASE WHEN flag IS NULL THEN 'none' WHEN flag = 'A' THEN 'accepted' WHEN flag = 'R' THEN NULL ELSE flag END AS flag
       FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS flag FROM lineitem) l""",
)
def recode_values(spark, sf):
    flag = F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag")
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", flag)
    return C.recode(rows, "flag", {"A": "accepted", "R": None}, null_to="none")


_LEVELS = ("5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query(
    "ordered_category",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS o_orderpriority,
         CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END
           AS o_orderpriority_ord FROM orders""",
)
def ordered_category(spark, sf):
    return C.as_ordered(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _LEVELS)


@query(
    "coerce_types",
    """SELECT event_id, CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS day,
         TRY_CAST(regexp_extract(props, '-?[0-9]+', 0) AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
         CAST(value AS DOUBLE) AS value FROM events""",
)
def coerce_types(spark, sf):
    rows = t(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("string").alias("day"),
        F.regexp_extract("props", "-?[0-9]+", 0).alias("k"),
        F.col("event_type").alias("bad"),
        F.col("value").cast("string").alias("value"),
    )
    return C.coerce(rows, {"day": "date", "k": "int", "bad": "double", "value": "double"})


@query(
    "day_key_to_date",
    """SELECT l_orderkey, l_linenumber, day_key,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day
       FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 20210230 ELSE CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) END
               AS day_key FROM lineitem) l""",
)
def day_key_to_date(spark, sf):
    key = F.when(F.col("l_linenumber") == 7, F.lit(20210230)).otherwise(F.date_format("l_shipdate", "yyyyMMdd").cast("int"))
    return C.day_key_to_date(
        t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("day_key")), "day_key", "day"
    )


@query(
    "observed_levels",
    """SELECT o_orderkey, o_orderpriority, CAST(DENSE_RANK() OVER (ORDER BY o) AS INTEGER) AS o_orderpriority_ord
       FROM (SELECT *, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4
                         WHEN '1-URGENT' THEN 5 END AS o FROM orders
             WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '2-HIGH')) p""",
)
def observed_levels(spark, sf):
    levels = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
    rows = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    rows = C.as_ordered(rows.filter(~F.col("o_orderpriority").isin("4-NOT SPECIFIED", "2-HIGH")), "o_orderpriority", levels)
    return C.observed_levels(rows, "o_orderpriority")


@query(
    "collapse_levels",
    """SELECT subject_id, first_state, CASE WHEN first_state IN ('severe', 'critical') THEN 'severe_critical'
         ELSE first_state END AS merged FROM study""",
)
def collapse_levels(spark, sf):
    rows = V.study(spark, sf).select("subject_id", "first_state")
    return C.collapse_levels(rows, "first_state", {"severe_critical": ("severe", "critical")}, "merged")


# projections, filters, predicates


@query("project_rename", "SELECT l_orderkey AS order_id, l_quantity AS quantity FROM lineitem")
def project_rename(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_quantity").withColumnsRenamed(
        {"l_orderkey": "order_id", "l_quantity": "quantity"}
    )


@query(
    "filter_predicates",
    """SELECT subject_id, arrival, release_date, division FROM stays
       WHERE (division = 'dedicated' AND arrival IS NOT NULL AND NOT (release_date < arrival)) OR recorded_days <= 0""",
)
def filter_predicates(spark, sf):
    rows = V.stays(spark, sf)
    keep = (F.col("division") == "dedicated") & F.col("arrival").isNotNull() & ~(F.col("release_date") < F.col("arrival"))
    return rows.filter(keep | (F.col("recorded_days") <= 0)).select("subject_id", "arrival", "release_date", "division")


@query(
    "filter_between",
    """SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS ship FROM lineitem
       WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""",
)
def filter_between(spark, sf):
    rows = t(spark, sf, "lineitem").filter(
        F.col("l_quantity").between(10, 20)
        & F.col("l_shipdate").between(F.expr("TIMESTAMP_NTZ'1996-01-01'"), F.expr("TIMESTAMP_NTZ'1998-12-31'"))
    )
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("date").alias("ship"))


@query(
    "filter_membership",
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
       AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def filter_membership(spark, sf):
    chosen = t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rows = t(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return rows.select("o_orderkey", "o_custkey", "o_orderpriority").join(chosen, "o_custkey", "left_semi")


@query(
    "drop_missing",
    """SELECT subject_id, index_date, sex, birth_year FROM master
       WHERE subject_id IS NOT NULL AND index_date IS NOT NULL AND sex IS NOT NULL AND birth_year IS NOT NULL""",
)
def drop_missing(spark, sf):
    return V.master(spark, sf).select("subject_id", "index_date", "sex", "birth_year").dropna()


@query(
    "conditional_column",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done'
         WHEN o_orderstatus = 'O' THEN 'open' END AS kind FROM orders""",
)
def conditional_column(spark, sf):
    kind = (
        F.when(F.col("o_totalprice") > 300000, "large")
        .when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", "open")
    )
    return t(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


@query(
    "default_after_join",
    """SELECT c_custkey, COALESCE(ind, '0') AS ind, CASE WHEN ind IS NOT NULL THEN 'seen' WHEN c_acctbal < 0 THEN 'debt'
         ELSE 'unknown' END AS status
       FROM customer LEFT JOIN (SELECT o_custkey, '1' AS ind FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o
         ON o_custkey = c_custkey""",
)
def default_after_join(spark, sf):
    urgent = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    rows = t(spark, sf, "customer").join(urgent.distinct().withColumn("ind", F.lit("1")), "c_custkey", "left")
    status = F.when(F.col("ind").isNotNull(), "seen").when(F.col("c_acctbal") < 0, "debt").otherwise("unknown")
    return rows.select("c_custkey", F.coalesce("ind", F.lit("0")).alias("ind"), status.alias("status"))


# joins


@query("join_inner", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def join_inner(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_mktsegment")


@query(
    "join_left",
    """SELECT s.subject_id, s.arrival, m.index_date FROM stays s LEFT JOIN (
         SELECT subject_id, MIN(index_date) AS index_date FROM master WHERE ind_death = '1' GROUP BY subject_id) m
         ON m.subject_id = s.subject_id""",
)
def join_left(spark, sf):
    first = V.master(spark, sf).filter("ind_death = '1'").groupBy("subject_id").agg(F.min("index_date").alias("index_date"))
    stays = V.stays(spark, sf).select("subject_id", "arrival")
    return J.attach(stays, first, ["subject_id"], "left", hot=V.hot_stays(spark, sf))


@query(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def join_semi(spark, sf):
    big = t(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey", "c_name").join(big.distinct(), "c_custkey", "left_semi")


@query(
    "join_anti",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def join_anti(spark, sf):
    big = t(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey", "c_name").join(big.distinct(), "c_custkey", "left_anti")


_INDEX = "(SELECT subject_id, MIN(index_date) AS index_date FROM master WHERE index_date IS NOT NULL GROUP BY subject_id)"


def _index(spark, sf):
    rows = V.master(spark, sf).filter("subject_id IS NOT NULL AND index_date IS NOT NULL")
    return rows.groupBy("subject_id").agg(F.min("index_date").alias("index_date"))


@query(
    "join_within_days",
    f"""SELECT s.subject_id, s.arrival, s.release_date, i.index_date FROM stays s JOIN {_INDEX} i ON i.subject_id = s.subject_id
        WHERE s.arrival - i.index_date BETWEEN -60 AND 365 AND (s.release_date IS NULL OR i.index_date <= s.release_date)""",
)
def join_within_days(spark, sf):
    stays = V.stays(spark, sf).select("subject_id", "arrival", "release_date")
    hot = V.hot_stays(spark, sf)
    return J.join_within_days(stays, _index(spark, sf), "subject_id", "arrival", "release_date", "index_date", -60, 365, hot)


@query(
    "join_lookback",
    f"""SELECT s.subject_id, s.arrival, i.index_date FROM stays s JOIN {_INDEX} i ON i.subject_id = s.subject_id
        WHERE i.index_date - s.arrival > 1 AND i.index_date - s.arrival < 270""",
)
def join_lookback(spark, sf):
    stays = V.stays(spark, sf).select("subject_id", "arrival")
    return J.join_lookback(stays, _index(spark, sf), "subject_id", "arrival", "index_date", 1, 270, V.hot_stays(spark, sf))


@query(
    "join_during_stay",
    """SELECT u.subject_id, u.first_date, u.first_state, s.first_arrival, s.days
       FROM updates u JOIN (SELECT subject_id, MIN(arrival) AS first_arrival, MAX(recorded_days) AS days FROM stays
                            WHERE arrival IS NOT NULL GROUP BY subject_id) s ON s.subject_id = u.subject_id
       WHERE u.first_date - s.first_arrival BETWEEN 0 AND s.days""",
)
def join_during_stay(spark, sf):
    stays = (
        V.stays(spark, sf)
        .filter("arrival IS NOT NULL")
        .groupBy("subject_id")
        .agg(F.min("arrival").alias("first_arrival"), F.max("recorded_days").alias("days"))
    )
    updates = V.updates(spark, sf).select("subject_id", "first_date", "first_state")
    return J.join_during(updates, stays, "subject_id", "first_date", "first_arrival", "days", V.hot_stays(spark, sf))


@query(
    "pair_self_join",
    """SELECT a.subclass, a.ind_death AS ind_death_case, b.ind_death AS ind_death_control, a.age AS age_case, b.age AS age_control
       FROM study a JOIN study b ON b.subclass = a.subclass AND a.arm = '1' AND b.arm = '0'""",
)
def pair_self_join(spark, sf):
    return J.pair_wide(V.study(spark, sf), "subclass", "arm", ["ind_death", "age"])


# grouped summaries


@query(
    "conditional_counts",
    """SELECT age_group, sex, COUNT(*) FILTER (WHERE arm = '1') AS case_n, COUNT(*) FILTER (WHERE arm = '0') AS control_n,
         COUNT(*) FILTER (WHERE arm = '1' AND ind_death = '1') AS case_event_n,
         COUNT(*) FILTER (WHERE arm = '0' AND ind_death = '1') AS control_event_n,
         COUNT(*) FILTER (WHERE arm = '1' AND ind_death = '1') / NULLIF(COUNT(*) FILTER (WHERE arm = '1'), 0) AS case_event_p,
         COUNT(*) FILTER (WHERE arm = '0' AND ind_death = '1') / NULLIF(COUNT(*) FILTER (WHERE arm = '0'), 0) AS control_event_p
       FROM study GROUP BY age_group, sex""",
)
def conditional_counts(spark, sf):
    return A.conditional_counts(V.study(spark, sf), ["age_group", "sex"], "arm", F.col("ind_death") == "1")


@query(
    "group_min_max",
    "SELECT l_orderkey, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, CAST(MIN(l_shipdate) AS DATE) AS first_day FROM lineitem GROUP BY l_orderkey",
)
def group_min_max(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.min("l_shipdate").cast("date").alias("first_day")
    )


@query(
    "group_sum_days",
    "SELECT subject_id, CAST(SUM(release_date - arrival) AS BIGINT) AS days FROM stays WHERE release_date IS NOT NULL AND arrival IS NOT NULL GROUP BY subject_id",
)
def group_sum_days(spark, sf):
    return G.total_days(V.stays(spark, sf).dropna(subset=["arrival", "release_date"]), "subject_id", "arrival", "release_date", "days")


@query(
    "quantiles_by_arm",
    """SELECT grp, COUNT(*) AS n, quantile_cont(age, 0.25) AS q25, quantile_cont(age, 0.5) AS q50, quantile_cont(age, 0.75) AS q75
       FROM (SELECT 'all' AS grp, CAST(age AS DOUBLE) AS age FROM study UNION ALL SELECT arm, CAST(age AS DOUBLE) FROM study) a GROUP BY grp""",
)
def quantiles_by_arm(spark, sf):
    return A.quantiles_by(V.study(spark, sf), "age", "arm")


@query(
    "quantiles_sketched",
    """SELECT l_returnflag, COUNT(*) AS n, prob, TRUE AS within_error
       FROM lineitem, (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) p(prob) GROUP BY l_returnflag, prob""",
)
def quantiles_sketched(spark, sf):
    """Quantiles of prices from sketches of parts, merged, and whether their true ranks, counted here, are within the stated error."""
    rows = t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    sketches = A.merged_sketches(A.value_sketches(rows, "l_extendedprice", ["l_returnflag", "l_linestatus"]), ["l_returnflag"])
    found = A.sketched_quantiles(sketches, ["l_returnflag"], (0.01, 0.25, 0.5, 0.75, 0.99))
    price = F.col("l_extendedprice")
    ranked = rows.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag", "n", "prob").agg(
        F.count_if(price < F.col("value")).alias("below"), F.count_if(price <= F.col("value")).alias("upto")
    )
    off = F.greatest(F.col("below") - F.col("prob") * F.col("n"), F.col("prob") * F.col("n") - F.col("upto"), F.lit(0.0))
    return ranked.select("l_returnflag", "n", "prob", (off <= A.rank_error() * F.col("n")).alias("within_error"))


@query(
    "arm_shares",
    """SELECT age_group, general_n, general_n / SUM(general_n) OVER () AS general_p, case_n, case_n / SUM(case_n) OVER () AS case_p,
         control_n, control_n / SUM(control_n) OVER () AS control_p
       FROM (SELECT age_group, COUNT(*) AS general_n, COUNT(*) FILTER (WHERE arm = '1') AS case_n,
               COUNT(*) FILTER (WHERE arm = '0') AS control_n FROM study GROUP BY age_group) g""",
)
def arm_shares(spark, sf):
    return A.shares_by(A.frequency(V.study(spark, sf), ["age_group", "arm"]), "age_group", "arm")


@query(
    "stacked_groupings",
    """SELECT 'band and sex' AS description, age_group, sex, COUNT(*) AS n FROM study GROUP BY ALL
       UNION ALL SELECT 'band', age_group, NULL, COUNT(*) FROM study GROUP BY ALL
       UNION ALL SELECT 'older by sex', NULL, sex, COUNT(*) FROM study WHERE age >= 55 GROUP BY ALL
       UNION ALL SELECT 'older', NULL, NULL, COUNT(*) FROM study WHERE age >= 55""",
)
def stacked_groupings(spark, sf):
    older = lambda c: c("older")
    band, sex = (lambda c: c("age_group")), (lambda c: c("sex"))
    cells = A.frequency(V.study(spark, sf).withColumn("older", F.col("age") >= 55), ["age_group", "sex", "older"])
    sets = [
        A.Grouping("band and sex", {"age_group": band, "sex": sex}),
        A.Grouping("band", {"age_group": band}),
        A.Grouping("older by sex", {"sex": sex}, older),
        A.Grouping("older", {}, older),
    ]
    return A.stack_groupings(cells, sets, ["age_group", "sex"], ["n"]).drop("grouping")


@query("frequency_table", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def frequency_table(spark, sf):
    return A.frequency(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "duplicate_counts",
    """SELECT CAST(n AS BIGINT) AS n_rows, CAST(u AS BIGINT) AS unique_rows, n - u AS removed_rows, p - i AS extra_keys
       FROM (SELECT (SELECT COUNT(*) FROM subject_rows) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM subject_rows) d) AS u,
               (SELECT COUNT(*) FROM (SELECT DISTINCT subject_id, index_date FROM subject_rows) d) AS p,
               (SELECT COUNT(*) FROM (SELECT DISTINCT subject_id FROM subject_rows) d) AS i) c""",
)
def duplicate_counts(spark, sf):
    return A.duplicate_counts(V.subject_rows(spark, sf), "subject_id", "index_date")


@query(
    "histogram_days_study",
    "SELECT days_index_to_stay, arm, COUNT(*) AS n FROM study WHERE days_index_to_stay BETWEEN -20 AND 20 GROUP BY ALL",
)
def histogram_days_study(spark, sf):
    rows = V.study(spark, sf).filter(F.col("days_index_to_stay").between(-20, 20))
    return A.histogram(rows, "days_index_to_stay", "arm")


# first rows, intervals, complete groups


@query(
    "first_row_per_group",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber,
                                      l_extendedprice) AS rn FROM lineitem) l WHERE rn = 1""",
)
def first_row_per_group(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    order = [F.col("l_quantity").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("l_orderkey", "l_linenumber", "l_extendedprice")]]
    return G.first_per_group(rows, ["l_partkey"], order)


@query(
    "merge_intervals",
    """SELECT subject_id, MIN(arrival) AS arrival, MAX(release_date) AS release_date FROM (
         SELECT *, SUM(CASE WHEN arrival > seen THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id
                  ORDER BY arrival, release_date ROWS UNBOUNDED PRECEDING) AS island
         FROM (SELECT *, MAX(release_date) OVER (PARTITION BY subject_id ORDER BY arrival, release_date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
               FROM stays WHERE arrival IS NOT NULL AND release_date >= arrival) a) b
       GROUP BY subject_id, island""",
)
def merge_intervals(spark, sf):
    rows = V.stays(spark, sf).filter("release_date >= arrival")
    return G.merge_intervals(rows, "subject_id", "arrival", "release_date").drop("island")


@query(
    "complete_groups",
    """SELECT subject_id, subclass, arm, ind_hospitalized FROM (
         SELECT *, COUNT(*) OVER (PARTITION BY subclass) AS n FROM study WHERE ind_hospitalized IN ('0', '1')) s WHERE n = 2""",
)
def complete_groups(spark, sf):
    rows = V.study(spark, sf).filter(F.col("ind_hospitalized").isin("0", "1"))
    return G.complete_groups(rows.select("subject_id", "subclass", "arm", "ind_hospitalized"), "subclass", 2)


# sorts and unions


@query("sort_mixed", "SELECT arm, age, sex, subject_id FROM study ORDER BY arm DESC, age, sex, subject_id")
def sort_mixed(spark, sf):
    rows = V.study(spark, sf).select("arm", "age", "sex", "subject_id")
    return rows.orderBy(F.desc("arm"), "age", "sex", "subject_id")


@query(
    "union_rows",
    "SELECT subject_id, first_state AS state FROM updates UNION ALL SELECT subject_id, last_state FROM updates",
)
def union_rows(spark, sf):
    rows = V.updates(spark, sf)
    first = rows.select("subject_id", F.col("first_state").alias("state"))
    return first.unionByName(rows.select("subject_id", F.col("last_state").alias("state")))


@query(
    "union_fill",
    """SELECT age_group, sex, COUNT(*) AS n FROM study GROUP BY ALL
       UNION ALL SELECT age_group, NULL, COUNT(*) FROM study GROUP BY ALL""",
)
def union_fill(spark, sf):
    rows = V.study(spark, sf)
    return A.frequency(rows, ["age_group", "sex"]).unionByName(A.frequency(rows, ["age_group"]), allowMissingColumns=True)


@query(
    "first_last_to_long",
    """SELECT subject_id, 1 AS which, first_state AS state, first_date AS day FROM updates
       UNION ALL SELECT subject_id, 2, last_state, last_date FROM updates""",
)
def first_last_to_long(spark, sf):
    return G.first_last_to_long(
        V.updates(spark, sf), "subject_id", ("first_state", "first_date"), ("last_state", "last_date"), ("state", "day")
    )


@query("distinct_columns", "SELECT DISTINCT subject_id, death_date FROM stays WHERE death_date IS NOT NULL")
def distinct_columns(spark, sf):
    return V.stays(spark, sf).select("subject_id", "death_date").dropna().distinct()


# scalar functions


@query(
    "day_difference",
    "SELECT subject_id, arrival, CAST(release_date - arrival AS INTEGER) AS days, CAST(death_date - arrival AS INTEGER) AS to_death FROM stays",
)
def day_difference(spark, sf):
    return V.stays(spark, sf).select(
        "subject_id",
        "arrival",
        days_between("arrival", "release_date").alias("days"),
        days_between("arrival", "death_date").alias("to_death"),
    )


@query(
    "week_month_keys",
    """SELECT o_orderkey, concat(CAST(year(o_orderdate) AS VARCHAR), lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0')) AS week_key,
         strftime(o_orderdate, '%Y%m') AS month_key FROM orders""",
)
def week_month_keys(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return t(spark, sf, "orders").select("o_orderkey", year_week(day).alias("week_key"), year_month(day).alias("month_key"))


@query(
    "age_and_shift",
    "SELECT subject_id, 2021 - birth_year AS age, CAST(index_date - INTERVAL 1 DAY AS DATE) AS day_before FROM master",
)
def age_and_shift(spark, sf):
    return V.master(spark, sf).select(
        "subject_id", (F.lit(2021) - F.col("birth_year")).alias("age"), F.date_sub("index_date", 1).alias("day_before")
    )


@query(
    "bin_left_closed",
    """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity < 12 THEN NULL WHEN l_quantity < 35 THEN '12-34'
         WHEN l_quantity < 45 THEN '35-44' WHEN l_quantity >= 45 THEN '45+' END AS band FROM lineitem""",
)
def bin_left_closed_query(spark, sf):
    band = bin_left_closed(F.col("l_quantity"), (12, 35, 45), ("12-34", "35-44", "45+"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", band.alias("band"))


@query(
    "format_text",
    """SELECT o_orderkey, printf('%d of %s (%d%%)', o_custkey, o_orderstatus, o_orderkey % 100) AS txt,
         concat('Study age group ', o_orderpriority) AS label FROM orders""",
)
def format_text(spark, sf):
    return t(spark, sf, "orders").select(
        "o_orderkey",
        F.format_string("%d of %s (%d%%)", "o_custkey", "o_orderstatus", F.expr("o_orderkey % 100")).alias("txt"),
        F.concat(F.lit("Study age group "), "o_orderpriority").alias("label"),
    )


@query(
    "regex_ops",
    """SELECT event_id, regexp_matches(event_type, '^(click|view)$') AS seen,
         regexp_replace(strftime(ts, '%Y%m'), '(\\d{4})(\\d{2})', '\\2-\\1') AS month,
         regexp_replace(event_type, '^(.*)', 'Type: \\1') AS label FROM events""",
)
def regex_ops(spark, sf):
    return t(spark, sf, "events").select(
        "event_id",
        F.col("event_type").rlike("^(click|view)$").alias("seen"),
        month_label(F.date_format("ts", "yyyyMM")).alias("month"),
        F.regexp_replace("event_type", "^(.+)", "Type: $1").alias("label"),
    )


@query(
    "split_text",
    """SELECT word, COUNT(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) d
       WHERE word <> '' GROUP BY word""",
)
def split_text(spark, sf):
    words = t(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return A.frequency(words, ["word"])


@query(
    "repeated_lines",
    "SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING COUNT(*) > 1",
)
def repeated_lines(spark, sf):
    return repeated_keys(t(spark, sf, "lineitem"), "l_orderkey")
