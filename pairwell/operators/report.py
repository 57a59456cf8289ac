"""Report tables: suppressed counts, formatted tests, parameters with attrition, demographics.

All inputs are aggregates with a fixed small number of rows, apart from the single aggregate each table starts with.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.config import StudyConfig
from pairwell.functions.text import fixed, percent_of
from pairwell.operators.aggregate import CASE, CONTROL, quantiles_by
from pairwell.operators.quality import ERR, error_counts, error_kinds


def suppressed(n: Column, total: Column, min_n: int = 5, strict: bool = False) -> Column:
    """``n/total(percent)`` without showing a count from 1 to ``min_n`` - 1.

    A small total is hidden, but its percentage stays unless ``strict``.
    """
    small = lambda c: (c > 0) & (c < min_n)
    shown = lambda c: F.when(small(c), F.lit(f"<{min_n}")).otherwise(c.cast("string"))
    rate = F.when(total == 0, F.lit(float("nan"))).otherwise(F.lit(100) * (n / total))
    percent = F.concat(fixed(rate, 2), F.lit("%"))
    if strict:
        percent = F.when(small(total), F.lit("-")).otherwise(percent)
    bound = F.concat(
        F.lit(f"<{min_n}/"),
        total.cast("string"),
        F.lit("(<"),
        fixed(F.lit(100.0 * min_n) / F.nullif(total, F.lit(0)), 2),
        F.lit("%)"),
    )
    plain = F.concat(shown(n), F.lit("/"), shown(total), F.lit("("), percent, F.lit(")"))
    return F.when(small(n) & (total >= min_n), bound).otherwise(plain)


def suppress_small(df: DataFrame, n: str, total: str, out: str, min_n: int = 5, strict: bool = False) -> DataFrame:
    return df.withColumn(out, suppressed(F.col(n), F.col(total), min_n, strict))


def format_odds(df: DataFrame, odds="fisher_or", lo="fisher_lo", hi="fisher_hi", out="odds_ratio") -> DataFrame:
    """``1.23(0.45-3.21)``."""
    text = F.concat(
        fixed(F.col(odds), 2), F.lit("("), fixed(F.col(lo), 2), F.lit("-"), fixed(F.col(hi), 2), F.lit(")")
    )
    return df.withColumn(out, text)


def format_p(df: DataFrame, col: str, out: str) -> DataFrame:
    """``<0.001`` or three decimals."""
    return df.withColumn(out, F.when(F.col(col) < 0.001, F.lit("<0.001")).otherwise(fixed(F.col(col), 3)))


def export_outcome(summary: DataFrame, min_n: int = 5, strict: bool = False) -> DataFrame:
    """The outcome table as text."""
    out = suppress_small(summary, "case_event_n", "case_n", "case", min_n, strict)
    out = suppress_small(out, "control_event_n", "control_n", "control", min_n, strict)
    out = format_odds(out)
    out = format_p(format_p(out, "fisher_p", "p_value"), "mcnemar_p", "mcnemar_p_value")
    keys = ["description", "age_group", "sex", "first_state"]
    return out.select(*keys, "case", "control", "odds_ratio", "p_value", "mcnemar_p_value")


def _pairs(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(a, None if b is None else str(b)) for a, b in rows], "description string, value string")


def row_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows and distinct rows of a source, in one aggregate per distinct row and one over those."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return copies.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("unique_rows")
    ).select(F.lit(name).alias("source"), "n_rows", "unique_rows")


def _as_lines(df: DataFrame, lines: list[tuple[str, Column]]) -> DataFrame:
    items = [F.struct(F.lit(d).alias("description"), v.cast("string").alias("value")) for d, v in lines]
    return df.select(F.inline(F.array(*items)))


def error_lines(tagged: DataFrame, name: str) -> DataFrame:
    """Error counts of one tagged table, per combination with a total and per single tag, from one pass."""
    kind = F.col("kind")
    head = F.when(kind == "total", F.lit(f"Error in {name} combined total")).otherwise(
        F.concat(F.lit(f"Error in {name} "), kind, F.lit(": "), F.col(ERR))
    )
    value = F.coalesce("value", F.lit(0)).cast("string")
    return error_kinds(error_counts(tagged)).select(head.alias("description"), value.alias("value"))


def params_table(
    cfg: StudyConfig, sources: dict[str, DataFrame], tagged_master: DataFrame, tagged_stays: DataFrame
) -> DataFrame:
    """Study limits, row counts of the raw sources and error counts, as (description, value) text rows.

    ``sources`` are the raw frames under ``master``, ``hospitalizations``, ``monitoring`` and ``quarantine``.
    """
    # The descriptions, spelled as the parameter table prints them.
    spark = tagged_master.sparkSession
    limits = _pairs(
        spark,
        [
            ("Study start", cfg.study_start),
            ("Study end", cfg.study_end),
            ("Study maximum positive pcr to hospitalization", cfg.max_days_to_stay),
            ("Study minimum positive pcr to hospitalization", cfg.min_days_to_stay),
            ("Study maximum positive pcr to death", cfg.max_days_to_death),
            ("Study minimum days to death", cfg.min_days_to_death),
            ("Study minimum age", cfg.min_age),
        ],
    )
    lines = {"master": [("Rows in master source", "n_rows"), ("Rows in master without duplicate complete rows", "unique_rows")]}
    out = limits
    for name in ("master", "hospitalizations", "monitoring", "quarantine"):
        if name in sources:
            told = [(d, F.col(c)) for d, c in lines.get(name, [])]
            told.append((f"Duplicated conplete rows rmoved from {name}", F.col("n_rows") - F.col("unique_rows")))
            out = out.unionByName(_as_lines(row_counts(sources[name], name), told))
    pairs = tagged_master.groupBy("subject_id", "index_date").agg(
        F.count_if(F.col(ERR) == "").alias("_clean")
    )
    per_id = pairs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_p"), F.sum("_clean").alias("_clean"))
    checks = per_id.agg(
        F.coalesce(F.sum("_clean"), F.lit(0)).alias("clean"),
        (F.coalesce(F.sum("_p"), F.lit(0)) - F.count(F.lit(1))).alias("extra"),
    )
    extra = "Duplicated patient id with additional first_positive_result_test_date in master"
    lines = [("Rows in master with complete non-confilicted cases", F.col("clean")), (extra, F.col("extra"))]
    out = out.unionByName(_as_lines(checks, lines))
    return out.unionByName(error_lines(tagged_master, "master")).unionByName(
        error_lines(tagged_stays, "hospitalizations")
    )


def _arm_counts(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    aggs = []
    for name, cond in conds.items():
        aggs += [
            F.count_if(cond).alias(f"{name}_g"),
            F.count_if(cond & (F.col("arm") == CASE)).alias(f"{name}_1"),
            F.count_if(cond & (F.col("arm") == CONTROL)).alias(f"{name}_0"),
        ]
    return df.agg(*aggs)


def demographic_table(base: DataFrame, pre: DataFrame, study: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Subjects per period, before and after matching, age quartiles, and shares of bands and sex.

    One aggregate over ``base``, one over ``pre``, and one over ``study`` by grouping sets (each band, sex, and all),
    besides the quartiles. Lines are put together as numbers; only the finished few rows are turned into text.
    """
    last = cfg.wave_cutoff - timedelta(days=1)
    periods = [(cfg.study_start, last), (cfg.wave_cutoff, cfg.study_end), (cfg.study_start, cfg.study_end)]
    old_enough = F.coalesce(F.col("age") >= cfg.min_age, F.lit(False))
    inside = {
        f"p{i}": F.coalesce(F.col("index_date").between(F.lit(a), F.lit(b)), F.lit(False)) & old_enough
        for i, (a, b) in enumerate(periods)
    }
    # numbers of a line and what they are shares of; no total means the number alone
    parts = ("g", "c", "k")
    line = lambda d, numbers, totals: F.struct(
        d.alias("d"), *[n.cast("bigint").alias(x) for x, n in zip(parts, numbers)], *[t.cast("bigint").alias(f"t{x}") for x, t in zip(parts, totals)]
    )
    none = F.lit(None)
    counted = lambda n, d: line(F.lit(d), [F.col(f"{n}_{x}") for x in ("g", "1", "0")], [none, F.col(f"{n}_g"), F.col(f"{n}_g")])
    # The descriptions, spelled as the demographic table prints them.
    head = f"Complete non-confilicted cases aged {cfg.min_age}+ during"
    names = [f"{head} {a} - {b}" for a, b in periods]
    groups = {"age_group": "Study age group ", "age_group_narrow": "Study age group ", "sex": "Study sex "}
    first = _arm_counts(base, inside).select(F.inline(F.array(*[counted(f"p{i}", d) for i, d in enumerate(names)])))

    arm = lambda a: F.count_if(F.col("arm") == a)
    sets = study.groupingSets([*[[F.col(c)] for c in groups], []], *[F.col(c) for c in groups]).agg(
        *[F.grouping(c).alias(f"_{c}") for c in groups], F.count(F.lit(1)).alias("g"), arm(CASE).alias("c"), arm(CONTROL).alias("k")
    )
    label = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.concat(F.lit(d), F.coalesce(F.col(c).cast("string"), F.lit("missing")))) for c, d in groups.items()])
    whole = label.isNull()
    after = sets.agg(
        F.collect_list(F.when(~whole, F.struct(label.alias("d"), *parts))).alias("_lines"),
        *[F.coalesce(F.max(F.when(whole, F.col(x))), F.lit(0)).alias(f"a_{y}") for x, y in zip(parts, ("g", "1", "0"))],
    )
    both = after.unionByName(_arm_counts(pre, {"b": F.lit(True)}), allowMissingColumns=True)
    both = both.agg(F.max("_lines").alias("_lines"), *[F.max(c).alias(c) for c in both.columns if c != "_lines"])
    matched = line(
        F.lit("In the study group after match (% of the same group before match)"),
        [F.col("a_g"), F.col("a_1"), F.col("a_0")], [none, F.col("b_1"), F.col("b_0")],
    )
    shares = F.transform("_lines", lambda x: line(x["d"], [x[p] for p in parts], [F.col("a_g"), F.col("a_1"), F.col("a_0")]))
    second = both.select(F.inline(F.concat(F.array(counted("b", "In the study group brfore match"), matched), shares)))
    number = lambda x: F.when(F.col(f"t{x}").isNull(), F.col(x).cast("string")).otherwise(percent_of(F.col(x), F.col(f"t{x}")))
    rows = first.unionByName(second).select(
        F.col("d").alias("description"), number("g").alias("general"), number("c").alias("case"), number("k").alias("control")
    )

    q = quantiles_by(study, "age", "arm")
    middle = F.when(F.col("q50") == F.floor("q50"), fixed(F.col("q50"), 0)).otherwise(fixed(F.col("q50"), 1))
    shown = F.concat(middle, F.lit("("), fixed(F.col("q25"), 2), F.lit("-"), fixed(F.col("q75"), 2), F.lit(")"))
    pick = lambda g: F.max(F.when(F.col("grp") == g, F.col("_t")))
    ages = q.withColumn("_t", shown).agg(
        F.lit("Study median age(lower quartile - upper quartile)").alias("description"),
        pick("all").alias("general"),
        pick(CASE).alias("case"),
        pick(CONTROL).alias("control"),
    )
    return rows.unionByName(ages)
